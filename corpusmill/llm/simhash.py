"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusmill.llm.common import fresh, read, ship_package, stored
from corpusmill.llm.components import components

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEED = 42

#: Blocks the 64 bits are cut into; MAX_DISTANCE differing bits leave at least BLOCKS - MAX_DISTANCE equal.
BLOCKS = 6
#: Fingerprints with equal key bits that are compared with each other at once.
BUCKET_ROWS = 4096
#: Beyond so few free bits a bucket cannot be larger than 2 to that power.
LEAST_FREE_BITS = 14
#: Hashes whose bits are counted at a time.
COUNTED = 65_536


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if it is in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII blanks
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return hashed(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle_words + 1].tolist()
    stops = ends[shingle_words - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), COUNTED):
        part = [hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + COUNTED], stops[at : at + COUNTED])]
        bits = np.unpackbits(np.array(part, dtype=">u8").view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts)).view(">u8")[0])


def with_fingerprint(frame: DataFrame, name: str, text: str = "text", shingle_words: int = SHINGLE_WORDS, keep_text: bool = True) -> DataFrame:
    """Adds the fingerprint of whole texts as a long with the 64 bits; null and blank texts have 0."""
    ship_package(frame.sparkSession)
    text_at = frame.columns.index(text)
    passed = [at for at in range(len(frame.columns)) if keep_text or at != text_at]
    schema = StructType([*[frame.schema[at] for at in passed], StructField(name, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(value.as_py(), shingle_words) for value in batch.column(text_at)]
            marks = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(at) for at in passed], marks], schema.names)

    return frame.mapInArrow(run, schema)


def _masks(bits: list[int], blocks: int, equal: int) -> list[int]:
    """Masks of every choice of ``equal`` out of ``blocks`` nearly equal runs of the given bits."""
    cuts = [len(bits) * at // blocks for at in range(blocks + 1)]
    parts = [sum(1 << bit for bit in bits[a:b]) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(parts, equal)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _finer(mask: int, max_distance: int) -> list[int]:
    """Masks that extend ``mask`` so that close fingerprints equal under it are equal under one of these."""
    free = [bit for bit in range(64) if not mask >> bit & 1]
    return [mask | extra for extra in _masks(free, max_distance + 1, 1)]


def _forest(found: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked within one bucket: a spanning forest, not all pairs."""
    left, heads, tails = np.arange(len(found)), [], []
    while len(left):
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            step = max(1, 4_000_000 // len(left))
            hits = np.full(len(left), -1, np.int64)
            for at in range(0, len(reached), step):
                some = reached[at : at + step]
                near = np.bitwise_count(found[left][:, None] ^ found[some][None, :]) <= max_distance
                fresh = near.any(axis=1) & (hits < 0)
                hits[fresh] = some[near[fresh].argmax(axis=1)]
            new = hits >= 0
            heads.append(left[new])
            tails.append(hits[new])
            reached, left = left[new], left[~new]
    none = np.zeros(0, np.int64)
    return found[np.concatenate([none, *heads])], found[np.concatenate([none, *tails])]


def _linker(max_distance: int, bucket_rows: int):
    """Reads rows sorted by (mask, bucket); gives links (mask null), or finer keys for buckets too large."""

    def rows_out(masks, buckets, a, b) -> pa.RecordBatch:
        mask = pa.nulls(len(a), pa.int64()) if masks is None else pa.array(masks)
        bucket = pa.nulls(len(a), pa.int64()) if buckets is None else pa.array(buckets)
        return pa.RecordBatch.from_arrays(
            [mask, bucket, pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["mask", "bucket", "a", "b"]
        )

    def rekey(mask: int, found: np.ndarray) -> Iterator[pa.RecordBatch]:
        for finer in _finer(mask % (1 << 64), max_distance):
            keys = (found & np.uint64(finer)).view(np.int64)
            yield rows_out(np.full(len(found), _signed(finer), np.int64), keys, found, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, large = None, [], False

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, large
            found = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held, large_was, large = [], large, False
            if large_was:
                yield from rekey(key[0], found)
            elif len(found) > 1:
                a, b = _forest(found, max_distance)
                if len(a):
                    yield rows_out(None, None, a, b)

        for batch in batches:
            masks, buckets = (batch.column(c).to_numpy() for c in ("mask", "bucket"))
            found = batch.column("fingerprint").to_numpy().view(np.uint64)
            if not len(found):
                continue
            cuts = np.nonzero((masks[1:] != masks[:-1]) | (buckets[1:] != buckets[:-1]))[0] + 1
            for start, stop in zip([0, *cuts], [*cuts, len(found)]):
                here = (int(masks[start]), int(buckets[start]))
                if here != key:
                    yield from close()
                    key = here
                elif stop - start == 0:
                    continue
                held.append(found[start:stop])
                free = 64 - (key[0] % (1 << 64)).bit_count()
                if free > LEAST_FREE_BITS and sum(map(len, held)) > bucket_rows:
                    yield from rekey(key[0], np.concatenate(held))
                    held, large = [], True
        yield from close()

    return run


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links a, b that connect all fingerprints within ``max_distance`` bits of each other.

    ``distinct`` has one row per fingerprint. The bits are cut into blocks; for each choice of blocks that must
    remain equal the fingerprints are shuffled by the bits of these blocks and each bucket is verified by
    Hamming distance. A bucket gives links along a spanning forest, at most one per member. Buckets of more
    than ``bucket_rows`` members are not compared but shuffled again by finer keys: the bits that are still
    free are cut into one block more than may differ, so again one must be equal. No pair is lost, nothing
    quadratic is left: after three such rounds a bucket has at most 2 to the 14 members.
    """
    spark = distinct.sparkSession
    ship_package(spark)
    masks = [_signed(mask) for mask in _masks(list(range(64)), BLOCKS, BLOCKS - max_distance)]
    pending = distinct.select(
        F.explode(F.array(*[F.lit(mask).cast("long") for mask in masks])).alias("mask"), "fingerprint"
    ).withColumn("bucket", F.col("mask").bitwiseAND(F.col("fingerprint")))
    found = None
    while True:
        ordered = pending.repartition("mask", "bucket").sortWithinPartitions("mask", "bucket")
        step = stored(
            ordered.select("mask", "bucket", "fingerprint").mapInArrow(
                _linker(max_distance, bucket_rows), "mask long, bucket long, a long, b long"
            ), "simhash-links",
        )
        edges = step.filter("mask IS NULL").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        more = step.filter("mask IS NOT NULL")
        if more.isEmpty():
            return found
        pending = more.select("mask", "bucket", F.col("a").alias("fingerprint"))


def groups(marks: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """fingerprint, root (same for all that are linked) and component_id, the least doc_id, from doc_id and fingerprint."""
    classes = marks.groupBy("fingerprint").agg(F.min("doc_id").alias("_least"))
    rooted = components(links(classes.select("fingerprint"), max_distance)).withColumnRenamed("node", "fingerprint")
    members = stored(
        classes.join(rooted, "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "_least"),
        "fingerprint-roots",
    )
    least = members.groupBy("root").agg(F.min("_least").alias("component_id"))
    return members.select("fingerprint", "root").join(least, "root")


def near_duplicates(
    frame: DataFrame, identity: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links.

    Equal texts meet in their fingerprint before anything is compared. Documents without words share
    fingerprint zero and are linked like others. Rows with a null doc_id are returned but name no component;
    one that reaches no other gets null. Repeated rows are returned repeated. An empty frame gives no rows. Other columns are not read.
    """
    slim = frame.select(F.col(f"`{identity}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    marks = stored(with_fingerprint(slim, "fingerprint", shingle_words=shingle_words, keep_text=False), "fingerprints")
    return marks.join(groups(marks, max_distance), "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(marked: DataFrame, known: DataFrame, mark: str, root: str, identity: str, text: str) -> DataFrame:
    """The first row of each group: ``known`` gives marks their root, a mark that it lacks is its own.

    First is the smallest id, then the smallest text hash; null ids come last. Copies are cut to one per mark and task
    before they are shuffled, and so are groups.
    """
    nth = fresh(marked, "_nth")
    order = [F.col(f"`{identity}`").asc_nulls_last(), F.xxhash64(F.col(f"`{text}`"))]

    def first_of(rows: DataFrame, key: str) -> DataFrame:
        ranked = rows.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
        return ranked.filter(F.col(nth) == 1).drop(nth)

    joined = first_of(marked, mark).join(known, mark, "left").withColumn(root, F.coalesce(F.col(root), F.col(mark)))
    return first_of(joined, root)


def keep_one(frame: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id, then the smallest text hash; null ids come last.

    All columns are kept.
    """
    mark, root = fresh(frame, "_fingerprint"), fresh(frame, "_root")
    marked = stored(with_fingerprint(frame, mark, text), "fingerprinted")
    found = groups(marked.select(F.col(f"`{identity}`").alias("doc_id"), F.col(mark).alias("fingerprint")))
    known = found.select(F.col("fingerprint").alias(mark), F.col("root").alias(root))
    return one_of_each(marked, known, mark, root, identity, text).select(*[F.col(f"`{column}`") for column in frame.columns])


def op5_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(read(spark, folder, "documents"))
