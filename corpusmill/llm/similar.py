"""Near copies by shared shingles: links of fingerprints, min-hash bands for what these can't link, exact similarity for every link, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from corpusmill.llm.common import discard, fits_broadcast, fresh, ship_package, small_batches, stored
from corpusmill.llm.components import components
from corpusmill.llm.simhash import SEED, fingerprint, links, one_of_each

SHINGLE_WORDS = 5
LEAST_SIMILARITY = 0.8

#: A pair of similarity s has an equal band with a probability of 1 - (1 - s ** BAND_HASHES) ** BANDS: at 0.8 it has none once in 300,000.
BANDS = 24
BAND_HASHES = 4
HASHES = BANDS * BAND_HASHES
#: Pairs with fewer equal min-hashes are not checked; at a similarity of 0.8 that is five standard deviations off.
LEAST_EQUAL = 56
#: Shingles whose hashes are computed at a time, and cells of a comparison.
BLOCK = 4096
CELLS = 200_000
#: Pairs with fewer equal min-hashes are left to the last step, which writes no pairs; at a similarity of 0.8 a tenth has fewer.
LIKELY = 72
#: Partners proposed to a row by a bucket in a round; the nearest one of all its buckets is checked.
NEAREST = 2
#: Rounds go on while at least one of so many pairs holds; what they leave is found by the last step.
WORTH = 10
#: Rows of a bucket that a task compares with as many others at a time.
CHUNK = 4096
#: The same where rows bring their shingles along.
VERIFIED = 1024

_FACTORS = np.random.default_rng(SEED).integers(1 << 63, size=(2, HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def shingles(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes of the different shingles; a text with fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # as in simhash.fingerprint
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(word, SEED) for word in words), np.uint64, len(words))
    size = min(shingle_words, len(words))
    rolled = np.zeros(len(words) - size + 1, np.uint64)
    for at in range(size):
        rolled = _mixed(rolled * np.uint64(0xD6E8FEB86659FD93) + hashes[at : at + len(rolled)])
    return np.unique(rolled)


def signature(found: np.ndarray) -> np.ndarray:
    """16 bits of each min-hash; four of them are a band."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), BLOCK):
        part = (found[at : at + BLOCK, None] ^ _FACTORS[0]) * _FACTORS[1]
        np.minimum(least, part.min(axis=0), out=least)
    return (_mixed(least) >> np.uint64(48)).astype(np.uint16)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of all shingles of both."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def with_signature(frame: DataFrame, mark: str, signed: str, text: str = "text", printed: str | None = None) -> DataFrame:
    """Adds a hash of the whole set of shingles and its signature, null without words; with ``printed`` the text's fingerprint too."""
    ship_package(frame.sparkSession)
    text_at = frame.columns.index(text)
    schema = StructType([*frame.schema, StructField(mark, LongType()), StructField(signed, BinaryType()), *([StructField(printed, LongType())] if printed else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(value.as_py()) for value in batch.column(text_at)]
            marks = np.array([xxhash.xxh64_intdigest(found.tobytes(), SEED) for found in sets], np.uint64).view(np.int64)
            signs = pa.array([signature(found).tobytes() if len(found) else None for found in sets], pa.binary())
            prints = [pa.array(np.array([fingerprint(value.as_py()) for value in batch.column(text_at)], np.uint64).view(np.int64))] if printed else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks), signs, *prints], schema.names)

    return frame.mapInArrow(run, schema)


def _buckets(signs: np.ndarray) -> np.ndarray:
    """The buckets of signatures (as rows of 24 bands): a hash of each band and its number."""
    return _mixed(signs + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = batch.column("node").to_numpy()
        found = _buckets(np.frombuffer(b"".join(batch.column("signed").to_pylist()), np.uint64).reshape(-1, BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(np.repeat(nodes, BANDS))], ["bucket", "node"])


def _compare(asked: np.ndarray, others: np.ndarray, other_roots: np.ndarray, asked_roots: np.ndarray,
             width: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes (asked, other) of pairs with different roots and LEAST_EQUAL equal min-hashes; the ``width`` most equal of each asked one."""
    step = max(1, CELLS // max(len(others), 1))
    for at in range(0, len(asked), step):
        some = asked[at : at + step]
        equal = np.zeros((len(some), len(others)), np.int16)
        for place in range(HASHES):
            equal += some[:, place, None] == others[None, :, place]
        equal[asked_roots[at : at + step, None] == other_roots[None, :]] = 0
        if width is not None and width < len(others):
            best = np.argpartition(-equal, width - 1, axis=1)[:, :width]
            row, place = np.nonzero(np.take_along_axis(equal, best, axis=1) >= LEAST_EQUAL)
            yield at + row, best[row, place]
        else:
            row, place = np.nonzero(equal >= LEAST_EQUAL)
            yield at + row, place


def _by_part(close):
    """Reads rows sorted by (bucket, asks_part, held_part) and hands the rows of one after the other to ``close``, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            marks = [batch.column(name).to_numpy() for name in ("bucket", "asks_part", "held_part")]
            if not batch.num_rows:
                continue
            cuts = np.flatnonzero(np.any([np.diff(mark) != 0 for mark in marks], axis=0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                here = tuple(int(mark[start]) for mark in marks)
                if held and here != key:
                    yield from close(pa.Table.from_batches(held))
                    held = []
                key = here
                held.append(batch.slice(start, stop - start))
        if held:
            yield from close(pa.Table.from_batches(held))

    return run


def _met(table: pa.Table, width: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places of the rows that ask and are asked for, all signatures, and pairs among them that could hold."""
    asks = table.column("asks").to_numpy().astype(bool)
    if asks.all() or not asks.any():
        return
    found = table.column("root").to_numpy()
    signs = np.frombuffer(b"".join(table.column("signed").to_pylist()), np.uint16).reshape(-1, HASHES)
    asking, held = np.flatnonzero(asks), np.flatnonzero(~asks)
    for x, y in _compare(signs[asking], signs[held], found[held], found[asking], width):
        yield asking, held, signs, x, y


def _proposer(width: int, likely: int):
    """Pairs that probably hold: of each row that asks the ``width`` nearest by signature. One row without a pair where only others could hold."""

    def rows_out(bucket: int, a: pa.Array, b: pa.Array, equal: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), bucket)), a, b, equal], ["bucket", "a", "b", "equal"])

    def close(table: pa.Table) -> Iterator[pa.RecordBatch]:
        nodes, bucket, could, given = table.column("node").to_numpy(), table.column("bucket")[0].as_py(), False, False
        for asking, held, signs, x, y in _met(table, width):
            equal = (signs[asking[x]] == signs[held[y]]).sum(axis=1, dtype=np.int32)
            could, good = could or len(x) > 0, equal >= likely
            if good.any():
                given = True
                yield rows_out(bucket, pa.array(nodes[asking[x[good]]]), pa.array(nodes[held[y[good]]]), pa.array(equal[good]))
        if could and not given:
            yield rows_out(bucket, pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()))

    return _by_part(close)


def _verifier(least: float):
    """Links among all pairs with enough equal min-hashes, checked where they meet: the sets come along, pairs are never written.

    A pair that shares several buckets is checked in the smallest of them only, and once if both rows ask. Of buckets with the same members the
    smallest was kept, so that one is there.
    """

    def close(table: pa.Table) -> Iterator[pa.RecordBatch]:
        nodes, stray = table.column("node").to_numpy(), table.column("stray").to_numpy(zero_copy_only=False)
        bucket, sets, own = table.column("bucket")[0].as_py(), table.column("found").to_pylist(), {}
        none = np.iinfo(np.int64).max
        for asking, held, signs, x, y in _met(table, None):
            if not own:
                own["buckets"] = _buckets(np.ascontiguousarray(signs).view(np.uint64).reshape(-1, BANDS))
            for at in range(0, len(x), CELLS // BANDS):
                a, b = asking[x[at : at + CELLS // BANDS]], held[y[at : at + CELLS // BANDS]]
                both = own["buckets"][a]
                first = np.where(both == own["buckets"][b], both, none).min(axis=1) == bucket
                first &= ~stray[b] | (nodes[a] < nodes[b])
                good = [
                    (i, j) for i, j in zip(a[first].tolist(), b[first].tolist())
                    if similarity(np.frombuffer(sets[i], np.uint64), np.frombuffer(sets[j], np.uint64)) >= least
                ]
                if good:
                    left, right = np.array(good).T
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[left]), pa.array(nodes[right])], ["a", "b"])

    return _by_part(close)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array([shingles(text.as_py()).tobytes() for text in batch.column("text")], pa.binary())], ["node", "found"])


def _check(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            holds = [
                similarity(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) >= least
                for a, b in zip(batch.column("found_a"), batch.column("found_b"))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(holds, pa.bool_())], ["a", "b", "holds"])

    return run


def _of_nodes(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of these nodes; others stay where they are read, as long as the nodes are few enough to be sent to all tasks."""
    return sets.join(F.broadcast(nodes) if fits_broadcast(nodes) else nodes, "node", "left_semi")


def _checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b, holds of different pairs, each compared by its sets."""
    pairs = stored(pairs, "similar-pairs")
    sets = _of_nodes(sets, stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "similar-asked"))
    full = pairs.join(sets.select(F.col("node").alias("b"), F.col("found").alias("found_b")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("found").alias("found_a")), "a")
    return stored(full.select("a", "b", "found_a", "found_b").mapInArrow(_check(least), "a long, b long, holds boolean"), "similar-checked")


def _joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """The roots after more links: only roots that meet go through the components' rounds."""
    edges = links.join(known.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a").join(
        known.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b").filter("root_a <> root_b")
    moved = components(edges.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("further"))
    return stored(known.join(moved, "root", "left").select("node", F.coalesce("further", "root").alias("root")), "similar-roots")


def _crossing(members: DataFrame, known: DataFrame, signs: DataFrame, chunk: int, turn: int | None = None) -> DataFrame:
    """Rows that meet: in each bucket with several roots, all rows outside its most frequent root ask all rows.

    Both sides are cut into parts of about ``chunk`` rows and every part meets every other, so a bucket of any size is spread over tasks.
    With a ``turn`` rows ask only their own part, which is another in every turn, so no row is copied more than once.
    ``signs`` are the columns to bring along, by node.
    """
    placed = members.join(known, "node")
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("rows"), F.count("*").alias("roots")).filter("roots > 1")
    main = main.select(
        "bucket", F.col("most.root").alias("main"),
        F.ceil((F.col("rows") - F.col("most.n")) / chunk).cast("int").alias("asks_parts"), F.ceil(F.col("rows") / chunk).cast("int").alias("held_parts"))
    rows = placed.join(main, "bucket").join(signs, "node").withColumn("stray", F.col("root") != F.col("main"))
    carried = ["node", "root", "stray", *[column for column in signs.columns if column != "node"]]
    if turn is not None:
        part = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("held_parts")).cast("int")
        asked = rows.select("bucket", part.alias("asks_part"), part.alias("held_part"), F.lit(0).alias("asks"), *carried)
        order = ["bucket", "asks_part", "held_part"]
        return asked.unionByName(asked.filter("stray").withColumn("asks", F.lit(1))).repartition(*order).sortWithinPartitions(*order)
    mine = F.xxhash64("node")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    asking = rows.filter("stray").select(
        "bucket", F.pmod(mine, F.col("asks_parts")).cast("int").alias("asks_part"), every("held_parts").alias("held_part"), F.lit(1).alias("asks"), *carried)
    held = rows.select(
        "bucket", every("asks_parts").alias("asks_part"), F.pmod(mine, F.col("held_parts")).cast("int").alias("held_part"), F.lit(0).alias("asks"), *carried)
    order = ["bucket", "asks_part", "held_part"]
    return asking.unionByName(held).repartition(*order).sortWithinPartitions(*order)


def _fingerprint_links(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables of pairs a, b of nodes, with the ``group`` of linked fingerprints that they are in.

    The first ties each node to the smallest one of its fingerprint and these to that of the group's smallest fingerprint, so it has fewer pairs
    than there are nodes, however often a fingerprint was linked. The second has all links of different fingerprints.
    """
    marks = rows.select("fingerprint", "node").distinct()
    pivots = stored(marks.groupBy("fingerprint").agg(F.min("node").alias("pivot")), "similar-fingerprints")
    near = stored(links(pivots.select("fingerprint")).distinct(), "similar-near")
    grouped = stored(
        pivots.join(components(near).withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("group", F.coalesce("root", "fingerprint")).drop("root"),
        "similar-groups")
    heads = grouped.filter("fingerprint = group").select("group", F.col("pivot").alias("head"))
    same = marks.join(grouped, "fingerprint").select(F.col("pivot").alias("a"), F.col("node").alias("b"), "group")
    tied = same.unionByName(grouped.join(heads, "group").select(F.col("head").alias("a"), F.col("pivot").alias("b"), "group"))
    both = near.join(grouped.select(F.col("fingerprint").alias("a"), F.col("pivot").alias("pivot_a"), "group"), "a").join(
        pivots.select(F.col("fingerprint").alias("b"), F.col("pivot").alias("pivot_b")), "b").select(F.col("pivot_a").alias("a"), F.col("pivot_b").alias("b"), "group")
    tied, both = (pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "group").distinct() for pairs in (tied, both))
    return stored(tied, "similar-linked"), both


def _of_different_roots(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs a, b that are not connected yet."""
    placed = pairs.join(known.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a").join(
        known.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b")
    return placed.filter("root_a <> root_b").select("a", "b")


def roots(rows: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """node, root of all sets that are linked to others, from node, signed, fingerprint, text (rows with equal node have equal shingles).

    First the links of fingerprints are checked: each node with the smallest of its group of linked fingerprints, then, where that does not connect the whole
    group, every link between what is still apart. For what fingerprints can't link, sets meet in buckets of equal bands, 24 for each; of buckets with the same members one is kept. Each member is checked against its bucket's smallest, unless they are connected.
    Where that leaves several groups in a bucket, each member outside the largest one is checked against
    the nearest member of other groups by its signature, if that pair is LIKELY to hold, again while enough of these do, and then, in blocks that bring their shingles
    along, against all with enough equal min-hashes. So every pair that is not connected otherwise is checked or too far off by its signature, while pairs
    are written once for a node, a link of fingerprints, a member of a bucket and a member that asks in a round, and never for all of a group.
    Each round is written; components are computed of the groups that meet, not anew.
    """
    spark = rows.sparkSession
    ship_package(spark)
    signs = stored(rows.filter("signed IS NOT NULL").groupBy("node").agg(F.first("signed").alias("signed")), "similar-signs")
    banded = signs.mapInArrow(_bands, "bucket long, node long")
    held = F.struct(F.count("*").alias("n"), F.min("node").alias("pivot"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    different = banded.groupBy("bucket").agg(held.alias("held")).filter("held.n > 1").groupBy("held").agg(F.min("bucket").alias("bucket"))
    members = stored(banded.join(different.select("bucket", F.col("held.pivot").alias("pivot")), "bucket").select("bucket", "node", "pivot"), "similar-members")
    tied, linked = _fingerprint_links(rows.filter("signed IS NOT NULL"))
    wanted = members.select("node").unionByName(tied.select(F.col("a").alias("node"))).unionByName(tied.select(F.col("b").alias("node"))).distinct()
    wanted = stored(wanted, "similar-wanted")
    texts = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = stored(texts.mapInArrow(_sets, "node long, found binary"), "similar-sets")
    checked = _checked(tied.select("a", "b").distinct(), sets, least)
    known = _joined(wanted.withColumn("root", F.col("node")), checked.filter("holds").select("a", "b"))
    wrong = checked.filter("NOT holds").select("a", "b")
    # Where a group's nodes are all like its smallest, none of its links can tell more; of other groups every link is looked at.
    broken = tied.join(wrong, ["a", "b"], "left_semi").select("group").distinct()
    checked = _checked(_of_different_roots(linked.join(broken, "group", "left_semi").select("a", "b").distinct(), known).join(wrong, ["a", "b"], "left_anti"), sets, least)
    before, known = known, _joined(known, checked.filter("holds").select("a", "b"))
    discard(before)
    wrong = stored(wrong.unionByName(checked.filter("NOT holds").select("a", "b")), "similar-wrong")
    first = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    checked = _checked(_of_different_roots(first, known).join(wrong, ["a", "b"], "left_anti"), sets, least)
    before, known = known, _joined(known, checked.filter("holds").select("a", "b"))
    discard(before)
    wrong = wrong.unionByName(checked.filter("NOT holds").select("a", "b"))
    found, turn = True, 0
    while found:
        meeting, turn = _crossing(members, known, signs, CHUNK, turn), turn + 1
        proposed = stored(meeting.mapInArrow(_proposer(NEAREST, LIKELY), "bucket long, a long, b long, equal int"), "similar-proposed")
        asked = proposed.filter("a IS NOT NULL").select(F.col("a").alias("asks"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "equal")
        best = asked.join(wrong, ["a", "b"], "left_anti").groupBy("asks").agg(F.max(F.struct("equal", "a", "b")).alias("best"))
        checked = _checked(best.select("best.a", "best.b").distinct(), sets, least)
        good = checked.filter("holds").select("a", "b")
        held = good.count()
        found = held * WORTH > checked.count()
        if held:
            before, known = known, _joined(known, good)
            discard(before)
        # A bucket of one part that gave no row has no pair left that could hold.
        open_ones = proposed.select("bucket").unionByName(members.groupBy("bucket").count().filter(F.col("count") > CHUNK).select("bucket"))
        before, members = members, stored(members.join(open_ones.distinct(), "bucket", "left_semi"), "similar-members")
        wrong = stored(wrong.unionByName(checked.filter("NOT holds").select("a", "b")), "similar-wrong")
        for frame in (before, proposed, checked):
            discard(frame)
    if members.isEmpty():
        return known
    left = stored(members.select("node").distinct(), "similar-left")
    last = _crossing(members, known, _of_nodes(signs, left).join(_of_nodes(sets, left), "node"), VERIFIED).mapInArrow(_verifier(least), "a long, b long")
    return _joined(known, stored(last, "similar-links"))


def keep_one_similar(frame: DataFrame, identity: str = "doc_id", text: str = "text", least: float = LEAST_SIMILARITY) -> DataFrame:
    """One row of each group linked by a Jaccard similarity of ``least`` or more on five-word shingles.

    Kept is the row with the smallest id, then the smallest text hash; null ids come last. All columns are kept. Rows with
    equal shingles, such as those without words, are copies.
    """
    mark, signed, printed, root = (fresh(frame, name) for name in ("_shingles", "_signature", "_fingerprint", "_root"))
    with small_batches(frame.sparkSession):
        marked = stored(with_signature(frame, mark, signed, text, printed), "shingled")
        found = roots(marked.select(
            F.col(mark).alias("node"), F.col(signed).alias("signed"), F.col(printed).alias("fingerprint"), F.col(f"`{text}`").alias("text")), least)
    known = found.select(F.col("node").alias(mark), F.col("root").alias(root))
    return one_of_each(marked.drop(signed, printed), known, mark, root, identity, text).select(*[F.col(f"`{column}`") for column in frame.columns])
