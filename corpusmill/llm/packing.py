"""Packing token pieces into sequences: linear grouping, few-size configurations, best fit for small pieces."""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusmill.llm.byte_words import split_words
from corpusmill.llm.common import read, running_sums, ship_package, small_batches, stored
from corpusmill.llm.merges import ChunkEncoder, ids_of_words, joined_ids, row_blocks

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"

#: Lengths above this part of the capacity are grouped and packed by configurations.
LARGE_PART = 1 / 8
#: Equal-cardinality groups of large lengths.
GROUPS = 200
#: Configurations priced before the plan is taken as good enough; any number gives a valid plan.
PRICING_ROUNDS = 400
#: Hash ranges in which pieces of one length are numbered.
RANK_RANGES = 1024

#: Marks that end a letter run; each behind a letter is a token apart, so words are split there before different ones are looked for.
WORD_ENDS = b".,;:!?"


#: Different words that a worker remembers at least, of those it met last, and the longest of them.
MEMO_WORDS = 100_000
MEMO_LETTERS = 64
#: Bytes of text a task encodes at a time, which bounds what it holds besides the batch it was given.
TEXT_BYTES = 1_500_000


class LibraryEncoder(ChunkEncoder):
    """As ``ChunkEncoder``, but the tokenizers library merges the pieces, and words met lately are not cut and merged again."""

    shared: dict[int, ChunkEncoder] = {}

    def _load(self, tokenizer: Tokenizer, model: dict) -> None:
        self.model = tokenizer.model  # the same one that normalises and cuts, and no tables beside it
        self.lately: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        return array("I", [token.id for token in self.model.tokenize(text)]).tobytes()

    def chunks(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for text in texts:
            ids = self.lately.get(text)
            if ids is None:
                ids = self.before.get(text)
                if ids is None:
                    ids = self.chunk(text)
                if len(text) <= MEMO_LETTERS:
                    if len(self.lately) >= MEMO_WORDS:
                        self.lately, self.before = {}, self.lately
                    self.lately[text] = ids
            found.append(ids)
        return joined_ids(found)


def ids_of_texts(encoder: ChunkEncoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other and their number per text. Each different word of the texts is encoded once."""
    if not pc.any(pc.match_substring(texts, "<|"), min_count=0).as_py():
        texts = pc.ascii_lower(texts)  # strings like special tokens must keep their case
    found = split_words(texts, after_letter=WORD_ENDS)
    coded = found.words.dictionary_encode()
    return ids_of_words(found, coded.indices.to_numpy(), *encoder.chunks(coded.dictionary.to_pylist()))


def token_pieces(frame: DataFrame, tokenizer_path: str, identity: str = "doc_id", text: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of the pieces of whole texts.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut, into pieces of that length and a rest. A null
    text is empty: one piece holding ``end_id``. The tokenizer's file is read on the driver and sent to the tasks. Columns other
    than the two named are not read; rows with a null id or repeated rows are cut like any other.
    """
    spark = frame.sparkSession
    ship_package(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        model = spark.sparkContext.broadcast(file.read())
    slim = frame.select(F.col(f"`{identity}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LibraryEncoder.of(model.value)
        for batch in batches:
            for first, rows in row_blocks(batch.column("text"), TEXT_BYTES):
                ids, sizes = ids_of_texts(encoder, batch.column("text").slice(first, rows))
                flat = np.insert(ids.astype("<u4"), np.cumsum(sizes), end_id)
                sizes = sizes + 1
                pieces = -(-sizes // capacity)
                owner = np.repeat(np.arange(rows), pieces)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(sizes[owner] - start, capacity)
                ends = np.cumsum(length)
                raw = memoryview(flat).cast("B")
                marks = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), length.tolist())]
                columns = [batch.column("doc_id").take(pa.array(first + owner)), pa.array(number.astype(np.int32)), pa.array(start),
                           pa.array(length), pa.array(marks, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)
            pa.default_memory_pool().release_unused()

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return slim.mapInArrow(run, schema + ", ids array<int>" * with_ids)


@dataclass
class Runs:
    """A plan: the pieces of a length, numbered, fall into runs of ``per`` neighbours in each of consecutive sequences."""

    length: list[int]
    first: list[int]
    sequence: list[int]
    offset: list[int]
    per: list[int]
    sequences: int = 0


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """How often to use which mix of sizes: the fractional optimum by column generation, or close to it."""
    count = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    used = inverse @ demand
    for _ in range(PRICING_ROUNDS):
        worth = inverse.sum(axis=0)
        best = np.zeros(capacity + 1)
        chosen = np.zeros((count, capacity + 1), np.int8)
        for g in range(count):
            if worth[g] <= 0:
                continue
            before = best.copy()
            for k in range(1, capacity // int(sizes[g]) + 1):
                offer = before[: capacity + 1 - k * sizes[g]] + k * worth[g]
                here = best[k * sizes[g] :]
                better = offer > here + 1e-12
                here[better] = offer[better]
                chosen[g, k * sizes[g] :][better] = k
        if best[capacity] <= 1 + 1e-7:
            break
        mix, room = np.zeros(count), capacity
        for g in range(count - 1, -1, -1):
            mix[g] = chosen[g, room]
            room -= int(mix[g]) * int(sizes[g])
        step = inverse @ mix
        open_rows = step > 1e-9
        ratios = np.where(open_rows, used / np.where(open_rows, step, 1), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        used -= ratios[out] * step
        used[out] = ratios[out]
        columns[:, out] = mix
        inverse[out] /= step[out]
        others = np.arange(count) != out
        inverse[others] -= np.outer(step[others], inverse[out])
    return [(columns[:, at].astype(np.int64), float(max(used[at], 0))) for at in range(count)]


def plan_packing(counts: dict[int, int], capacity: int) -> Runs:
    """Plan for pieces known by their lengths' counts only, so its size does not grow with the number of pieces.

    Pieces longer than LARGE_PART of the capacity are sorted and cut into groups of equal cardinality, lengths rounded up
    to the largest of the group; configurations of these few sizes are optimised and used in whole numbers. The longest
    pieces that fit then take the rounded places, the last of a sequence up to all room there is. What is left over and all small lengths go, longest first, to the fullest sequence with room.
    """
    runs = Runs([], [], [], [], [])
    taken = dict.fromkeys(counts, 0)
    rooms: dict[int, list[tuple[int, int]]] = {}  # free tokens to (first sequence, how many)
    order: list[int] = []

    def place(length: int, number: int, sequence: int, offset: int, per: int) -> None:
        for name, value in (("length", length), ("first", taken[length]), ("sequence", sequence), ("offset", offset), ("per", per)):
            getattr(runs, name).append(value)
        taken[length] += number

    def release(room: int, sequence: int, number: int) -> None:
        if room > 0 and number > 0:
            if room not in rooms:
                rooms[room] = []
                insort(order, room)
            rooms[room].append((sequence, number))

    if counts.get(capacity):
        place(capacity, counts[capacity], 0, 0, 1)
        runs.sequences = counts[capacity]
    left = {length: n for length, n in counts.items() if length < capacity and n}
    large = sorted((length for length in left if length > capacity * LARGE_PART), reverse=True)
    total = sum(left[length] for length in large)
    if total:
        # Walk the descending lengths; a group ends with its share of pieces and is as long as its first one.
        sizes, demand = [], []
        share, filled = -(-total // GROUPS), 0
        for length in large:
            rest = left[length]
            while rest:
                if filled % share == 0:
                    sizes.append(length)
                    demand.append(0)
                some = min(rest, share - filled % share)
                demand[-1] += some
                filled, rest = filled + some, rest - some
        # One length can fill several groups; these are one size to the configurations.
        merged: dict[int, int] = {}
        for size, number in zip(sizes, demand):
            merged[size] = merged.get(size, 0) + number
        open_lengths = sorted(large)
        group_sizes = np.array(list(merged))
        for mix, times in _configurations(group_sizes, np.array(list(merged.values()), float), capacity):
            bins = int(times + 1e-6)
            while bins > 0:
                # The longest pieces left that fit the rounded places; the last place may use all room there is.
                lengths: list[int] = []
                need: dict[int, int] = {}
                places = [int(group_sizes[g]) for g in range(len(group_sizes)) for _ in range(mix[g])]
                for nth, limit in enumerate(places):
                    limit = capacity - sum(lengths) if nth == len(places) - 1 else limit
                    at = bisect_right(open_lengths, limit) - 1
                    while at >= 0 and left[open_lengths[at]] <= need.get(open_lengths[at], 0):
                        at -= 1
                    if at >= 0:
                        lengths.append(open_lengths[at])
                        need[lengths[-1]] = need.get(lengths[-1], 0) + 1
                if not lengths:
                    break
                some = min([bins, *[left[length] // k for length, k in need.items()]])
                offset, sequence = 0, runs.sequences
                for length in lengths:
                    place(length, some, sequence, offset, 1)
                    offset += length
                for length, k in need.items():
                    left[length] -= some * k
                    if not left[length]:
                        open_lengths.remove(length)
                runs.sequences += some
                release(capacity - offset, sequence, some)
                bins -= some
    for length in sorted((length for length, n in left.items() if n), reverse=True):
        rest = left[length]
        while rest:
            at = bisect_left(order, length)
            if at < len(order):
                room = order[at]
                sequence, number = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(at)
            else:
                room, sequence = capacity, runs.sequences
                number = -(-rest // (capacity // length))
                runs.sequences += number
            per = min(room // length, rest)
            whole = min(number, rest // per)
            place(length, whole * per, sequence, capacity - room, per)
            rest -= whole * per
            release(room - per * length, sequence, whole)
            release(room, sequence + whole, number - whole)
    return runs


def pack(frame: DataFrame, length: str, order: Sequence[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset: where each row goes so that few sequences of at most ``capacity`` are filled.

    Only the counts per length, at most ``capacity`` of them, come to the driver; the plan made from them is a list of
    runs, sent to all tasks. Rows of equal length are numbered by hash ranges, so a length that most rows have is spread over tasks,
    and a row's number tells its place. Lengths must be from 1 to ``capacity``. Rows equal in ``order`` are
    interchangeable. Columns sequence_id and offset of the frame are replaced. An empty frame gives no rows.
    """
    spark = frame.sparkSession
    ship_package(spark)
    kept = [column for column in frame.columns if column.lower() not in ("sequence_id", "offset")]
    source = frame.select(*[F.col(f"`{column}`") for column in kept])
    counts = {int(row[0]): int(row[1]) for row in source.groupBy(F.col(f"`{length}`")).count().collect()}
    plan = spark.sparkContext.broadcast(plan_packing(counts, capacity))
    spread = source.withColumn("_range", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in order]), F.lit(RANK_RANGES)))
    ranked = running_sums(spread, [length], "_range", [F.col(f"`{c}`") for c in order], {"_rank": F.lit(1).cast("long")}).drop("_range")
    schema = StructType([*source.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        lengths, firsts, sequences, offsets, per = (
            np.array(x, np.int64) for x in (runs.length, runs.first, runs.sequence, runs.offset, runs.per)
        )
        by = np.lexsort((firsts, lengths))
        lengths, firsts, sequences, offsets, per = (x[by] for x in (lengths, firsts, sequences, offsets, per))
        for batch in batches:
            size = batch.column(length).to_numpy().astype(np.int64)
            rank = batch.column("_rank").to_numpy()
            at = np.empty(len(size), np.int64)
            for value in np.unique(size):
                a, b = np.searchsorted(lengths, [value, value + 1])
                here = size == value
                at[here] = a + np.searchsorted(firsts[a:b], rank[here], side="right") - 1
            nth = rank - firsts[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequences[at] + nth // per[at]), pa.array(offsets[at] + nth % per[at] * size)],
                [*kept, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids (at most CAPACITY of them) from rows with ids and offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))


def pack_documents(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces of all documents with their checksum and place; the ids themselves can be joined by doc_id and piece."""
    with small_batches(documents.sparkSession):
        pieces = stored(token_pieces(documents, tokenizer_path, with_ids=False), "token-pieces")
    return pack(pieces, "length", ["doc_id", "piece", "ids_crc32"])


def op3_packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Where every piece of every document goes."""
    import public_tokenizers

    return pack_documents(read(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))
