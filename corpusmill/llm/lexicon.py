"""Byte-pair encoding through a minimal acyclic transducer of frequent chunks, and decoding."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.byte_words import split_words
from corpusmill.llm.common import read, ship_package, stored
from corpusmill.llm.merges import ChunkEncoder, ids_of_words, row_blocks

TOKENIZER = "word_bpe_49k.json"
#: Chunks the transducer holds at most, and the longest of them in bytes: both bound what is sent to tasks. All others are merged.
LEXICON_CHUNKS = 131_072
LONGEST_CHUNK = 48
#: Chunks met less often than this are merged where they stand; classes of counts a doubling is cut into.
LEAST_COUNT = 4
COUNT_STEPS = 4
#: Bytes of text a task counts or encodes at a time, and ids it decodes: what it holds besides the batch it was given.
TEXT_BYTES = 1_500_000
IDS = 500_000


def chunk_counts(frame: DataFrame, text: str = "text") -> DataFrame:
    """chunk, n: all runs between ASCII white space and how often they occur, but for those longer than LONGEST_CHUNK bytes."""
    ship_package(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows in row_blocks(batch.column(0), TEXT_BYTES):
                words = split_words(batch.column(0).slice(start, rows)).words
                found = words.filter(pc.less_equal(pc.binary_length(words), LONGEST_CHUNK)).dictionary_encode()
                counts = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
                yield pa.RecordBatch.from_arrays([found.dictionary.cast(pa.string()), pa.array(counts.astype(np.int64))], ["chunk", "n"])
            pa.default_memory_pool().release_unused()

    counted = frame.select(F.col(f"`{text}`")).mapInArrow(run, "chunk string, n long")
    return counted.groupBy("chunk").agg(F.sum("n").alias("n"))


def frequent_chunks(counts: DataFrame, limit: int = LEXICON_CHUNKS) -> DataFrame:
    """The most frequent chunks: all above the lowest class of counts for which they are at most ``limit``."""
    step = F.floor(F.log2("n") * COUNT_STEPS).cast("int")
    sizes = {row[0]: row[1] for row in counts.filter(F.col("n") >= LEAST_COUNT).groupBy(step).count().collect()}
    room, least = limit, None
    for at in sorted(sizes, reverse=True):
        room -= sizes[at]
        if room < 0:
            break
        least = at
    return counts.filter(F.lit(False) if least is None else (F.col("n") >= LEAST_COUNT) & (step >= least))


def minimal_automaton(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys (state * 256 + byte), targets, outputs of all arcs and final marks of the states, from sorted different words.

    Words are added in order; what a new word can't extend any more is looked up in a register of states, so equal suffixes
    are one path. The outputs along a word's path add up to its number in the order. The start is state 0.
    """
    register: dict[tuple, int] = {}
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    reach = [0]  # words that end on paths from a state, once it is registered
    path: list[int] = [0]  # states of the word added last
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            same = register.setdefault((final[state], *arcs[state].items()), state)
            if same == state:
                reach[state] = final[state] + sum(reach[to] for to in arcs[state].values())
            else:
                arcs[path[-1]][last[len(path) - 1]] = same
                free.append(state)

    free: list[int] = []
    for word in words:
        shared = len(os.path.commonprefix([word, last]))
        close(shared)
        for byte in word[shared:]:
            if free:
                state = free.pop()
                arcs[state], final[state] = {}, False
            else:
                state = len(arcs)
                arcs.append({})
                final.append(False)
                reach.append(0)
            arcs[path[-1]][byte] = state
            path.append(state)
        final[path[-1]] = True
        last = word
    close(0)
    keys, targets, outputs = [], [], []
    for state in {0, *register.values()}:
        number = int(final[state])
        for byte, to in sorted(arcs[state].items()):
            keys.append(state << 8 | byte)
            targets.append(to)
            outputs.append(number)
            number += reach[to]
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return (np.array(keys, np.int64)[order], np.array(targets, np.int32)[order], np.array(outputs, np.int32)[order], np.array(final, bool))


@dataclass
class Lexicon:
    """Transducer from chunks to their token ids; its arrays may lie in a memory-mapped file."""

    keys: np.ndarray
    targets: np.ndarray
    outputs: np.ndarray
    final: np.ndarray
    first: np.ndarray
    pool: np.ndarray

    #: Files opened by this worker process.
    opened: dict[str, Lexicon] = None  # type: ignore[assignment]

    @classmethod
    def build(cls, ids: dict[bytes, bytes]) -> Lexicon:
        """From chunks to their ids as little-endian 32-bit numbers."""
        words = sorted(ids)
        first = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(ids[word]) // 4 for word in words], out=first[1:])
        return cls(*minimal_automaton(words), first, np.frombuffer(b"".join(ids[word] for word in words), "<u4"))

    def write(self, path: str) -> None:
        """All arrays one after the other, each with its header."""
        with open(path, "wb") as file:
            for array in (self.keys, self.targets, self.outputs, self.final, self.first, self.pool):
                np.lib.format.write_array(file, array)

    @classmethod
    def map(cls, path: str) -> Lexicon:
        """The file's arrays, read where they are touched."""
        arrays = []
        with open(path, "rb") as file:
            for _ in range(6):
                np.lib.format.read_magic(file)
                shape, _, kind = np.lib.format.read_array_header_1_0(file)
                size = shape[0] * kind.itemsize
                arrays.append(np.memmap(path, kind, "r", file.tell(), shape) if size else np.zeros(0, kind))
                file.seek(size, os.SEEK_CUR)
        return cls(*arrays)

    @classmethod
    def shipped(cls, name: str) -> Lexicon:
        """The file sent to this machine under the name, mapped once per process."""
        if not cls.opened or name not in cls.opened:
            cls.opened = {name: cls.map(SparkFiles.get(name))}
        return cls.opened[name]

    def numbers(self, chunks: pa.LargeStringArray) -> np.ndarray:
        """Place of each chunk among the lexicon's, -1 for others. All chunks walk at once, a byte at a time."""
        count = len(chunks)
        out = np.full(count, -1, np.int64)
        if not count or not len(self.keys):
            return out
        offsets = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + count + 1]
        data = np.frombuffer(chunks.buffers()[2], np.uint8)
        sizes = np.diff(offsets)
        active = np.flatnonzero((sizes > 0) & (sizes <= LONGEST_CHUNK))
        state, number, at = np.zeros(len(active), np.int64), np.zeros(len(active), np.int64), 0
        while len(active):
            key = state << 8 | data[offsets[active] + at]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[arc] == key
            active, arc = active[there], arc[there]
            state, number, at = self.targets[arc].astype(np.int64), number[there] + self.outputs[arc], at + 1
            ended = sizes[active] == at
            good = ended & self.final[state]
            out[active[good]] = number[good]
            active, state, number = active[~ended], state[~ended], number[~ended]
        return out


def ship_lexicon(frame: DataFrame, model: str, text: str = "text", limit: int = LEXICON_CHUNKS) -> str:
    """Builds the lexicon of the frame's frequent chunks and sends its file to all machines; gives its name there.

    The driver receives at most ``limit`` chunks of bounded length with their ids.
    """
    spark = frame.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    counts = stored(chunk_counts(frame, text), "chunk-counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.of(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(encoder.chunk, batch.column(0).to_pylist()), pa.binary())], ["chunk", "ids"])

    found = frequent_chunks(counts, limit).select("chunk").mapInArrow(run, "chunk string, ids binary").toArrow()
    lexicon = Lexicon.build({chunk.encode(): ids for chunk, ids in zip(found.column(0).to_pylist(), found.column(1).to_pylist())})
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="corpusmill-lexicon-"), name)
    lexicon.write(path)
    spark.sparkContext.addFile(path)
    return name


def encode(frame: DataFrame, tokenizer_path: str, identity: str = "doc_id", text: str = "text", limit: int = LEXICON_CHUNKS) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256: token ids of whole texts, without special tokens added.

    A null text is empty and has no ids; the digest is of the ids as little-endian unsigned 32-bit numbers. Chunks in the
    lexicon get their ids from it, all others are merged. Repeated rows, null ids and texts of any length are rows like any other;
    columns other than the two named are not read. An empty table gives no rows.
    """
    spark = frame.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        model = file.read()
    slim = frame.select(F.col(f"`{identity}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    name = ship_lexicon(slim, model, limit=limit)
    shared = spark.sparkContext.broadcast(model)
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lexicon = ChunkEncoder.of(shared.value), Lexicon.shipped(name)
        known = len(lexicon.first) - 1
        for batch in batches:
            for start, rows in row_blocks(batch.column("text"), TEXT_BYTES):
                part = batch.slice(start, rows)
                found = split_words(part.column("text"))
                coded = found.words.dictionary_encode()
                chunks = coded.dictionary
                numbers = lexicon.numbers(chunks)
                unseen = np.flatnonzero(numbers < 0)
                pool, first = encoder.chunks(chunks.take(pa.array(unseen)).to_pylist())
                numbers[unseen] = known + np.arange(len(unseen))
                ids, sizes = ids_of_words(
                    found, numbers[coded.indices.to_numpy()], np.concatenate([lexicon.pool, pool]),
                    np.concatenate([lexicon.first, lexicon.first[-1] + first[1:]]),
                )
                ends = np.zeros(rows + 1, np.int64)
                np.cumsum(sizes, out=ends[1:])
                raw = memoryview(ids.astype("<u4")).cast("B")
                digests = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends.tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32))), pa.array(digests, pa.string())],
                    ["doc_id", "n_tokens", "ids", "ids_sha256"],
                )

    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, ids_sha256 string")


def decode(frame: DataFrame, tokenizer_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The frame with the column ``ids`` replaced by ``decoded``: the ids' tokens joined by blanks, special ones included.

    Null ids or ids outside the vocabulary have no token and are left out; null or empty lists give an empty text.
    A column that already has the name of ``decoded`` is replaced.
    """
    spark = frame.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        model = spark.sparkContext.broadcast(file.read())
    kept = [column for column in frame.columns if column.lower() not in (ids.lower(), decoded.lower())]
    slim = frame.select(*[F.col(f"`{column}`") for column in kept], F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias("_ids"))
    schema = slim.drop("_ids").schema.add(decoded, "string")
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(model.value)
        for batch in batches:
            lists = batch.column(len(kept))
            step = max(1, IDS * len(lists) // max(len(lists.flatten()), 1))  # bounds what is held besides the batch
            for start in range(0, len(lists), step):
                part = lists.slice(start, step)
                flat = part.flatten()
                known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens)))
                words = tokens.take(pc.if_else(pc.fill_null(known, False), flat, None))
                ends = np.append(0, np.cumsum(pc.list_value_length(part).to_numpy(zero_copy_only=False))).astype(np.int32)
                if words.null_count:
                    good = words.is_valid().to_numpy(zero_copy_only=False)
                    ends = np.append(0, np.cumsum(good))[ends].astype(np.int32)
                    words = words.drop_null()
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words), " ")
                yield pa.RecordBatch.from_arrays([*[column.slice(start, step) for column in batch.columns[:-1]], texts], schema.names)

    return slim.mapInArrow(run, schema)


_VOCABULARIES: dict[int, pa.StringArray] = {}


def vocabulary(model: str) -> pa.StringArray:
    """Token of each id, null where there is none; kept per process."""
    if hash(model) not in _VOCABULARIES:
        import json

        parts = json.loads(model)
        found = dict(map(reversed, parts["model"]["vocab"].items())) | {token["id"]: token["content"] for token in parts["added_tokens"]}
        _VOCABULARIES.clear()
        _VOCABULARIES[hash(model)] = pa.array([found.get(at) for at in range(max(found, default=-1) + 1)], pa.string())
    return _VOCABULARIES[hash(model)]


def op13_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    import public_tokenizers

    path = public_tokenizers.path(TOKENIZER)
    decoded = decode(encode(read(spark, folder, "documents"), path), path)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
