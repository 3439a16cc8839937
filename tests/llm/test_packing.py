"""Tokens, plans and packed sequences."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import packing
from corpusmill.llm.merges import ChunkEncoder
from corpusmill.llm.packing import TOKENIZER, ids_of_texts, op3_packed_sequences, pack, pack_documents, plan_packing, sequences, token_pieces
from corpusmill.session import BATCH_BYTES, small_batches

PATH = public_tokenizers.path(TOKENIZER)
TEXTS = [
    None, "", " \n ", "Hello, world... it's I'll 123 !!! 's", "Größe ÄÖÜ éà", "a <|startoftext|> b <|ENDOFTEXT|>", "ΣΑΣ İstanbul ǅ", "x\x1cy\x85z\xa0w",
    "é ﬁ ½ ² ª", "don't don't, DON'T.", "word " * 3000, "z" * 5000, "日本語 テキスト", "...", "a.b,c", "it's.", "\x00 \x7f",
]


def test_ids_are_the_tokenizers(spark):
    chance = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñçÀÉ.,'!?-0123456789"
    given = TEXTS + [" ".join("".join(chance.choices(letters, k=chance.randrange(1, 9))) for _ in range(200)) for _ in range(30)]
    tokenizer = Tokenizer.from_file(PATH)
    with open(PATH, encoding="utf-8") as file:
        encoder = ChunkEncoder(file.read())
    for texts in (given, [text for text in given if "<|" not in (text or "")], [None, ""], []):
        ids, sizes = ids_of_texts(encoder, pa.array(texts, pa.string()))
        got = [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []
        assert got == [tokenizer.encode(text or "", add_special_tokens=False).ids for text in texts]


def check_plan(counts, capacity):
    runs = plan_packing(counts, capacity)
    by_length = defaultdict(list)
    for at, length in enumerate(runs.length):
        by_length[length].append((runs.first[at], runs.sequence[at], runs.offset[at], runs.per[at]))
    used = defaultdict(list)
    for length, number in counts.items():
        found = sorted(by_length[length])
        for at, (first, sequence, offset, per) in enumerate(found):
            end = found[at + 1][0] if at + 1 < len(found) else number
            for nth in range(end - first):
                used[sequence + nth // per].append((offset + nth % per * length, length))
    assert sum(map(len, used.values())) == sum(counts.values()) and len(used) == runs.sequences
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return runs.sequences


def test_plans_are_valid_and_close_to_the_bound():
    chance = random.Random(6)
    for capacity, size in ((10, 3), (64, 200), (2048, 4000), (2048, 1)):
        counts = Counter(min(capacity, max(1, int(chance.lognormvariate(np.log(capacity / 3), 1)))) for _ in range(size))
        used, bound = check_plan(counts, capacity), -(-sum(k * n for k, n in counts.items()) // capacity)
        assert used <= bound * 1.03 + 2, (capacity, used, bound)
    assert check_plan({2048: 5, 1025: 7, 1024: 3}, 2048) == 5 + 7 + 2
    assert check_plan({1: 100_000, 2047: 10}, 2048) == 59
    assert plan_packing({}, 2048).sequences == 0


def test_packed_documents(spark, tmp_path):
    rows = [(at, text, "x") for at, text in enumerate(TEXTS * 3)] + [(None, "no id", "x"), (0, "again", "x"), (0, "again", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for doc, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4")
            want[doc, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    got = op3_packed_sequences(spark, str(tmp_path)).collect()
    assert Counter(tuple(row)[:5] for row in got) == want
    places = defaultdict(list)
    for row in got:
        places[row.sequence_id].append((row.offset, row["length"]))
    for found in places.values():
        found.sort()
        assert [offset for offset, _ in found] == [sum(n for _, n in found[:at]) for at in range(len(found))]
        assert sum(n for _, n in found) <= 2048


def test_sequences_hold_the_pieces(spark):
    pieces = token_pieces(spark.createDataFrame([(1, "a b c"), (2, "d e " * 2000)], "doc_id long, text string"), PATH)
    packed = pack(pieces.withColumn("sequence_id", F.lit(9)), "length", ["doc_id", "piece", "ids_crc32"])
    tokenizer = Tokenizer.from_file(PATH)
    ids = [*tokenizer.encode("d e " * 2000, add_special_tokens=False).ids, 0]
    found = {tuple(row.ids) for row in sequences(packed).collect()}
    assert tuple(ids[:2048]) in found and sum(map(len, found)) == len(ids) + 4


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op3_packed_sequences(spark, str(tmp_path)).collect() == []


def test_the_library_merges_and_words_met_lately_are_not_merged_again(monkeypatch):
    from corpusmill.llm import packing

    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        encoder = packing.LibraryEncoder(file.read())
    library = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    library.no_truncation()
    monkeypatch.setattr(packing, "MEMO_WORDS", 4)
    merged = []
    monkeypatch.setattr(encoder, "chunk", lambda text: merged.append(text) or ChunkEncoder.chunk(encoder, text))
    words = ["straße", "isn't", "x" * 70, "naïve", "12.5", "<|endoftext|>a", "e\u0301t\u00e9", "#日本", "isn't", "naïve", "x" * 70]
    pool, first = encoder.chunks(words)
    for at, word in enumerate(words):
        assert pool[first[at] : first[at + 1]].tolist() == library.encode(word, add_special_tokens=False).ids
    assert merged.count("isn't") == merged.count("naïve") == 1 and len(encoder.lately) <= 4


def batch_sizes(frame):
    """Rows and bytes of each batch that a Python worker is given."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    return frame.mapInArrow(run, "rows long, bytes long")


def test_small_batches_bound_what_a_worker_is_given(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    frame = batch_sizes(spark.range(0, 3000, 1, 1).select(F.expr("if(id = 1500, repeat('y', 200000), repeat('x', 1000))").alias("text")))
    assert [row.rows for row in frame.collect()] == [3000]
    with small_batches(spark, 100_000):
        found = frame.collect()
    assert sum(row.rows for row in found) == 3000 and sorted(row.bytes for row in found)[-2] < 150_000
    assert spark.conf.get(key, None) == before
    assert [row.rows for row in frame.collect()] == [3000]


def test_documents_come_to_the_encoder_in_small_batches(spark, monkeypatch):
    given = []

    def pieces(frame, *args, **options):
        given.extend(batch_sizes(frame.select("text")).collect())
        return token_pieces(frame, *args, **options)

    monkeypatch.setattr(packing, "token_pieces", pieces)
    frame = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('to be ', 600)").alias("text"))
    packed = pack_documents(frame, PATH)
    assert len(given) > 1 and max(row.bytes for row in given) < 1.5 * BATCH_BYTES
    assert packed.count() == 3000


def test_the_library_encoder_keeps_no_tables_beside_the_library():
    with open(PATH, encoding="utf-8") as file:
        encoder = packing.LibraryEncoder(file.read())
    assert not {"rank", "made", "inner", "last", "memo"} & set(vars(encoder))
    tokenizer = Tokenizer.from_file(PATH)
    for text in TEXTS[3:]:
        assert np.frombuffer(b"".join(map(encoder.chunk, text.split())), "<u4").tolist() == [
            number for word in text.split() for number in tokenizer.encode(word, add_special_tokens=False).ids]
