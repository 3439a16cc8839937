"""Byte-pair encoding through the transducer against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import struct

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusmill.llm import lexicon
from corpusmill.llm.byte_words import split_words
from corpusmill.llm.merges import ChunkEncoder, row_blocks

PATH = public_tokenizers.path(lexicon.TOKENIZER)
LETTERS = [
    "a", "b", "The", "th", "'s", "'S", "'ll", "é", "É", "é", "İ", "ß", "Σ", "ς", "1", "²", "½", "\x85", "\xa0", "\x1c", "\x00", "日本",
    "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "<|startoftext|>", "한", "가", "😀", "‍", "̀", ".", ",", "-", "_", " ", "\n", "\t", "ﬁ", "ा", "क",
]


def strange_texts(count):
    chance = random.Random(3)
    texts = ["".join(chance.choice(LETTERS) for _ in range(chance.randrange(25))) for _ in range(count)]
    return [None, "", " \n", "a" * 5000, "ab" * 3000, "".join(chance.choice("abcdefgh") for _ in range(5000)), "the cat " * 20_000, *texts]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def plain(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_words_are_runs_between_marks():
    import re

    chance = random.Random(1)
    for _ in range(200):
        texts = [None if chance.random() < 0.1 else "".join(chance.choice("ab é\n.,\t") for _ in range(chance.randrange(12)))
                 for _ in range(chance.randrange(6))]
        found = split_words(pa.array(texts, pa.string()), b" \t", b".,\n")
        expected = [(row, word, at == 0) for row, text in enumerate(texts) for piece in re.split("[.,\n]", text or "")
                    for at, word in enumerate(re.findall("[^ \t]+", piece))]
        assert list(zip(found.row.tolist(), found.words.to_pylist(), found.opens.tolist())) == expected
        assert found.counts.tolist() == [sum(row == at for row, *_ in expected) for at in range(len(texts))]


def test_automaton_numbers_its_words_and_shares_suffixes():
    chance = random.Random(2)
    words = sorted({"".join(chance.choice("abc") for _ in range(chance.randrange(1, 9))).encode() for _ in range(900)} | {"naïve,".encode()})
    found = lexicon.Lexicon.build({word: struct.pack("<I", at) for at, word in enumerate(words)})
    asked = [word.decode() for word in words] + ["", "abcabcabcabc", "x", "ab,"]
    expected = [words.index(text.encode()) if text.encode() in words else -1 for text in asked]
    assert found.numbers(pa.array(asked, pa.large_string())).tolist() == expected
    assert found.pool[found.first[:-1]].tolist() == list(range(len(words)))
    # Words with common endings only need one path for them.
    shared = lexicon.minimal_automaton(sorted(a + b"ing" for a in (b"go", b"do", b"see", b"be")))
    assert len(shared[0]) == 10  # g d s b, then e, o and ing once
    assert lexicon.Lexicon.build({}).numbers(pa.array(["a"], pa.large_string())).tolist() == [-1]


def test_mapped_file_holds_the_same(tmp_path):
    built = lexicon.Lexicon.build({b"one": b"\1\0\0\0\2\0\0\0", b"two": b"", b"twos": b"\3\0\0\0"})
    built.write(str(tmp_path / "lexicon.bin"))
    mapped = lexicon.Lexicon.map(str(tmp_path / "lexicon.bin"))
    assert mapped.pool.tolist() == [1, 2, 3] and mapped.first.tolist() == [0, 2, 2, 3]
    assert mapped.numbers(pa.array(["two", "twos", "on"], pa.large_string())).tolist() == [1, 2, -1]


def test_merging_equals_the_library(tokenizer):
    with open(PATH, encoding="utf-8") as file:
        encoder = ChunkEncoder(file.read())
    chance = random.Random(5)
    for size in [*range(1, 60), 199, 200, 201, 3000]:
        word = "".join(chance.choice("aeinrsth") for _ in range(size))
        expected = tokenizer.encode(word, add_special_tokens=False).ids
        ids = [encoder.inner[letter] for letter in word[:-1]] + [encoder.last[word[-1]]]
        assert encoder._merged(list(ids)) == encoder._merged_long(list(ids)) == expected


@pytest.mark.parametrize("limit", [0, 40, lexicon.LEXICON_CHUNKS])
def test_ids_and_decoded_texts_equal_the_library(spark, tokenizer, limit):
    texts = strange_texts(600)
    frame = spark.createDataFrame([(at, text, "x", 7) for at, text in enumerate(texts)], "doc_id long, text string, ids string, chunk int")
    encoded = lexicon.encode(frame.repartition(3), PATH, limit=limit)
    assert encoded.columns == ["doc_id", "n_tokens", "ids", "ids_sha256"]
    rows = {row.doc_id: row for row in lexicon.decode(encoded, PATH).collect()}
    for at, text in enumerate(texts):
        row = rows[at]
        assert (row.n_tokens, row.ids_sha256, hashlib.sha256(row.decoded.encode()).hexdigest()) == plain(tokenizer, text)


def test_frequent_chunks_stay_below_the_limit(spark):
    frame = spark.createDataFrame([("a a a a a a a a b b b b c",)] * 3, "text string")
    counts = lexicon.chunk_counts(frame)
    assert {row.chunk: row.n for row in counts.collect()} == {"a": 24, "b": 12, "c": 3}
    assert {row.chunk for row in lexicon.frequent_chunks(counts, 1).collect()} == {"a"}
    assert {row.chunk for row in lexicon.frequent_chunks(counts, 9).collect()} == {"a", "b"}  # c is met less than LEAST_COUNT times
    assert lexicon.frequent_chunks(counts, 0).count() == 0


def test_empty_table_repeated_rows_null_ids_and_unknown_tokens(spark):
    schema = "doc_id long, text string"
    assert lexicon.decode(lexicon.encode(spark.createDataFrame([], schema), PATH), PATH).count() == 0
    rows = lexicon.encode(spark.createDataFrame([(None, "the cat"), (None, "the cat"), (1, None)], schema), PATH).collect()
    assert sorted((row.doc_id or 0, row.n_tokens) for row in rows) == [(0, 2), (0, 2), (1, 0)]
    odd = spark.createDataFrame([(1, [320, None, -5, 99_999, 49_407], "old"), (2, None, "old"), (3, [], "old")], "doc_id long, ids array<int>, decoded string")
    assert {row.doc_id: row.decoded for row in lexicon.decode(odd, PATH).collect()} == {1: "a</w> <|endoftext|>", 2: "", 3: ""}


def test_blocks_cover_all_rows(monkeypatch):
    monkeypatch.setattr("corpusmill.llm.merges.BLOCK_BYTES", 10)
    assert row_blocks(pa.array([], pa.string())) == []
    blocks = row_blocks(pa.array(["abc", None, "d" * 50, "", "efghijkl", "m"]))
    assert [at for start, rows in blocks for at in range(start, start + rows)] == list(range(6)) and len(blocks) > 1


def test_query_over_the_whole_table(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    rows = {row.doc_id: row for row in lexicon.op13_bpe(spark, folder).collect()}
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(documents)
    for document in documents:
        row = rows[document.doc_id]
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == plain(tokenizer, document.text)


def test_chunks_are_counted_in_small_blocks():
    """What a task holds while it counts is bounded by bytes, not by the rows of a batch."""
    sizes = []

    class Frame:
        sparkSession = None

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            batch = pa.RecordBatch.from_arrays([pa.array(["ab cd " * 50_000] * 20)], ["text"])
            sizes.extend(sum(out.column(1).to_pylist()) for out in run(iter([batch])))
            return self

        groupBy = agg = select

    import unittest.mock

    with unittest.mock.patch.object(lexicon, "ship_package"), unittest.mock.patch.object(lexicon, "F"):
        lexicon.chunk_counts(Frame())
    assert sum(sizes) == 2_000_000 and max(sizes) * 3 <= lexicon.TEXT_BYTES
