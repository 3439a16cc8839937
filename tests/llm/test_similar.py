"""Near copies of the pipeline against brute force on five-word shingles."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.llm import similar
from corpusmill.session import BATCH_BYTES
from tests.llm.test_simhash import plain_fingerprint


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[at : at + 5]) for at in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    sets = [plain_shingles(text) for text in texts]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            same = sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            if same and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return root


def sample():
    chance = random.Random(4)
    vocabulary = [f"w{k}" for k in range(900)]
    base = [chance.choices(vocabulary, k=chance.randrange(40, 160)) for _ in range(30)]
    out = [None, "", " \n", "One", "one", "one two", "a b c d e", "a b c d e f"] + [" ".join(words) for words in base]
    for words in base:
        # Copies of copies: shared parts from about 0.5 to 1, so that chains, far members and wrong candidates occur.
        for _ in range(8):
            changed = list(words)
            for _ in range(chance.randrange(1, 4)):
                changed[chance.randrange(len(changed))] = chance.choice(vocabulary)
            out.append(" ".join(changed))
            words = changed if chance.random() < 0.4 else words
    chance.shuffle(out)
    return out


def test_stage_links_all_similar_texts_and_no_others(spark):
    texts = sample()
    root = plain_groups(texts)
    prints = [plain_fingerprint(text) for text in texts]
    # Linked by their words, but not by fingerprints of at most 3 differing bits.
    assert any(root[a] == root[b] and (prints[a] ^ prints[b]).bit_count() > 3 for a in range(len(texts)) for b in range(a))
    frame = spark.createDataFrame([(at, text, "kept") for at, text in enumerate(texts)], "doc_id long, text string, _root string")
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame.repartition(5), "")
    assert got.columns == frame.columns
    assert sorted(row.doc_id for row in got.collect()) == sorted(set(root))


def test_similarity_is_exact():
    for a, b in zip(sample()[:120], sample()[1:]):
        x, y = plain_shingles(a), plain_shingles(b)
        want = len(x & y) / len(x | y) if x & y else 0.0
        assert similar.similarity(similar.shingles(a), similar.shingles(b)) == want


def test_pairs_of_different_groups_are_proposed():
    signs = np.zeros((4, similar.HASHES), np.uint16)
    signs[1, :10], signs[2, :20], signs[3] = 1, 2, 3
    pairs = lambda roots, width: sorted((int(a), int(b)) for x, y in similar._compare(
        signs[1:], signs, np.array(roots), np.array(roots[1:]), width) for a, b in zip(x + 1, y))
    assert pairs([0, 1, 2, 3], None) == [(1, 0), (1, 2), (2, 0), (2, 1)]
    assert pairs([0, 1, 2, 3], 1) == [(1, 0), (2, 0)]
    assert pairs([0, 0, 2, 3], None) == [(1, 2), (2, 0), (2, 1)]
    assert pairs([0, 0, 0, 3], None) == []


def chained(count, words=60, seed=8):
    """Texts each of which is similar to the one before, but not to those further off."""
    chance = random.Random(seed)
    text = [f"v{chance.randrange(9000)}" for _ in range(words)]
    out = []
    for at in range(count):
        out.append(" ".join(text))
        text = list(text)
        text[at * 7 % words] = f"n{at}"
    return out


def test_buckets_larger_than_a_part_and_many_wrong_candidates(spark, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK", 7)
    monkeypatch.setattr(similar, "VERIFIED", 5)
    monkeypatch.setattr(similar, "NEAREST", 1)
    monkeypatch.setattr(similar, "LEAST_EQUAL", 40)
    texts = chained(60) + sample()[:80]
    root = plain_groups(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(row.doc_id for row in similar.keep_one_similar(frame).collect()) == sorted(set(root))


def test_last_step_checks_each_pair_once(spark):
    """The last step alone, on all buckets: each link once, and all of them."""
    texts = chained(40, seed=3) + sample()[:100]
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    marked = similar.with_signature(frame.withColumn("row", F.col("node")), "mark", "signed")
    rows = marked.select(F.col("mark").alias("node"), "signed", "text")
    signs = rows.filter("signed IS NOT NULL").groupBy("node").agg(F.first("signed").alias("signed"))
    members = signs.mapInArrow(similar._bands, "bucket long, node long")
    sets = rows.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(similar._sets, "node long, found binary")
    known = signs.select("node", F.col("node").alias("root"))
    links = similar._crossing(members, known, signs.join(sets, "node"), 9).mapInArrow(similar._verifier(0.8), "a long, b long").collect()
    assert len(links) == len({frozenset(link) for link in links})
    nodes = {row.row: row.mark for row in marked.collect()}
    linked = {frozenset(link) for link in links}
    for a in range(len(texts)):
        for b in range(a):
            x, y = plain_shingles(texts[a]), plain_shingles(texts[b])
            if x and y and nodes[a] != nodes[b]:
                assert (frozenset((nodes[a], nodes[b])) in linked) == (len(x & y) >= 0.8 * len(x | y))


def test_links_of_fingerprints_are_found_without_bands_and_checked(spark, monkeypatch):
    def no_bands(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], ["bucket", "node"])

    monkeypatch.setattr(similar, "_bands", no_bands)
    chance = random.Random(6)
    texts = []
    for _ in range(12):
        words = [f"w{chance.randrange(5000)}" for _ in range(300)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(["other", *words[1:]])]
    texts += ["a b c", "a b c d"]
    prints = [plain_fingerprint(text) for text in texts]
    sets = [plain_shingles(text) for text in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root = [min(root[a], root[b]) if r == max(root[a], root[b]) else r for r in root]
    assert len(set(root)) < len(texts) - 10
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(row.doc_id for row in similar.keep_one_similar(frame).collect()) == sorted(set(root))


def test_crowded_fingerprints_are_tied_by_fewer_pairs_than_nodes(spark):
    """Fingerprints that are all linked with each other have a link for many choices of blocks; what is checked first does not grow with these."""
    from itertools import combinations

    marks = [sum(1 << bit for bit in bits) for size in (0, 1, 2) for bits in combinations(range(24), size)]
    rows = spark.createDataFrame([(7 * at, mark) for at, mark in enumerate(marks)] + [(-1, marks[5])], "node long, fingerprint long")
    tied, linked = similar._fingerprint_links(rows)
    pairs = tied.collect()
    assert len(pairs) <= len(marks) and len({row.group for row in pairs}) == 1
    assert {row.a for row in pairs} | {row.b for row in pairs} == {row.node for row in rows.collect()}
    assert linked.count() > len(marks)


def test_sets_and_texts_come_to_workers_in_small_batches(spark, monkeypatch):
    key, seen, write = "spark.sql.execution.arrow.maxBytesPerBatch", [], similar.stored
    before = spark.conf.get(key, None)
    monkeypatch.setattr(similar, "stored", lambda frame, purpose: seen.append((purpose, spark.conf.get(key, None))) or write(frame, purpose))
    text = "one two three four five six seven eight nine ten"
    frame = spark.createDataFrame([(1, text), (2, text), (3, "others altogether")], "doc_id long, text string")
    assert sorted(row.doc_id for row in similar.keep_one_similar(frame).collect()) == [1, 3]
    assert {"shingled", "similar-sets"} <= {purpose for purpose, _ in seen} and {size for _, size in seen} == {str(BATCH_BYTES)}
    assert spark.conf.get(key, None) == before


def starred(count, words=149, seed=5):
    """Texts that differ from one text in 1 to 9 words, so many pairs of them are just not similar enough."""
    chance = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = chance.choices(vocabulary, k=words)
    out = []
    for _ in range(count):
        text = list(base)
        for at in chance.sample(range(words), chance.randrange(1, 10)):
            text[at] = chance.choice(vocabulary)
        out.append(" ".join(text))
    return out


def test_rounds_write_no_more_pairs_than_texts_ask(spark, monkeypatch):
    seen, write = [], similar.stored

    def counted(frame, purpose):
        out = write(frame, purpose)
        seen.append((purpose, out.count()))
        return out

    monkeypatch.setattr(similar, "stored", counted)
    texts = starred(150)
    root = plain_groups(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(row.doc_id for row in similar.keep_one_similar(frame).collect()) == sorted(set(root))
    # After ties, links of fingerprints and smallest members come the rounds.
    pairs = [rows for purpose, rows in seen if purpose == "similar-pairs"][3:]
    assert pairs and pairs[0] > 0 and max(pairs) <= len(texts)
    assert [purpose for purpose, _ in seen].count("similar-asked") == 3 + len(pairs)


def test_parts_of_a_round_copy_no_row_more_than_once(spark):
    rows = [(1, node) for node in range(90)]
    members = spark.createDataFrame(rows, "bucket long, node long")
    known = spark.createDataFrame([(node, node % 30) for _, node in rows], "node long, root long")
    signs = spark.createDataFrame([(node, b"") for _, node in rows], "node long, signed binary")
    turns = [similar._crossing(members, known, signs, 7, turn).collect() for turn in (0, 1)]
    for got in turns:
        assert sorted(row.node for row in got if not row.asks) == list(range(90))
        assert sorted(row.node for row in got if row.asks) == sorted(row.node for row in got if not row.asks and row.stray)
        assert all(row.asks_part == row.held_part for row in got) and len({row.held_part for row in got}) > 5
    placed = [{row.node: row.held_part for row in got} for got in turns]
    assert placed[0] != placed[1]
