"""Lexical queries, search, fusion and reranking against brute force."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions.lexical_query import build_lexical_query, general_query, legal_query
from corpusmill.operators import blocks, dense, lexical_search
from corpusmill.operators.dense import dense_topk
from corpusmill.operators.embed import EmbeddingConfigMismatch, model_embedding, validate_config
from corpusmill.operators.fusion import fuse
from corpusmill.operators.lexical_index import analyzed, postings, term_statistics, vocabulary
from corpusmill.operators.lexical_search import bm25_topk, filter_only_topk, fts_topk
from corpusmill.operators.rerank import model_pair_score, rerank
from corpusmill.operators.retrieve import RetrievalSettings, resolve_requests, retrieve

DSA = "What is the primary aim of the Digital Services Act according to Article 1?"


def built(spark, builder, question):
    return spark.range(1).select(builder(F.lit(question)).alias("q")).select("q.*").first()


def test_general_query(spark):
    q = built(spark, general_query, DSA)
    assert (q.article_number, q.clause_number) == ("1", None)
    assert q.tsquery_text == "primary | aim | digital | services | act | according"
    assert q.match_text == "primary aim digital services act according"


def test_legal_query(spark):
    assert built(spark, legal_query, DSA).tsquery_text == "primary | aim"
    q = built(spark, legal_query, "What types of services are excluded from the scope of this Regulation according to Article 2, Clause 2?")
    assert (q.article_number, q.clause_number, q.tsquery_text) == ("2", "2", "types | are | excluded | from | scope")
    assert q.match_text is None


def test_query_quirks_and_dispatch(spark):
    q = built(spark, general_query, "Article 5a -- what's 12 re-use re-use?")
    assert (q.article_number, q.tsquery_text) == (None, "5a | s | re-use")
    empty = built(spark, general_query, "What is Article 4?")
    assert (empty.tsquery_text, empty.match_text, empty.article_number) == (None, None, "4")
    chosen = spark.createDataFrame([("legal_qa",), ("other",)], "task string").select(
        build_lexical_query(F.lit(DSA), F.col("task"), {"legal_qa": legal_query})["tsquery_text"]
    )
    assert [r[0] for r in chosen.collect()] == ["primary | aim", "primary | aim | digital | services | act | according"]


WORDS = ["alpha", "beta", "gamma", "delta", "providers", "provider", "the", "hosting", "hosted", "x1"]


def corpus_rows(n=120, seed=5):
    random.seed(seed)
    rows = []
    for i in range(n):
        # Every third chunk repeats one text, so that many scores tie.
        text = "alpha beta beta hosting" if i % 3 == 0 else " ".join(random.choice(WORDS) for _ in range(random.randint(0, 25)))
        article = None if i % 4 == 0 else str(i % 5)
        rows.append((f"d{i % 7}::chunk::{i}", i % 11, "t1" if i % 2 else "t2", text, article, [i % 3] if article else []))
    return rows


CHUNKS = "chunk_id string, chunk_index int, task string, content string, article_number string, clause_number array<bigint>"
QUERIES = "query_id string, task string, terms array<string>, article_number string, clause_number string"
ASKED = [
    ("q1", "t1", ["alpha", "beta"], None, None),
    ("q2", "t2", ["hosting", "providers", "nowhere"], None, None),
    ("q3", "t1", ["beta"], "2", None),
    ("q4", "t1", ["beta", "gamma"], "3", "1"),
    ("q5", "t2", ["delta"], None, "2"),
    ("q6", "t1", [], "2", None),
    ("q7", "t2", [], None, None),
    ("q8", "t1", [], None, "1"),
    ("q9", "t9", ["alpha"], None, None),
]


def accepted(query, chunk):
    return (
        query[1] == chunk[2]
        and (query[3] is None or query[3] == chunk[4])
        and (query[4] is None or int(query[4]) in chunk[5])
    )


def best(pairs, k):
    result = {}
    for query_id, chunk_id, score in sorted(pairs, key=lambda p: (p[0], -round(p[2], 10), p[1])):
        result.setdefault(query_id, []).append((chunk_id, round(round(score, 10), 9)))
    return {q: found[:k] for q, found in result.items()}


def ranked(frame):
    result = {}
    for row in frame.orderBy("query_id", "rank").collect():
        result.setdefault(row.query_id, []).append((row.chunk_id, round(row.score, 9)))
        assert row.rank == len(result[row.query_id])
    return result


def bm25_brute(rows, k):
    tokens = {r[0]: re.findall(r"[^\W_]+", r[3].lower()) for r in rows}
    n = len(rows)
    mean = sum(map(len, tokens.values())) / n
    pairs = []
    for query in ASKED:
        for chunk in rows:
            if not accepted(query, chunk):
                continue
            score, words = 0.0, tokens[chunk[0]]
            for term in query[2]:
                tf, df = words.count(term), sum(term in t for t in tokens.values())
                if tf:
                    score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
            if score:
                pairs.append((query[0], chunk[0], score))
    return best(pairs, k)


@pytest.mark.parametrize("form", ["analyzed", "postings", "join of analyzed"])
def test_bm25(spark, monkeypatch, form):
    rows = corpus_rows()
    chunks = spark.createDataFrame(rows, CHUNKS).repartition(3)
    queries = spark.createDataFrame(ASKED, QUERIES)
    source = postings(chunks) if form == "postings" else analyzed(chunks)
    if form == "join of analyzed":
        # Too many query terms to ship: both sides are shuffled and frequent terms are dealt out.
        monkeypatch.setattr(lexical_search, "fits_broadcast", lambda frame: False)
        monkeypatch.setattr(lexical_search, "POSTINGS_PER_SALT", 10)
    found = ranked(bm25_topk(queries, source, term_statistics(chunks), 5))
    assert found == bm25_brute(rows, 5)


def test_running_top_k_in_small_blocks(monkeypatch):
    """Blocks of a few cells and frequent reduction give what one sort gives."""
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 12)
    monkeypatch.setattr(blocks, "PENDING_ROWS", 5)
    rng = np.random.default_rng(7)
    scores = rng.integers(0, 6, size=(200, 4)).astype(float)
    scores[rng.random(scores.shape) < 0.3] = -np.inf
    scores[:, 3] = -np.inf
    scores[[3, 9], 3] = 1.0
    chunk_ids = np.array([f"c{i:03d}" for i in rng.permutation(200)], dtype=object)
    running = blocks.RunningTopK(np.array(["a", "b", "c", "d"], dtype=object), 5)
    for block in blocks.row_blocks(200, 4):
        assert block.stop - block.start <= 3
        running.add(scores[block], chunk_ids[block])
    got = {}
    for row in running.result().to_pylist():
        got.setdefault(row["query_id"], []).append((row["chunk_id"], row["score"]))
    pairs = [(q, c, scores[i, j]) for i, c in enumerate(chunk_ids) for j, q in enumerate("abcd") if np.isfinite(scores[i, j])]
    assert {q: sorted(found) for q, found in got.items()} == {q: sorted(found) for q, found in best(pairs, 5).items()}


def test_statistics_of_a_vocabulary(spark):
    chunks = spark.createDataFrame([("a", "x x y"), ("b", "y"), ("c", "")], "chunk_id string, content string")
    words = spark.createDataFrame([("y",), ("z",)], "term string")
    found = {r.term: (r.df, r.n_tokens) for r in term_statistics(chunks, words).collect()}
    assert found == {"": (3, 4), "y": (2, 4)}


@pytest.mark.parametrize("form", [analyzed, postings])
def test_fts_counts_stems(spark, form):
    rows = corpus_rows()
    chunks, queries = spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(ASKED, QUERIES)
    stems = {"providers": "provid", "provider": "provid", "hosting": "host", "hosted": "host"}
    pairs = []
    for query in ASKED:
        wanted = {stems.get(t, t) for t in query[2]}
        for chunk in rows:
            hits = sum(stems.get(w, w) in wanted for w in chunk[3].split())
            if hits and accepted(query, chunk):
                pairs.append((query[0], chunk[0], hits / 10))
    assert ranked(fts_topk(queries, form(chunks), 6, vocabulary=vocabulary(chunks))) == best(pairs, 6)


def test_filter_only_listing(spark):
    rows = corpus_rows()
    chunks, queries = spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(ASKED, QUERIES)
    expected = {}
    for query in ASKED:
        if not query[2]:
            fitting = sorted((c for c in rows if accepted(query, c)), key=lambda c: (c[1], c[0]))
            expected[query[0]] = [(c[0], 0.0) for c in fitting[:4]]
    assert ranked(filter_only_topk(queries, chunks, 4)) == expected


def dense_case(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(90, 8)).astype("float32")
    vectors[1::3] = vectors[0]  # equal vectors tie and the identifier decides
    vectors[5] = 0
    rows = [(f"c{i:03d}", "t1" if i % 2 else "t2", [float(x) for x in v]) for i, v in enumerate(vectors)] + [("none", "t1", None)]
    asked = [(f"q{i}", "t1" if i < 4 else "t2", [float(x) for x in rng.normal(size=8).astype("float32")]) for i in range(6)]
    pairs = []
    for q, task, v in asked:
        for c, own, w in rows:
            if own == task and w is not None and any(w):
                a, b = np.array(v, dtype="float32").astype(float), np.array(w, dtype="float32").astype(float)
                pairs.append((q, c, round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 10)))
    chunks = spark.createDataFrame(rows, "chunk_id string, task string, embedding array<float>").repartition(4)
    queries = spark.createDataFrame(asked, "query_id string, task string, query_vector array<float>")
    return queries, chunks, pairs


def test_dense(spark):
    queries, chunks, pairs = dense_case(spark)
    assert ranked(dense_topk(queries, chunks, 7)) == best(pairs, 7)


def test_dense_with_many_queries(spark, monkeypatch):
    queries, chunks, pairs = dense_case(spark)
    monkeypatch.setattr(dense, "MAX_SHIPPED_NUMBERS", 8)
    monkeypatch.setattr(dense, "QUERIES_PER_TASK", 2)
    monkeypatch.setattr(dense, "CHUNKS_PER_TASK", 13)
    assert ranked(dense_topk(queries, chunks, 7)) == best(pairs, 7)


FOUND = "query_id string, chunk_id string, rank int, score double"


def test_fusion_examples(spark):
    def lists(first, second):
        return [spark.createDataFrame([("q", c, i + 1, s) for i, (c, s) in enumerate(found)], FOUND) for found in (first, second)]

    dense_list, lexical_list = lists([("1", 0.91), ("2", 0.83)], [("2", 0.42), ("3", 0.31)])
    rows = fuse(dense_list, lexical_list, 4).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["2", "1", "3"]
    assert (rows[0].retrieval_sources, rows[0].dense_score, rows[0].lexical_score) == (["dense", "lexical"], 0.83, 0.42)
    dense_list, lexical_list = lists([("A", 3.0), ("B", 2.0), ("C", 1.0)], [("B", 3.0), ("D", 2.0), ("A", 1.0)])
    rows = fuse(dense_list, lexical_list, 4).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 5)) for r in rows] == [("B", 0.03252), ("A", 0.03227), ("D", 0.01613), ("C", 0.01587)]
    assert [r.chunk_id for r in fuse(dense_list, lexical_list, 2).orderBy("rank").collect()] == ["B", "A"]


def test_requests_are_resolved(spark):
    schema = "query_id string, question string, task string, retrieval_mode string, lexical_backend string, top_k int"
    rows = [("a", "alpha", "t", None, None, None), ("b", "alpha", "t", " DENSE ", "BM25", 0), ("c", "alpha", "t", "lexical", "", 15)]
    settings = RetrievalSettings()
    got = {
        r.query_id: (r.mode, r.backend, r.wanted, r.dense_pool, r.lexical_pool)
        for r in resolve_requests(spark.createDataFrame(rows, schema), settings).collect()
    }
    assert got == {"a": ("hybrid", "fts", 4, 12, 12), "b": ("dense", "bm25", 4, 4, 4), "c": ("lexical", "fts", 15, 15, 15)}
    for mode, backend, k in (("fuzzy", None, 4), (None, "solr", 4), (None, None, 21)):
        bad = spark.createDataFrame([("a", "alpha", "t", mode, backend, k)], schema)
        with pytest.raises(Exception, match="unsupported|must not exceed"):
            resolve_requests(bad, settings).collect()


def test_lexical_mode_needs_no_vectors(spark):
    rows = corpus_rows()
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = spark.createDataFrame([("q", "beta gamma", "t1", "lexical"), ("r", "What is Article 2?", "t1", "lexical")],
                                  "query_id string, question string, task string, retrieval_mode string")
    found = retrieve(asked, chunks, RetrievalSettings(), modes=("lexical",), backends=("fts",)).collect()
    assert {r.query_id for r in found} == {"q", "r"}
    assert all(r.retrieval_sources == ["lexical"] and r.fusion_score is None for r in found)
    assert {r.score for r in found if r.query_id == "r"} == {0.0}


def test_rerank(spark):
    candidates = spark.createDataFrame(
        [(q, i + 1, c, float(s)) for q in ("x", "p") for i, (c, s) in enumerate([("low", 0.1), ("high", 0.9), ("medium", 0.5), ("tie", 0.5)])],
        "query_id string, rank int, chunk_id string, given double",
    )
    asked = spark.createDataFrame([("x", "?", " CROSS_encoder"), ("p", "?", None)], "query_id string, question string, reranker_type string")
    full = rerank(candidates, asked, F.col("given")).orderBy("query_id", "rank").collect()
    assert [r.chunk_id for r in full if r.query_id == "x"] == ["high", "medium", "tie", "low"]
    assert [(r.chunk_id, r.rerank_score) for r in full if r.query_id == "p"] == [("low", None), ("high", None), ("medium", None), ("tie", None)]
    cut = rerank(candidates, asked, F.col("given"), keep=2).filter("query_id = 'x'").orderBy("rank").collect()
    assert [(r.rank, r.chunk_id) for r in cut] == [(1, "high"), (2, "medium")]
    with pytest.raises(Exception, match="unsupported reranker"):
        rerank(candidates, asked.withColumn("reranker_type", F.lit("other")), F.col("given")).collect()


def test_model_functions_get_batches(spark):
    def load():
        def model(texts):
            assert 0 < len(texts) <= 2
            return [[len(t), 1.0] for t in texts]

        return model

    frame = spark.createDataFrame([("a",), ("bb",), ("ccc",), ("dddd",), ("eeeee",)], "t string").coalesce(1)
    assert [r[0][0] for r in frame.select(model_embedding(F.col("t"), load, 2)).collect()] == [1, 2, 3, 4, 5]
    assert frame.filter("t = ''").select(model_embedding(F.col("t"), load, 2)).collect() == []
    scored = frame.select(model_pair_score(F.lit("q"), F.col("t"), lambda: lambda pairs: [len(c) for _, c in pairs]))
    assert [r[0] for r in scored.collect()] == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_embedding_configuration_check(spark):
    schema = "task string, embedding_config struct<provider: string, model: string, dimensions: int>"
    one, two = ("p", "m", 3), ("p", "other", 3)
    docs = spark.createDataFrame([("a", one), ("a", None), ("b", one), ("b", two), ("c", None)], schema)
    active = {"provider": "p", "model": "m", "dimensions": 3}
    validate_config(docs, "a", active)
    validate_config(docs, "c", active)
    with pytest.raises(EmbeddingConfigMismatch, match="more than one"):
        validate_config(docs, "b", active)
    with pytest.raises(EmbeddingConfigMismatch, match="active model"):
        validate_config(docs, "a", {**active, "model": "new"})


def test_scored_requests_need_a_scorer(spark):
    candidates = spark.createDataFrame([("x", 1, "c"), ("p", 1, "c")], "query_id string, rank int, chunk_id string")
    asked = spark.createDataFrame([("x", "?", "cross_encoder"), ("p", "?", None)], "query_id string, question string, reranker_type string")
    assert [r.query_id for r in rerank(candidates, asked.filter("query_id = 'p'"), None).collect()] == ["p"]
    with pytest.raises(Exception, match="need a pair scorer"):
        rerank(candidates, asked, None).collect()


def test_pass_through_pairs_are_not_scored(spark):
    candidates = spark.createDataFrame([(q, i, f"c{i}", f"text {i}") for q in ("x", "p") for i in (1, 2)], "query_id string, rank int, chunk_id string, content string")
    asked = spark.createDataFrame([("x", "asked", "cross_encoder"), ("p", "kept", None)], "query_id string, question string, reranker_type string")

    def load():
        def score(pairs):
            assert all(question == "asked" for question, _ in pairs)
            return [float(content[-1]) for _, content in pairs]

        return score

    rows = rerank(candidates, asked, model_pair_score(F.col("question"), F.col("content"), load)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.chunk_id, r.rerank_score, r.question) for r in rows] == [
        ("p", 1, "c1", None, "kept"), ("p", 2, "c2", None, "kept"), ("x", 1, "c2", 2.0, "asked"), ("x", 2, "c1", 1.0, "asked"),
    ]


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), None])
def test_vectors_that_are_not_finite_hide_no_neighbour(spark, odd):
    rows = [("a", "t", [1.0, 0.0]), ("b", "t", [1.0, 1.0]), ("odd", "t", [odd, 1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, task string, embedding array<float>").coalesce(1)
    queries = spark.createDataFrame([("q", "t", [1.0, 0.0])], "query_id string, task string, query_vector array<float>")
    assert [r.chunk_id for r in dense_topk(queries, chunks, 1).collect()] == ["a"]
    assert [r.chunk_id for r in dense_topk(queries, chunks, 3).orderBy("rank").collect()] == ["a", "b"]


def test_vectors_of_mixed_lengths_are_refused(spark):
    chunks = spark.createDataFrame([("a", "t", [1.0]), ("b", "t", [1.0, 1.0, 1.0])], "chunk_id string, task string, embedding array<float>").coalesce(1)
    queries = spark.createDataFrame([("q", "t", [1.0, 0.0])], "query_id string, task string, query_vector array<float>")
    with pytest.raises(Exception, match="different lengths"):
        dense_topk(queries, chunks, 1).collect()


def test_clause_numbers_out_of_range_list_nothing(spark):
    chunks = spark.createDataFrame(corpus_rows(), CHUNKS)
    asked = spark.createDataFrame([("q", "t1", [], None, "99999999999999999999")], QUERIES)
    assert filter_only_topk(asked, chunks, 4).collect() == []


def test_word_lists_beyond_the_bound_give_the_same_statistics(spark, monkeypatch):
    from corpusmill.operators import lexical_index

    chunks = spark.createDataFrame(corpus_rows(), CHUNKS)
    wanted = spark.createDataFrame([("alpha",), ("x1",), ("absent",)], "term string")
    shipped = sorted(map(tuple, term_statistics(chunks, wanted).collect()))
    monkeypatch.setattr(lexical_index, "fits_broadcast", lambda frame: False)
    assert sorted(map(tuple, term_statistics(chunks, wanted).collect())) == shipped
