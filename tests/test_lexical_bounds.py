"""Block scoring with bars, queries shipped in groups, and the stemmed vocabulary, against plain sums."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.functions.text import strip
from corpusmill.operators import lexical_blocks, lexical_search
from corpusmill.operators.lexical_index import analyzed, term_statistics


def terms_of(weights):
    rows = [(query, "en", word, weight, None, None) for query, own in weights.items() for word, weight in own.items()]
    return pd.DataFrame(rows, columns=["query_id", "task", "term", "weight", "article_number", "clause_number"]).astype({"article_number": object})


def test_pairs_below_the_bar_are_left_out_and_others_have_whole_sums(monkeypatch):
    chance = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    weights = {f"q{k}": {word: 0.1 + chance.random() ** 4 * 9 for word in chance.sample(words, 7)} for k in range(30)}
    queries = lexical_blocks.TaskQueries.of(terms_of(weights))
    rows = [chance.choices(queries.vocabulary, k=chance.randrange(1, 25)) for _ in range(300)]
    place = {word: at for at, word in enumerate(queries.vocabulary)}
    tokens = np.array([place[word] for row in rows for word in row])
    row_of = np.repeat(np.arange(300), [len(row) for row in rows])
    found = lexical_blocks._postings(queries, tokens, row_of, np.array([len(row) for row in rows]), lambda tf, dl: tf / (tf + dl / 10))
    want = {}
    for at, row in enumerate(rows):
        for number, query in enumerate(queries.query_ids):
            parts = [row.count(word) / (row.count(word) + len(row) / 10) * weight for word, weight in sorted(weights[query].items()) if word in row]
            if parts:
                want[at, number] = sum(parts)
    monkeypatch.setattr(lexical_blocks, "BLOCK_ENTRIES", 500)
    monkeypatch.setattr(lexical_blocks, "PAIRS_SUMMED", 7)
    asked = []

    def given(bar):
        out = {}
        for row, query, scores in lexical_blocks._pairs(queries, found, lambda: np.full(30, bar)):
            asked.append(len(row))
            for key in zip(row.tolist(), query.tolist()):
                assert key not in out
                out[key] = None
            out.update(zip(zip(row.tolist(), query.tolist()), scores.tolist()))
        return out

    everything = given(-np.inf)
    assert everything.keys() == want.keys() and all(abs(everything[key] - want[key]) < 1e-9 for key in want)
    for bar in (0.5, 2.0, 4.0):
        some = given(bar)
        assert all(score == everything[key] for key, score in some.items())  # bit by bit the same
        assert {key for key, score in everything.items() if score >= bar} <= some.keys()
        assert len(some) < len(everything)


CHUNKS = "chunk_id string, task string, article_number string, clause_number array<bigint>, content string"


def corpus(spark):
    chance = random.Random(9)
    words = [f"{a}{b}" for a in ("run", "walk", "jump", "sing") for b in ("", "s", "ing", "ed", "er", "x1")]
    rows = [(f"c{at}", "en", str(at % 5) if at % 4 else None, [at % 3] if at % 2 else [], " ".join(chance.choices(words, k=30))) for at in range(120)]
    asked = [(f"q{at}", "en", chance.sample(words, 4), "3" if at % 3 == 0 else None, "1" if at % 6 == 0 else None) for at in range(25)]
    return spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(
        asked, "query_id string, task string, terms array<string>, article_number string, clause_number string")


@pytest.mark.parametrize("search", ["bm25", "fts"])
def test_queries_in_groups_are_never_joined(spark, monkeypatch, search):
    chunks, asked = corpus(spark)

    def found():
        if search == "fts":
            return lexical_search.fts_topk(asked, analyzed(chunks), 5, vocabulary=chunks.select(F.explode(F.split("content", " ")).alias("term")))
        return lexical_search.bm25_topk(asked, analyzed(chunks), term_statistics(analyzed(chunks)), 5)

    want = sorted(map(tuple, found().select("query_id", "rank", "chunk_id", "score").collect()))
    fits = lexical_search.fits_broadcast
    monkeypatch.setattr(lexical_search, "fits_broadcast", lambda frame: fits(frame, 30))
    monkeypatch.setattr(lexical_search, "_pair_scores", None)  # a join would write all pairs
    assert want and sorted(map(tuple, found().select("query_id", "rank", "chunk_id", "score").collect())) == want


def test_each_word_is_stemmed_once(spark):
    chunks, asked = corpus(spark)
    vocabulary = chunks.select(F.explode(F.split("content", " ")).alias("term"))
    plan = lexical_search.stemmed_terms(asked, vocabulary)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(split(content" not in plan  # the words are stored before they are stemmed


def test_strip_knows_all_white_space(spark):
    texts = ["", " ", "a", *[f"{chr(c)}a{chr(c)}b{chr(c)}" for c in [*range(0x3000), 0x3000, 0x3001, 0xFEFF] if not 0xD800 <= c < 0xE000]]
    frame = spark.createDataFrame([(text,) for text in texts], "text string")
    got = frame.select(strip(F.col("text")).alias("new"), F.regexp_replace("text", r"(?U)^\s+|\s+\z", "").alias("old"))
    assert got.filter("new <> old OR new IS NULL").count() == 0


def test_postings_are_scored_by_chunk_as_their_join_with_queries_is(spark):
    """A word that all queries use is shuffled once per chunk, not once per chunk and query; rows of one chunk with other filters count together."""
    from corpusmill.operators.lexical_blocks import score_postings
    from corpusmill.operators.lexical_search import match_postings

    word = F.concat(F.lit("w"), F.pmod(F.xxhash64("id", "nth"), F.lit(9)).cast("string"))
    article = F.when(F.col("id") % 3 == 0, F.col("nth").cast("string"))
    posted = spark.range(400).withColumn("nth", F.explode(F.array(*map(F.lit, range(5))))).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.when(F.col("id") % 7 > 0, "en").otherwise("fr").alias("task"),
        article.alias("article_number"), F.when(F.col("id") % 2 == 0, F.array(F.col("nth").cast("bigint"))).alias("clause_number"),
        word.alias("term"), F.col("nth").cast("int").alias("tf"), (F.col("id") % 11 + 1).cast("int").alias("dl")).filter("tf > 0")
    terms = spark.range(60).withColumn("nth", F.explode(F.array(*map(F.lit, range(4))))).select(
        F.concat(F.lit("q"), F.col("id").cast("string")).alias("query_id"), F.lit("en").alias("task"),
        F.when(F.col("id") % 5 == 0, F.lit("2")).alias("article_number"), F.when(F.col("id") % 4 == 0, F.lit("3")).alias("clause_number"),
        F.concat(F.lit("w"), ((F.col("id") + 2 * F.col("nth")) % 9).cast("string")).alias("term"), (F.col("nth") + 1.0).alias("w_weight")).distinct()
    joined = match_postings(posted, terms).groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("w_weight") * F.col("tf") / F.col("dl")), 10).alias("score"))
    for some in (terms, terms.filter("article_number IS NULL AND clause_number IS NULL")):
        found = score_postings(posted, some.withColumnRenamed("w_weight", "weight").toPandas(), lambda tf, dl: tf / dl, 400)
        expected = joined.join(some.select("query_id").distinct(), "query_id")
        digits = lambda rows: sorted((q, c, round(s, 6)) for q, c, s in rows.select("query_id", "chunk_id", "score").collect())
        assert digits(found) == digits(expected) and found.count()
