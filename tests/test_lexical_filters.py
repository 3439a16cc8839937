"""Scoring by filter, with limits per query, bars found before and pairs ruled out by a product, against plain sums."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import lexical_blocks, lexical_search
from corpusmill.operators.lexical_index import analyzed, term_statistics

CHUNKS = "chunk_id string, task string, article_number string, clause_number array<bigint>, content string"
QUERIES = "query_id string, task string, terms array<string>, article_number string, clause_number string, own int"


def corpus(seed=5, chunks=300, queries=60):
    chance = random.Random(seed)
    words = [f"w{k:02d}" for k in range(40)]
    rows = [
        (f"c{at:03d}", chance.choice(["t1", "t2"]), chance.choice([None, "1", "2", "3"]), chance.choice([None, [], [1], [2, 1], [2, 2]]),
         None if at % 50 == 7 else " ".join(chance.choices(words, weights=[1 / (k + 1) for k in range(40)], k=chance.randrange(0, 40))))
        for at in range(chunks)]
    asked = [
        (f"q{at:02d}", chance.choice(["t1", "t2"]), chance.sample(words, chance.randrange(1, 9)), chance.choice([None, "1", "2", "9"]), chance.choice([None, "2", "1"]), chance.randrange(1, 7))
        for at in range(queries)]
    return rows, asked


def best(rows, asked):
    """query_id, rank, chunk_id, score by brute force."""
    split = [row[4].split() for row in rows if row[4] is not None]
    mean, n, found = sum(map(len, split)) / len(split), len(split), []
    for query, task, terms, article, clause, own in asked:
        scores = []
        for chunk, of, its_article, its_clauses, text in rows:
            words = (text or "").split()
            if of == task and article in (None, its_article) and (clause is None or int(clause) in (its_clauses or [])) and set(terms) & set(words):
                total = 0.0
                for term in sorted(set(terms) & set(words)):
                    df, tf = sum(term in other for other in split), words.count(term)
                    total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
                scores.append((-round(total, 8), chunk))
        found += [(query, rank, chunk, -score) for rank, (score, chunk) in enumerate(sorted(scores)[:own], 1)]
    return found


@pytest.mark.parametrize("form", ["tokens", "counted", "bars"])
def test_filters_and_own_limits_give_the_rows_of_plain_sums(spark, monkeypatch, form):
    rows, asked = corpus()
    chunks, queries = spark.createDataFrame(rows, CHUNKS).repartition(3), spark.createDataFrame(asked, QUERIES)
    source = analyzed(chunks)
    if form != "tokens":
        source = lexical_blocks.counted_terms(source)
    statistics = term_statistics(source)
    assert {tuple(r) for r in statistics.collect()} == {tuple(r) for r in term_statistics(chunks).collect()}
    if form == "bars":
        monkeypatch.setattr(lexical_search, "MANY_TERMS", 1)
        monkeypatch.setattr(lexical_search, "FIRST_PART", 2)
    found = lexical_search.bm25_topk(queries, source, statistics, 20, "own").collect()
    assert sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 8)) for r in found) == best(rows, asked)


def test_a_task_hands_on_no_more_than_a_query_wants_and_looks_at_no_other_filter(spark):
    rows, asked = corpus(8)
    chunks = spark.createDataFrame(rows, CHUNKS).coalesce(1)
    terms = pd.DataFrame(
        [(query, task, word, 1.0, article, clause, own) for query, task, words, article, clause, own in asked for word in words],
        columns=["query_id", "task", "term", "weight", "article_number", "clause_number", "most"])
    found = lexical_blocks.score_blocks(analyzed(chunks), terms, lambda tf, dl: tf, 20)
    wanted = {query: own for query, *_, own in asked}
    assert all(row["count"] <= wanted[row.query_id] for row in found.groupBy("query_id").count().collect())
    queries = lexical_blocks.TaskQueries.of(terms[terms["task"] == "t1"], 20)
    here = analyzed(chunks).filter("task = 't1'").select("article_number", F.coalesce("clause_number", F.array().cast("array<bigint>")).alias("clause_number"), "tokens").toArrow().combine_chunks().to_batches()[0]
    place = {word: at for at, word in enumerate(queries.vocabulary)}
    words = [(at, place[word]) for at, own in enumerate(here.column("tokens").to_pylist()) for word in own or [] if word in place]
    posted = lexical_blocks._postings(queries, np.array([w for _, w in words]), np.array([r for r, _ in words]), np.ones(here.num_rows), lambda tf, dl: tf)
    keyed = lexical_blocks._keyed(queries, posted, here.column("article_number"), here.column("clause_number"))
    asked_by_row = {number: (article, clause) for number, (article, clause) in enumerate(zip(here.column("article_number").to_pylist(), here.column("clause_number").to_pylist()))}
    by_id = {query: (article, clause) for query, _, _, article, clause, _ in asked}
    pairs = 0
    for row, query, _ in lexical_blocks._pairs(queries, keyed, lambda: np.full(len(queries.query_ids), -np.inf)):
        for at, name in zip(row, queries.query_ids[query]):
            (article, clause), (its_article, its_clauses) = by_id[name], asked_by_row[at]
            assert article in (None, its_article) and (clause is None or int(clause) in its_clauses)
            pairs += 1
    assert pairs


def test_the_product_rules_out_pairs_below_the_bar_and_no_others(monkeypatch):
    chance = random.Random(4)
    words = [f"w{k:02d}" for k in range(60)]
    # Few words are rare; the frequent ones of a query can't reach its bar alone.
    rows = [(f"q{k:03d}", "t", word, 5.0 if word < "w10" else 0.2 + chance.random(), None, None) for k in range(200) for word in chance.sample(words, 20)]
    queries = lexical_blocks.TaskQueries.of(pd.DataFrame(rows, columns=["query_id", "task", "term", "weight", "article_number", "clause_number"]).astype({"article_number": object}), 5)
    texts = [sorted(set(chance.choices(range(10), k=1) + chance.sample(range(10, 60), 25))) for _ in range(300)]
    row, word = np.repeat(np.arange(300), [len(text) for text in texts]), np.concatenate(texts)
    found = lexical_blocks.Postings(row, word, np.array([0.5 + chance.random() for _ in row]))
    bars = np.full(200, 13.0)

    def run():
        return {(int(r), int(q)): s for rows, asked, sums in lexical_blocks._pairs(queries, found, lambda: bars) for r, q, s in zip(rows, asked, sums)}

    monkeypatch.setattr(lexical_blocks, "DENSE_PAIRS", 10**9)
    plain = run()
    monkeypatch.setattr(lexical_blocks, "DENSE_PAIRS", 1)
    monkeypatch.setattr(lexical_blocks, "DENSE_WORDS", 30)
    monkeypatch.setattr(lexical_blocks, "DENSE_WORK", 10**9)
    monkeypatch.setattr(lexical_blocks, "DENSE_CELLS_HELD", 9000)
    ruled = run()
    assert all(score == plain[key] for key, score in ruled.items())
    assert {key for key, score in plain.items() if score >= 13.0} <= ruled.keys() and len(ruled) < 0.6 * len(plain)


def test_blocks_are_cut_where_chunks_are_read_and_hold_every_posting_once(spark, tmp_path, monkeypatch):
    from corpusmill.sources import term_segments

    rows, _ = corpus(2, 120)
    chunks = spark.createDataFrame(rows, CHUNKS).repartition(2)
    monkeypatch.setattr(term_segments, "BLOCK_POSTINGS", 3)
    monkeypatch.setattr(term_segments, "POSTINGS_SORTED", 50)
    monkeypatch.setattr(term_segments, "POSTINGS_OUT", 7)
    monkeypatch.setattr(type(chunks), "repartitionByRange", None)  # no posting is shuffled
    monkeypatch.setattr(term_segments, "_write_blocks", None)
    segment = term_segments.write_segment(chunks, str(tmp_path), 1, 3)
    blocks = term_segments.read_blocks(spark, str(tmp_path), [segment]).collect()
    held = sorted((b.term, p.chunk_id, p.task, p.article_number, p.clause_number, p.tf, p.dl) for b in blocks for p in b.postings)
    want = sorted((w, c, t, a, n, text.split().count(w), len(text.split())) for c, t, a, n, text in rows if text for w in set(text.split()))
    assert sorted(map(str, held)) == sorted(map(str, want))
    assert all(b.n == len(b.postings) <= 3 and b.most_tf == max(p.tf for p in b.postings) and b.least_dl == min(p.dl for p in b.postings) for b in blocks)
    assert len({b.block for b in blocks}) == len(blocks)
    counts = spark.read.parquet(f"{tmp_path}/terms/stored_in=1/counts")
    assert {tuple(r) for r in counts.select("term", "df", "n_tokens").collect()} == {tuple(r) for r in term_statistics(chunks).collect()}


def test_postings_are_dealt_with_numbers_for_words(spark):
    posted = spark.createDataFrame([(f"c{at}", "t", None, None, 3, word, 1 + at) for at in range(5) for word in ("a", "b", "other")],
                                   "chunk_id string, task string, article_number string, clause_number array<bigint>, dl int, term string, tf int")
    terms = pd.DataFrame([("q", "t", "a", 1.0, None, None), ("q", "t", "b", 2.0, None, None), ("p", "t", "b", 1.0, None, None)],
                         columns=["query_id", "task", "term", "weight", "article_number", "clause_number"])
    found = lexical_blocks.score_postings(posted, terms, lambda tf, dl: tf, 2)
    shuffles = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(chunk_id" in line]
    assert shuffles and "term" not in found._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[0]
    # Words of no query are left out; each task hands on its best.
    best = found.withColumn("nth", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC)")).filter("nth <= 2")
    assert sorted((r.query_id, r.chunk_id, r.score) for r in best.collect()) == [("p", "c3", 4.0), ("p", "c4", 5.0), ("q", "c3", 12.0), ("q", "c4", 15.0)]
