"""Metrics, reports, benchmark building, pooling and review."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.benchmark_text import (
    generation_prompt, heuristic_gold_answer, heuristic_question, is_yes, judge_prompt, parse_model_json, phrase, topic,
)
from corpusmill.operators.benchmark import build_dataset, heuristic_content, merge_replies
from corpusmill.operators.metrics import (
    duplicate_candidates, mean_metrics, metric_names, sample_metrics, worst_samples,
)
from corpusmill.operators.pooling import expand_labels, lexical_backends, pool_candidates, pool_sources, pooling_record
from corpusmill.operators.reports import generation_method
from corpusmill.operators.retrieve import RetrievalSettings
from corpusmill.operators.review import (
    apply_edits, edits_out_of_range, filter_reviewed, list_samples, review_counts,
)
from corpusmill.operators.sampling import evenly_spaced
from corpusmill.plans.evaluate import evaluate_retrieval
from corpusmill.sources.datasets import read_dataset, read_questions, write_dataset
from corpusmill.sources.reports import compare_report_files, report_tables, write_report
from tests.test_text import column

K = [1, 2, 3, 5]


def measure(retrieved, relevant):
    got = {}
    for k in K:
        hits = [i for i, c in enumerate(retrieved[:k], 1) if c in relevant]
        ideal = sum(1 / math.log2(i + 1) for i in range(1, min(len(relevant), k) + 1))
        got[f"hit_rate@{k}"] = 1.0 if hits else 0.0
        got[f"precision@{k}"] = len(hits) / k
        got[f"recall@{k}"] = len(hits) / len(relevant) if relevant else 0.0
        got[f"ndcg@{k}"] = sum(1 / math.log2(i + 1) for i in hits) / ideal if relevant else 0.0
    ranks = [i for i, c in enumerate(retrieved, 1) if c in relevant]
    got["mrr"] = 1 / ranks[0] if ranks else 0.0
    return got


def metric_case(spark, cases):
    retrieved = [(q, i, c) for q, (found, _) in cases.items() for i, c in enumerate(found, 1)]
    relevant = [(q, c) for q, (_, labels) in cases.items() for c in labels]
    samples = spark.createDataFrame([(q,) for q in cases], "query_id string")
    return sample_metrics(
        samples, spark.createDataFrame(retrieved, "query_id string, rank int, chunk_id string"),
        spark.createDataFrame(relevant, "query_id string, chunk_id string"), K,
    )


def test_metrics_against_definition(spark):
    random.seed(4)
    cases = {"example": (["9", "1"], {"1"}), "nothing": ([], {"1"}), "unlabelled": (["1"], set()), "late": (list("abcdefgh"), {"h"})}
    for n in range(60):
        pool = [f"c{i}" for i in range(12)]
        cases[f"r{n}"] = (random.sample(pool, random.randint(0, 9)), set(random.sample(pool, random.randint(0, 6))))
    measured = metric_case(spark, cases)
    names = metric_names(K)
    for row in measured.collect():
        got, want = {n: row[n] for n in names}, measure(*cases[row.query_id])
        assert got == pytest.approx(want, abs=1e-12), row.query_id
        assert all(0 <= v <= 1 for v in got.values())
        assert [got[f"recall@{k}"] for k in K] == sorted(got[f"recall@{k}"] for k in K)
    means = mean_metrics(measured, K).first()
    expected = [measure(*case) for case in cases.values()]
    assert means.n_samples == len(cases)
    assert all(means[n] == pytest.approx(sum(m[n] for m in expected) / len(cases)) for n in names)
    assert mean_metrics(measured.filter("false"), K).count() == 0


def test_metrics_example_and_order(spark):
    row = metric_case(spark, {"q": (["9", "1"], {"1"})}).first()
    assert (row["hit_rate@1"], row["hit_rate@2"], row["mrr"]) == (0.0, 1.0, 0.5)
    frame = spark.createDataFrame([("a", 2, 0.5), ("b", 1, 0.5), ("c", 0, 1.0), ("d", 3, 0.0)], "q string, pos int, mrr double")
    assert [r.q for r in worst_samples(frame, "pos", 3).collect()] == ["d", "b", "a"]
    twice = spark.createDataFrame([("q", "c"), ("q", "c"), ("q", "d")], "query_id string, chunk_id string")
    assert [tuple(r) for r in duplicate_candidates(twice).collect()] == [("q", "c", 2)]


META = "struct<article_number: string, clause_number: array<bigint>, article_title: string>"
CHUNK = f"document_id bigint, chunk_index int, chunk_id string, source_path string, title string, content string, metadata {META}"


def corpus(spark, rows):
    full = [(d, i, f"doc{d}::chunk::{i}", f"doc{d}", f"Doc {d}", text, meta) for d, i, text, meta in rows]
    return spark.createDataFrame(full, CHUNK)


@pytest.mark.parametrize("n,wanted", [(10, 3), (7, 7), (5, 9), (290, 100), (435, 101), (1000, 17)])
def test_evenly_spaced(spark, n, wanted):
    random.seed(n)
    rows, doc = [], -3
    while len(rows) < n:
        doc += random.choice([1, 1, 2, 70_000])
        rows += [(doc, i, "t", None) for i in range(min(random.randint(1, 40), n - len(rows)))]
    order = sorted((d, i) for d, i, _, _ in rows)
    step = n / wanted
    picked = order if n <= wanted else [order[min(math.floor(i * step), n - 1)] for i in range(wanted)]
    got = evenly_spaced(corpus(spark, rows), wanted).orderBy("sample_pos").collect()
    assert [(r.document_id, r.chunk_index) for r in got] == picked
    assert [r.sample_pos for r in got] == list(range(len(picked)))
    assert evenly_spaced(corpus(spark, rows)).count() == n


def test_evenly_spaced_needs_a_positive_number(spark):
    with pytest.raises(ValueError):
        evenly_spaced(corpus(spark, [(1, 0, "t", None)]), 0)


def test_heuristics(spark):
    assert column(spark, ["  Risk. assessments. ", " . ", None, "..A.."], "string", phrase) == ["risk. assessments", None, None, "a"]
    texts = ["One two three four five six seven eight nine. Next", "Short: words,", " ", "Is it? Yes!"]
    assert column(spark, texts, "string", topic) == ["One two three four five six seven eight", "Short: words", "this provision", "Is it?"]
    long = "Too short. This sentence certainly has more than forty characters! Rest"
    answers = column(spark, [long, "tiny", " \n", "x" * 500], "string", heuristic_gold_answer)
    assert answers == ["This sentence certainly has more than forty characters!", "tiny", None, "x" * 280]

    def question(index, article, clauses, title, content="Some words here."):
        return spark.range(1).select(
            heuristic_question(F.lit(content), F.lit(index), F.lit(article).cast("string"),
                               F.lit(clauses).cast("array<bigint>") if clauses is None else F.array(*[F.lit(c).cast("bigint") for c in clauses]).cast("array<bigint>"),
                               F.lit(title).cast("string"))
        ).first()[0]

    assert question(0, "5", [1], "Risk assessments") == "What does Article 5, Clause 1 say about risk assessments?"
    assert question(1, "5", [1, 2], "Risk.") == "How does Article 5, Clause 1, 2 address risk?"
    assert question(0, "5", [], "") == "What does Article 5 say?"
    assert question(0, None, None, "Scope") == "What does the document say about scope?"
    assert question(0, None, None, None) == "What does this section say about Some words here?"


def test_dataset_from_chunks(spark):
    meta = ("5", [1], "Risk assessments")
    rows = [(1, i, "same words", meta if i == 0 else None) for i in range(3)] + [(2, 0, "same words", None)]
    built = build_dataset(heuristic_content(evenly_spaced(corpus(spark, rows)))).orderBy("sample_pos").collect()
    repeated = "What does this section say about same words?"
    assert [r.question for r in built] == [
        "What does Article 5, Clause 1 say about risk assessments?", repeated, f"{repeated} (passage 2)", f"{repeated} (passage 3)",
    ]
    assert built[0].relevant_chunk_ids == ["doc1::chunk::0"]
    assert built[0].metadata == {
        "task": "legal_qa", "source_path": "doc1", "chunk_index": "0", "article_number": "5", "clause_number": "[1]",
        "article_title": "Risk assessments", "document_title": "Doc 1", "review_status": "auto_generated", "generation_method": "heuristic",
    }


def test_numbering_over_many_blocks(spark):
    rows = [(d, i, "same", None) for d in range(5) for i in range(2000)]
    built = build_dataset(heuristic_content(evenly_spaced(corpus(spark, rows))))
    base = "What does this section say about same?"
    wrong = built.filter(
        F.col("question") != F.when(F.col("sample_pos") == 0, base).otherwise(F.concat(F.lit(f"{base} (passage "), (F.col("sample_pos") + 1).cast("string"), F.lit(")")))
    )
    assert built.count() == 10_000 and wrong.count() == 0


def test_model_replies(spark):
    replies = ['{"question": "Q?", "gold_answer": "A"}', '```json\n{"question": "Q?"}\n```', 'Sure: {"question": "Q?"} bye', "not valid json",
               "[1]", '{"question": {"a": 1}}', '{"broken": ', '"text"', "{} and {}"]
    parsed = column(spark, replies, "string", parse_model_json)
    assert parsed == [{"question": "Q?", "gold_answer": "A"}, {"question": "Q?"}, {"question": "Q?"}, {}, {}, {"question": '{"a":1}'}, {}, {}, {}]
    chunks = corpus(spark, [(1, i, "some words", None) for i in range(4)])
    raw = ['{"question": " Asked? ", "gold_answer": "A"}', "not valid json", '{"question": null, "gold_answer": " "}']
    given = spark.createDataFrame([(f"doc1::chunk::{i}", r) for i, r in enumerate(raw)], "chunk_id string, raw string")
    rows = merge_replies(chunks, given, "openai", "m").orderBy("chunk_index").collect()
    fallback = "What does this section say about some words?"
    both = "llm_question_missing_fell_back_to_heuristic; llm_gold_answer_missing_fell_back_to_heuristic"
    assert [(r.base_question, r.gold_answer, r.generation_note) for r in rows] == [
        ("Asked?", "A", None), (fallback, "some words", both), ("None", "some words", "llm_gold_answer_missing_fell_back_to_heuristic"),
        (fallback, "some words", both),
    ]


def test_prompts_do_not_leak_labels(spark):
    prompt = spark.range(1).select(generation_prompt(F.lit(None).cast("string"), F.lit("the content"))).first()[0]
    assert "Document title: unknown\nChunk content:\nthe content\n" in prompt and "Article" not in prompt
    judged = spark.range(1).select(judge_prompt(F.lit("Q?"), F.lit("P"))).first()[0]
    assert judged.endswith("Question:\nQ?\n\nPassage:\nP\n")
    assert column(spark, ["Yes.", "no", " RELEVANT!", "1. y", "", "yesterday"], "string", is_yes) == [True, False, True, True, False, False]


FOUND = "query_id string, chunk_id string, rank int"


def test_pooling(spark):
    samples = spark.createDataFrame([("q", ["0"], {"a": "b"}), ("r", ["9"], {"relevance_pooling": "old"})],
                                    "query_id string, relevant_chunk_ids array<string>, metadata map<string,string>")
    dense = spark.createDataFrame([("q", "0", 1), ("q", "2", 2)], FOUND)
    text = spark.createDataFrame([("q", "1", 1), ("q", "2", 2), ("q", "3", 3), ("other", "5", 1)], FOUND)
    pool = pool_candidates([dense, text])
    places = {(r.query_id, r.chunk_id): (r.source_order, r["rank"]) for r in pool.collect()}
    assert places[("q", "2")] == (0, 2) and len(places) == 5
    verdicts = spark.createDataFrame([("q", "1", "text", "Yes"), ("q", "2", "text", "no"), ("q", "3", "  ", "yes")],
                                     "query_id string, chunk_id string, content string, raw string")
    got = {r.query_id: r for r in pooling_record(expand_labels(samples, pool, verdicts), "p", "m", 10, ["dense"], ["fts"]).collect()}
    assert (got["q"].relevant_chunk_ids, got["q"].candidates_judged, got["q"].judged_relevant) == (["0", "1"], ["2", "1", "3"], ["1"])
    assert (got["r"].relevant_chunk_ids, got["r"].candidates_judged) == (["9"], [])
    assert '"candidates_judged":["2","1","3"]' in got["q"].metadata["relevance_pooling"] and got["q"].metadata["a"] == "b"
    assert got["r"].metadata["relevance_pooling"] != "old"
    assert (lexical_backends(" Mixed"), lexical_backends("bm25")) == (["fts", "bm25"], ["bm25"])
    assert pool_sources(["dense", "lexical"], ["fts", "bm25"]) == [("dense", None), ("lexical", "fts"), ("lexical", "bm25")]
    with pytest.raises(ValueError):
        lexical_backends("solr")


DATA = "sample_pos bigint, question string, relevant_chunk_ids array<string>, gold_answer string, metadata map<string,string>"


def reviewed(spark):
    return spark.createDataFrame(
        [(0, "A", ["a"], "x", {"review_status": "approved"}), (1, "B", ["b"], None, {"review_status": "rejected", "reviewer_note": "n"}), (2, "C", ["c"], "z", {})], DATA
    )


def test_review(spark):
    samples = reviewed(spark)
    assert [tuple(r) for r in review_counts(samples).collect()] == [("approved", 1), ("rejected", 1), ("unreviewed", 1)]

    def kept(**choice):
        return sorted(r.question for r in filter_reviewed(samples, **choice).collect())

    assert kept() == ["A", "B", "C"] and kept(keep=set()) == [] and kept(keep={"approved", "unreviewed"}) == ["A", "C"]
    assert kept(drop={"rejected"}) == ["A", "C"] and kept(keep={"rejected"}, drop={"rejected"}) == []
    assert [r.question for r in list_samples(samples, status="unreviewed").collect()] == ["C"]
    assert [r.question for r in list_samples(samples, position=1).collect()] == ["B"]


def test_edits(spark):
    edits = spark.createDataFrame(
        [(0, None, " New ", " ", [" x ", ""], " hi ", None), (1, "approved", None, None, None, None, True), (7, "approved", None, None, None, None, None)],
        "sample_pos bigint, status string, question string, gold_answer string, relevant_chunk_ids array<string>, reviewer_note string, clear_note boolean",
    )
    got = {r.sample_pos: r for r in apply_edits(reviewed(spark), edits).collect()}
    assert (got[0].question, got[0].gold_answer, got[0].relevant_chunk_ids) == ("New", None, ["x"])
    assert got[0].metadata == {"review_status": "approved", "reviewer_note": "hi"}
    assert got[1].metadata == {"review_status": "approved"} and got[1].question == "B"
    assert got[2].asDict() == reviewed(spark).filter("sample_pos = 2").first().asDict()
    assert [r.sample_pos for r in edits_out_of_range(reviewed(spark), edits).collect()] == [7]


def test_dataset_files(spark, tmp_path):
    path = str(tmp_path / "set")
    write_dataset(reviewed(spark), path)
    got = read_dataset(spark, path).orderBy("sample_pos").collect()
    assert got == reviewed(spark).orderBy("sample_pos").collect()
    lines = [f'{{"question": "q{i}", "relevant_chunk_ids": ["{i}"]}}' for i in range(500)]
    (tmp_path / "long.jsonl").write_text("\n\n".join(lines) + "\n  \n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_dataset(spark, str(tmp_path / "long.jsonl")).orderBy("sample_pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.sample_pos, r.question, r.metadata, r.gold_answer) for r in rows] == [(i, f"q{i}", {}, None) for i in range(500)]


def test_question_list(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text('[{"question": " A? ", "task": "t"}, {"question": ""}, {"task": "x"}]')
    assert [r.question for r in read_questions(spark, str(path)).collect()] == ["A?"]
    path.write_text("[]")
    with pytest.raises(ValueError):
        read_questions(spark, str(path))


def test_generation_method(spark):
    def label(*methods):
        rows = [({"generation_method": m} if m else {},) for m in methods]
        return generation_method(spark.createDataFrame(rows, "metadata map<string,string>")).first()[0]

    assert (label("llm", " llm ", None), label("llm", "heuristic"), label(None)) == ("llm", "mixed", None)


def test_harness_and_reports(spark, tmp_path):
    chunks = spark.createDataFrame(
        [(f"d::chunk::{i}", "t", i, text, None, None) for i, text in enumerate(["alpha beta", "alpha", "gamma", "delta delta"])],
        "chunk_id string, task string, chunk_index int, content string, article_number string, clause_number array<bigint>",
    )
    samples = spark.createDataFrame(
        [("1", "alpha", "t", ["d::chunk::0"]), ("2", "delta", "t", ["d::chunk::3"]), ("3", "nowhere", "t", ["d::chunk::1"])],
        "query_id string, question string, task string, relevant_chunk_ids array<string>",
    )
    settings = RetrievalSettings(mode="lexical", lexical_backend="bm25")
    search = {"modes": ("lexical",), "backends": ("bm25",)}
    measured = evaluate_retrieval(samples, chunks, settings, K, **search)
    got = {r.query_id: (r.mrr, r.retrieved_ids) for r in measured.collect()}
    assert got == {"1": (0.5, ["d::chunk::1", "d::chunk::0"]), "2": (1.0, ["d::chunk::3"]), "3": (0.0, None)}
    scored = samples.withColumn("reranker_type", F.lit("cross_encoder"))
    again = evaluate_retrieval(scored, chunks, settings, K, pair_score=F.length("content").cast("double"), **search)
    assert {r.query_id: r["hit_rate@1"] for r in again.collect()} == {"1": 1.0, "2": 1.0, "3": 0.0}
    for name, experiment in (("b", "e1"), ("a", "e1"), ("c", "e2")):
        config = {"experiment_id": experiment, "retrieval_mode": "lexical", "reranker_type": name, "dataset_generation_method": None}
        write_report(*report_tables(measured, config, K), str(tmp_path), name)
    pattern = f"{tmp_path}/*/summary/*.json"
    rows = compare_report_files(spark, pattern, "e1", ["mrr", "hit_rate@1"]).collect()
    assert [(r.reranker_type, r.mrr, r["hit_rate@1"], r.n_samples) for r in rows] == [("a", 0.5, 1 / 3, 3), ("b", 0.5, 1 / 3, 3)]
    with pytest.raises(ValueError):
        compare_report_files(spark, pattern, "e9", ["mrr"])


def test_document_offsets_of_hashed_ids(spark, monkeypatch):
    from corpusmill.operators import sampling

    monkeypatch.setattr(sampling, "RANGES", 8)
    frame = spark.range(500).selectExpr("xxhash64(id) AS document_id", "explode(sequence(0, CAST(id % 3 AS int))) AS chunk_index")
    rows = sampling.document_offsets(frame).orderBy("document_id").collect()
    before = 0
    for row in rows:
        assert (row.offset, row.total) == (before, sum(i % 3 + 1 for i in range(500)))
        before += row.n_chunks
    assert len(rows) == 500
