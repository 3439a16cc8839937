"""Traces, run rows, summaries, agent runs, log files, the corpus store and the streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.agent import first_step, log_trace, run_latency_ms, run_outcome, stored_trace
from corpusmill.functions.trace import TRACE_TYPE, summarize_trace
from corpusmill.operators.corpus import plain_chunks
from corpusmill.operators.lexical_index import analyzed, term_statistics
from corpusmill.operators.lexical_search import bm25_topk
from corpusmill.operators.runlog import (
    RUN_COLUMNS, agent_evaluation_rows, agent_log_rows, evaluation_rows, filter_options, filter_rows,
    query_log_rows, run_rows_from_log, run_rows_from_tables,
)
from corpusmill.operators.summaries import all_group_summaries, group_summary, headline
from corpusmill.schemas import STEPS
from corpusmill.sources.corpus_store import (
    find_document, read_corpus, read_term_tables, replace_in_store, write_corpus,
)
from corpusmill.sources.request_log import append_log, append_log_lines, clear_log, read_log_lines, run_rows
from corpusmill.sources.text_files import read_text_documents
from corpusmill.streaming.corpus_stream import replace_from_stream
from corpusmill.streaming.log_stream import append_run_rows, publish_summary, read_summary, stream_log_lines


def event(stage, ms=0.0, **metadata):
    return {"stage": stage, "duration_ms": ms, "metadata": metadata}


def summary(spark, events):
    frame = spark.createDataFrame([(json.dumps(events),)], "j string").select(F.from_json("j", TRACE_TYPE).alias("t"))
    return tuple(frame.select(summarize_trace(F.col("t")).alias("s")).first().s)


def test_trace_summary(spark):
    events = [
        event("guardrail.scope.result", status="in_scope", reason=""),
        event("retrieval.search", 2.0), event("retrieval.search", 1.0, retrieval_mode="dense"), event("retrieval.search", 1.5, retrieval_mode="hybrid"),
        event("retrieval.rerank", 0.5), event("generation.primary", 7.0), event("generation.fallback", 1.0), event("retrieval", 100.0),
        event("guardrail.evidence.result", status="sufficient", reason="found"), event("guardrail.scope.result", status="late", reason="later"),
    ]
    assert summary(spark, events) == (5.0, 8.0, "dense", "late", "sufficient", "found")
    assert summary(spark, []) == (0.0, 0.0, None, None, None, None)


def steps_frame(spark, steps):
    return spark.createDataFrame([(json.dumps(steps),)], "j string").select(F.from_json("j", STEPS).alias("s"))


STEPS_RUN = [
    {"step_id": "1", "step_type": "retrieve_context", "status": "completed", "latency_ms": 3.0, "output": {"retrieval_mode": "hybrid", "retrieval_count": 2},
     "checkpoint": {"decision": "allow", "reason": "ok", "metrics": {"retrieval_count": 2.0}}},
    {"step_id": "2", "step_type": "answer_question", "status": "completed", "latency_ms": 5.0, "output": {"provider": "openai", "model": "m", "estimated_cost_usd": 0.5, "pricing_source": "card"},
     "checkpoint": {"decision": "allow", "reason": "grounded", "metrics": {"groundedness": 3.0}}},
    {"step_id": "3", "step_type": "draft_email", "status": "completed", "latency_ms": 1.0, "output": {}},
    {"step_id": "4", "step_type": "other", "status": "failed"},
]


def test_agent_traces(spark):
    frame = steps_frame(spark, STEPS_RUN)
    stored = frame.select(stored_trace(F.col("s")).alias("t")).first().t
    assert [e.stage for e in stored] == [
        "retrieval.search", "checkpoint.retrieve_context", "generation.answer", "checkpoint.answer_question", "generation.draft_email", "agent.other",
    ]
    assert stored[0].metadata == {"step_id": "1", "status": "completed", "retrieval_mode": "hybrid", "retrieval_count": "2", "reranker_type": None}
    assert stored[1].metadata == {"decision": "allow", "reason": "ok", "metrics": '{"retrieval_count":2.0}'}
    assert stored[5].duration_ms == 0.0
    logged = frame.select(log_trace(F.col("s")).alias("t")).first().t
    assert [e.stage for e in logged] == ["retrieval.search", "generation.answer", "generation.draft_email", "agent.other"]
    assert frame.select(first_step(F.col("s"), "draft_email")["step_id"]).first()[0] == "3"
    assert frame.select(first_step(F.col("s"), "absent")).first()[0] is None


def test_run_latency(spark):
    frame = spark.sql("select timestamp'2024-01-01 00:00:00.000001' a, timestamp'2024-01-01 00:00:01.234568' b, cast(null as timestamp) c")
    assert frame.select(run_latency_ms(F.col("a"), F.col("b")), run_latency_ms(F.col("a"), F.col("c"))).first()[:] == (1234.57, 0.0)


def outcome(spark, status, *steps):
    frame = spark.createDataFrame(
        [((status, "why"), [(t, e, d, r) for t, e, d, r in steps])],
        "scope struct<status: string, reason: string>, steps array<struct<step_type: string, error: string, decision: string, reason: string>>",
    )
    return tuple(frame.select(run_outcome(F.col("scope"), F.col("steps")).alias("o")).first().o)


def test_run_outcome(spark):
    good, bad, broken = ("a", None, "allow", "fine"), ("b", None, "abort", "no"), ("c", "boom", None, None)
    assert outcome(spark, "in_scope", good, good, good) == ("completed", None, 3)
    assert outcome(spark, "in_scope", good, bad, broken) == ("aborted", "no", 2)
    assert outcome(spark, "in_scope", broken, bad) == ("failed", "boom", 1)
    assert outcome(spark, "out_of_scope", good) == ("aborted", "why", 0)


def log_records():
    query = {
        "timestamp": "2024-01-01T00:00:00.000000Z", "request": {"question": "Q", "task": "t", "quality_mode": ""},
        "response": {"latency_ms": 9.0, "routing": {"selected_provider": "guardrail", "selected_model": "g", "fallback_used": False, "reason": "routed"},
                     "trace": {"events": [event("guardrail.scope.result", status="out_of_scope", reason="traced")]}, "guardrails": {"scope_status": ""},
                     "evaluation": {"groundedness_score": 1.0, "estimated_cost_usd": 0.25, "provider_reported_cost_usd": 0.0}},
    }
    agent = {
        "timestamp": "2024-01-02T00:00:00.000000Z", "request_kind": "agent_run", "request": {"question": "A", "task": "t", "quality_mode": "fast", "reranker_type": "own"},
        "response": {"run_id": "run_1", "status": "completed", "task_type": "answer_and_draft_email", "created_at": "2024-01-02T00:00:00.000000Z",
                     "completed_at": "2024-01-02T00:00:02.000000Z", "steps": STEPS_RUN,
                     "final_output": {"answer": "done", "answer_metadata": {"provider": "openai", "model": "m", "fallback_used": True, "prompt_tokens": 3, "total_tokens": 4},
                                      "retrieved_chunks": [{"chunk_id": "c1"}, {"chunk_id": None}, {"chunk_id": ""}]}},
    }
    empty = {"timestamp": "2024-01-03T00:00:00.000000Z", "request_kind": "agent_run", "request": {"question": "E"}, "response": {"run_id": "run_2", "status": "aborted", "stop_reason": "no"}}
    return [query, agent, empty]


@pytest.fixture
def lines(tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(json.dumps(r) for r in log_records()) + "\n")
    return str(folder)


def test_rows_from_lines(spark, lines):
    rows = {r.question: r for r in run_rows(spark, lines=lines).collect()}
    q, a, e = rows["Q"], rows["A"], rows["E"]
    assert (q.request_kind, q.quality_mode, q.guardrail_abstained, q.guardrail_scope_status, q.guardrail_reason) == (
        "query", "default", True, "out_of_scope", "traced",
    )
    assert (q.display_cost_usd, q.cost_usd, q.trace_events, q.agent_step_count, q.data_source) == (0.0, 0.25, 1, None, "log lines")
    assert (a.latency_ms, a.retrieval_ms, a.generation_ms, a.trace_events, a.agent_step_count) == (9.0, 3.0, 6.0, 4, 4)
    assert (a.groundedness, a.cost_usd, a.cost_is_estimated, a.retrieval_mode, a.fallback_used, a.guardrail_abstained) == (3.0, 0.5, True, "hybrid", True, False)
    assert json.loads(a.agent_report_json)["run_id"] == "run_1" and q.agent_report_json is None
    assert (e.latency_ms, e.agent_step_count, e.guardrail_reason, e.provider, e.groundedness) == (0.0, 0, "no", None, None)


def test_agent_rows_for_tables(spark, lines):
    records = read_log_lines(spark, lines)
    logs = {r.query_log_id: r for r in agent_log_rows(records).collect()}
    assert (logs["run_1"].latency_ms, logs["run_1"].retrieved_chunk_ids, logs["run_1"].reranker_type, logs["run_1"].answer) == (2000.0, ["c1"], "own", "done")
    assert len(logs["run_1"].trace_json) == 6
    assert (logs["run_2"].fallback_used, logs["run_2"].answer, logs["run_2"].total_tokens, logs["run_2"].agent_step_count) == (False, "", 0, 0)
    scores = agent_evaluation_rows(records).collect()
    assert [(s.query_log_id, s.groundedness_score, s.citation_score, s.latency_ms, s.notes) for s in scores] == [("run_1", 3.0, 0.0, 5.0, "grounded")]


def responses(spark):
    row = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    none = F.lit(None).cast("string")
    values = dict(
        task=F.lit("t"), quality_mode=F.lit("m"), prompt_version=F.lit("v1"), provider=F.when(F.col("query_id") == "q2", "guardrail").otherwise("openai"),
        model=F.lit("gpt"), abstained=F.col("query_id") == "q2", reranker_type=F.lit("pass_through"), reranker_model=none, reranker_top_k=F.lit(None).cast("int"),
        fallback_used=F.lit(False), fallback_provider=none, fallback_model=none, routing_reason=F.lit("r"), routing_notes=none, question=F.lit("Q"), answer=F.lit("A"),
        latency_ms=F.lit(4.0), prompt_tokens=F.lit(1), completion_tokens=F.lit(2), total_tokens=F.lit(3), retrieved_chunk_ids=F.array(F.lit("c")),
        trace_json=F.lit(None).cast(TRACE_TYPE), created_at=F.lit("2024-05-01").cast("timestamp"), groundedness_score=F.lit(3.0), answer_relevance_score=F.lit(1.0),
        citation_score=F.lit(0.0), completeness_score=F.lit(2.0), estimated_cost_usd=F.lit(0.5), input_cost_usd=F.lit(0.25), output_cost_usd=F.lit(0.25),
        pricing_source=F.lit("card"), cost_is_estimated=F.lit(False), provider_reported_cost_usd=F.lit(None).cast("double"), provider_generation_id=none, provider_usage_source=none,
    )
    return row.withColumns(values)


def test_log_tables_and_clearing(spark, tmp_path, lines):
    logs, scores = query_log_rows(responses(spark)), evaluation_rows(responses(spark)).filter("query_log_id = 'q1'")
    folder = str(tmp_path / "tables")
    append_log(logs, scores, folder)
    append_log(logs.withColumn("query_log_id", F.concat("query_log_id", F.lit("x"))), scores.limit(0), folder)
    rows = run_rows(spark, tables=folder).orderBy("provider").collect()
    assert len(rows) == 4 and {r.data_source for r in rows} == {"tables"}
    assert [r.guardrail_abstained for r in rows] == [True, True, False, False]
    assert sorted(r.cost_usd for r in rows if r.cost_usd is not None) == [0.5]
    assert [r.model for r in rows if r.guardrail_abstained] == [None, None]
    direct = run_rows_from_tables(logs, scores)
    assert direct.columns == list(RUN_COLUMNS) and direct.count() == 2
    # Agent runs go into the same tables.
    records = read_log_lines(spark, lines)
    append_log(agent_log_rows(records), agent_evaluation_rows(records), folder)
    agents = {r.agent_run_id: r for r in run_rows(spark, tables=folder).filter("request_kind = 'agent_run'").collect()}
    assert (agents["run_1"].latency_ms, agents["run_1"].trace_events, agents["run_1"].groundedness, agents["run_2"].groundedness) == (2000.0, 6, 3.0, None)
    append_log_lines(read_log_lines(spark, lines), str(tmp_path / "copy"))
    assert read_log_lines(spark, str(tmp_path / "copy")).count() == 3
    clear_log(spark, folder, str(tmp_path / "copy"))
    assert spark.read.parquet(f"{folder}/evaluations").count() == spark.read.parquet(f"{folder}/query_logs").count() == 0
    assert read_log_lines(spark, str(tmp_path / "copy")).count() == 0
    with pytest.raises(ValueError):
        run_rows(spark)


ROWS = (
    "question string, request_kind string, quality_mode string, retrieval_mode string, model string, reranker_type string, guardrail_scope_status string, agent_status string, "
    "latency_ms double, retrieval_ms double, generation_ms double, groundedness double, answer_relevance double, citation_score double, completeness_score double, "
    "display_cost_usd double, fallback_used boolean, guardrail_abstained boolean"
)


def summary_rows(spark):
    def row(question, mode, latency, fallback, abstained, cost=None):
        return (question, "query", mode, None, "m", "p", None, None, latency, 1.0, 2.0, None, 1.0, 0.0, 0.5, cost, fallback, abstained)

    return spark.createDataFrame(
        [row("a", "x", 1.0, True, False, 0.5), row(None, "x", 2.05, None, True), row("c", None, 4.0, None, False), row("d", "y", 8.0, False, False)], ROWS
    )


def test_summaries(spark):
    rows = summary_rows(spark)
    got = {r.quality_mode: r for r in group_summary(rows, "quality_mode").collect()}
    assert (got["x"].requests, got["x"].avg_latency_ms, got["x"].fallback_rate, got["x"].abstention_rate, got["x"].avg_cost_usd) == (1, 1.5, 100.0, 50.0, 0.5)
    assert (got[None].requests, got[None].fallback_rate, got[None].avg_groundedness, got[None].avg_cost_usd) == (1, 0.0, None, None)
    everything = all_group_summaries(rows)
    for dimension in ("quality_mode", "model", "retrieval_mode"):
        mine = everything.filter(F.col("dimension") == dimension).drop("dimension").collect()
        assert sorted(map(repr, (tuple(r) for r in mine))) == sorted(map(repr, (tuple(r) for r in group_summary(rows, dimension).collect())))
    top = headline(rows).first()
    assert (top.requests, top.fallback_rate, top.abstention_rate, top.avg_latency_ms) == (4, 25.0, 25.0, 15.05 / 4)
    nothing = headline(rows.filter("false")).first()
    assert (nothing.requests, nothing.avg_latency_ms, nothing.fallback_rate) == (0, 0.0, 0.0)


def test_filters(spark, lines):
    rows = run_rows_from_log(read_log_lines(spark, lines))
    assert [r[0] for r in filter_options(rows, "quality_mode").collect()] == ["default", "fast"]
    assert filter_rows(rows, {"task": ["t"], "model": []}).count() == 2
    assert [r.question for r in filter_rows(rows, {}, fallback_only=True).collect()] == ["A"]
    assert [r.question for r in filter_rows(rows, {}, abstentions_only=True).collect()] == ["Q"]
    with pytest.raises(ValueError):
        filter_rows(rows, {"question": ["x"]})


def documents(spark, rows):
    frame = spark.createDataFrame(rows, "document_id bigint, task string, source_path string, title string, content string")
    return frame.drop("content"), plain_chunks(frame)


def contents(spark, folder):
    return {r.chunk_id: r.content for r in read_corpus(spark, folder, "chunks").collect()}


@pytest.mark.parametrize("buckets", [2, 499])
def test_replace_in_store(spark, tmp_path, buckets):
    """With few directories sources share them, with many a replaced source leaves one empty."""
    folder = str(tmp_path / "store")
    write_corpus(*documents(spark, [(i, "t", f"s{i}", "T", f"text {i}") for i in range(30)]), folder, buckets)
    new = [(100, "t", "s3", "T", "new"), (101, "other", "s4", "T", "moved"), (102, "t", "s5", "T", ""), (103, "t", "s99", "T", "added")]
    for _ in range(2):  # replacing is idempotent
        replace_in_store(spark, folder, *documents(spark, new))
        expected = {f"s{i}::chunk::0": f"text {i}" for i in range(30)} | {"s3::chunk::0": "new", "s4::chunk::0": "moved", "s99::chunk::0": "added"}
        del expected["s5::chunk::0"]
        assert contents(spark, folder) == expected
        assert read_corpus(spark, folder, "documents").count() == 31
    found = find_document(spark, folder, "s4").collect()
    assert [(r.document_id, r.task) for r in found] == [(101, "other")]


def test_term_tables(spark, tmp_path):
    chunks = spark.createDataFrame(
        [(f"c{i}", "t", f"alpha word{i} beta" if i % 2 else f"alpha word{i}", None, None) for i in range(40)],
        "chunk_id string, task string, content string, article_number string, clause_number array<bigint>",
    )
    folder = str(tmp_path / "terms")
    stored = chunks.withColumn("source_path", F.col("chunk_id"))
    write_corpus(stored.select("task", "source_path"), stored, folder, terms=8)
    asked = spark.createDataFrame([("q", "t", ["beta", "word7"], None, None)], "query_id string, task string, terms array<string>, article_number string, clause_number string")
    posted, statistics = read_term_tables(spark, folder, asked.select(F.explode("terms").alias("term")))
    direct = bm25_topk(asked, analyzed(chunks), term_statistics(chunks), 5).orderBy("rank").collect()
    assert bm25_topk(asked, posted, statistics, 5).orderBy("rank").collect() == direct
    assert direct[0].chunk_id == "c7"


def test_text_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("zwei\nß", encoding="utf-8")
    (tmp_path / "a.txt").write_text("one", encoding="utf-8")
    (tmp_path / "c.md").write_text("no", encoding="utf-8")
    rows = read_text_documents(spark, str(tmp_path)).collect()
    assert [(r.source.rsplit("/", 1)[1], r.content) for r in rows] == [("a.txt", "one"), ("b.txt", "zwei\nß")]


def test_streams_equal_batch(spark, tmp_path, lines):
    target, checkpoint = str(tmp_path / "rows"), str(tmp_path / "cp")
    append_run_rows(stream_log_lines(spark, lines, 1), target, checkpoint).awaitTermination()
    (tmp_path / "lines" / "b.jsonl").write_text(json.dumps(log_records()[0]) + "\n")
    append_run_rows(stream_log_lines(spark, lines, 1), target, checkpoint).awaitTermination()
    batch = run_rows_from_log(read_log_lines(spark, lines))
    assert sorted(map(repr, spark.read.parquet(target).select(*RUN_COLUMNS).collect())) == sorted(map(repr, batch.collect()))
    publish_summary(stream_log_lines(spark, lines, 1), "quality_mode", str(tmp_path / "sum"), str(tmp_path / "cp2")).awaitTermination()
    streamed = read_summary(spark, str(tmp_path / "sum"))
    wanted = group_summary(batch, "quality_mode").select(*streamed.columns)
    assert sorted(map(repr, streamed.collect())) == sorted(map(repr, wanted.collect()))


def test_stream_replaces_documents(spark, tmp_path):
    folder, inbox = str(tmp_path / "store"), str(tmp_path / "inbox")
    write_corpus(*documents(spark, [(i, "t", f"s{i}", "T", f"text {i}") for i in range(4)]), folder)
    arriving = [(9, "t", "s1", "T", "late", 2), (9, "t", "s1", "T", "early", 1), (8, "t", "s8", "T", "fresh", 1)]
    spark.createDataFrame(arriving, "document_id bigint, task string, source_path string, title string, content string, version int").write.json(inbox)
    stream = spark.readStream.schema("document_id bigint, task string, source_path string, title string, content string, version int").json(inbox)
    replace_from_stream(stream, folder, str(tmp_path / "cp")).awaitTermination()
    assert contents(spark, folder) == {
        "s0::chunk::0": "text 0", "s1::chunk::0": "late", "s2::chunk::0": "text 2", "s3::chunk::0": "text 3", "s8::chunk::0": "fresh",
    }


def test_summary_stays_whole_over_batches_failures_and_compaction(spark, tmp_path, monkeypatch):
    from corpusmill.streaming import log_stream

    monkeypatch.setattr(log_stream, "MOST_CHANGES", 2)
    inbox, target, checkpoint = tmp_path / "lines", str(tmp_path / "sum"), str(tmp_path / "cp")
    inbox.mkdir()

    def publish():
        log_stream.publish_summary(stream_log_lines(spark, str(inbox), 1), "quality_mode", target, checkpoint).awaitTermination()

    def wanted():
        batch = run_rows_from_log(read_log_lines(spark, str(inbox)))
        streamed = read_summary(spark, target)
        assert sorted(map(repr, streamed.collect())) == sorted(map(repr, group_summary(batch, "quality_mode").select(*streamed.columns).collect()))

    records = log_records()
    for at in range(4):
        (inbox / f"{at}.jsonl").write_text(json.dumps(records[at % len(records)]) + "\n")
        publish()
        wanted()
    before = sorted(map(repr, read_summary(spark, target).collect()))
    (inbox / "9.jsonl").write_text("".join(json.dumps(record) + "\n" for record in records))

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(log_stream, "write_once", fail)
        with pytest.raises(Exception, match="lost"):
            publish()
    assert sorted(map(repr, read_summary(spark, target).collect())) == before
    publish()
    wanted()
    assert len(list((tmp_path / "sum").glob("changes-*"))) + len(list((tmp_path / "sum").glob("whole-*"))) <= 6


def test_broadcast_bound_counts_bytes(spark):
    from corpusmill.session import fits_broadcast

    frame = spark.createDataFrame([("x" * 1000, [1.0] * 10, 1)] * 10, "a string, b array<double>, c int")
    assert fits_broadcast(frame) and not fits_broadcast(frame, max_rows=9)
    assert not fits_broadcast(frame, max_bytes=10_000) and fits_broadcast(frame, max_bytes=20_000)
    assert fits_broadcast(frame.limit(0))
