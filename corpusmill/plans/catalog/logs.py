"""Queries of log analytics, agent runs and the streaming forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.agent import (
    checkpoint_decision, run_latency_ms, run_outcome, stored_trace,
)
from corpusmill.functions.guardrails import scope_label
from corpusmill.functions.lexical_query import article_asked
from corpusmill.functions.quality import groundedness
from corpusmill.functions.trace import TRACE_TYPE, summarize_trace
from corpusmill.operators.corpus import plain_chunks
from corpusmill.operators.evidence import EVIDENCE_DEPTH
from corpusmill.operators.runlog import (
    LISTED_COLUMNS, agent_evaluation_rows, agent_log_rows, agent_run, filter_options, filter_rows,
    run_log, run_rows_from_log, run_rows_from_tables,
)
from corpusmill.operators.summaries import (
    DIMENSIONS, HEADLINE_DIGITS, MEANS, RATES, all_group_summaries, group_summary, shown_headline,
)
from corpusmill.plans.catalog import inputs, retrieval
from corpusmill.plans.catalog.inputs import DOCUMENTS_SQL, QUESTIONS_SQL, cut_sql
from corpusmill.plans.catalog.requests import EVIDENCE_SQL, exchanges, EXCHANGES_SQL, earlier_turns, scope_sql
from corpusmill.schemas import LOG_RECORD, STEPS
from corpusmill.session import scratch_folder
from corpusmill.sources.corpus_store import read_corpus, write_corpus
from corpusmill.sources.stored_search import bounded_bm25
from corpusmill.streaming.corpus_stream import replace_from_stream
from corpusmill.streaming.log_stream import append_run_rows, publish_summary, read_summary, stream_log_lines

def _event(stage: str, duration: Column, **metadata: Column) -> Column:
    parts = [part for name, value in metadata.items() for part in (F.lit(name), value.cast("string"))]
    entries = F.create_map(*parts) if parts else F.create_map()
    return F.struct(
        F.lit(stage).alias("stage"), duration.alias("duration_ms"), entries.cast("map<string,string>").alias("metadata")
    )


def _trace() -> Column:
    """Stage events of a request made from an event row; some requests have none."""
    value, event = F.col("value"), F.col("event_id")
    kind = F.col("event_type")
    events = F.array(
        _event("guardrail.scope", value * 0.03125),
        _event("guardrail.scope.result", F.lit(0.0), status=F.when(event % 6 == 0, "out_of_scope").otherwise("in_scope"),
               reason=F.when(event % 5 == 0, "").otherwise(F.concat(F.lit("scope of "), kind))),
        _event("retrieval.search", value * 0.25, retrieval_mode=F.when(event % 4 == 0, "dense").when(event % 4 == 1, "hybrid")),
        _event("retrieval.search", value * 0.125, retrieval_mode=F.lit("lexical")),
        _event("retrieval.rerank", value * 0.0625, retrieved_count=F.lit(4)),
        _event("guardrail.evidence.result", F.lit(0.0), status=F.when(event % 9 == 0, F.lit(None)).otherwise(F.lit("sufficient")),
               reason=F.lit("evidence")),
        _event("generation.primary", value * 0.5),
    )
    return F.when(event % 13 != 0, F.slice(events, 1, (event % 7 + 1).cast("int"))).cast(TRACE_TYPE)


TRACED_SQL = """
traced AS (
  SELECT *,
    CASE WHEN event_id % 13 <> 0 THEN CAST(event_id % 7 + 1 AS BIGINT) ELSE 0 END AS n_events
  FROM events
),
summarized AS (
  SELECT *,
    CASE WHEN n_events >= 3 THEN value * 0.25::DOUBLE ELSE 0 END + CASE WHEN n_events >= 4 THEN value * 0.125::DOUBLE ELSE 0 END
      + CASE WHEN n_events >= 5 THEN value * 0.0625::DOUBLE ELSE 0 END AS retrieval_ms,
    CASE WHEN n_events >= 7 THEN value * 0.5::DOUBLE ELSE 0 END AS generation_ms,
    CASE WHEN n_events >= 3 AND event_id % 4 = 0 THEN 'dense' WHEN n_events >= 3 AND event_id % 4 = 1 THEN 'hybrid'
      WHEN n_events >= 4 THEN 'lexical' END AS retrieval_mode,
    CASE WHEN n_events >= 2 THEN CASE WHEN event_id % 6 = 0 THEN 'out_of_scope' ELSE 'in_scope' END END AS scope_status,
    CASE WHEN n_events >= 6 AND event_id % 9 <> 0 THEN 'sufficient' END AS evidence_status,
    CASE WHEN n_events >= 2 AND event_id % 5 <> 0 THEN 'scope of ' || event_type WHEN n_events >= 6 THEN 'evidence' END AS reason
  FROM traced
)"""


def trace_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = summarize_trace(_trace())
    return inputs.table(spark, folder, "events").select("event_id", summary.alias("s")).select(
        "event_id", F.coalesce("s.retrieval_ms", F.lit(0.0)).alias("retrieval_ms"), F.coalesce("s.generation_ms", F.lit(0.0)).alias("generation_ms"),
        "s.retrieval_mode", "s.scope_status", "s.evidence_status", "s.reason",
    )


TRACE_SUMMARY = f"""WITH {TRACED_SQL}
SELECT event_id, retrieval_ms, generation_ms, retrieval_mode, scope_status, evidence_status, reason FROM summarized"""


def log_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Log and evaluation tables made from events; every third request has no evaluation."""
    events = inputs.table(spark, folder, "events")
    user, event = F.col("user_id"), F.col("event_id")
    none = F.lit(None).cast("string")
    agent = F.col("event_type") == "signup"
    logs = events.select(
        event.cast("string").alias("query_log_id"),
        F.when(agent, "agent_run").otherwise("query").alias("request_kind"),
        F.when(user % 2 == 0, "legal_qa").otherwise("support").alias("task"),
        F.col("event_type").alias("quality_mode"), F.lit("v1").alias("prompt_version"),
        F.when(agent, F.concat(F.lit("agent_"), event.cast("string"))).alias("agent_run_id"),
        F.when(agent, "answer_and_draft_email").alias("agent_task_type"), none.alias("instruction"),
        F.when(agent, F.when(event % 2 == 0, "completed").otherwise("aborted")).alias("agent_status"),
        none.alias("agent_stop_reason"), F.when(agent, 3).alias("agent_step_count"), none.alias("agent_report_json"),
        F.when(user % 4 == 0, "guardrail").when(user % 4 == 2, "openai").when(user % 4 == 3, "openrouter").alias("selected_provider"),
        F.when(user % 4 != 0, F.concat(F.lit("model-"), (user % 3).cast("string"))).alias("model_name"),
        F.when(user % 5 == 0, "cross_encoder").otherwise("pass_through").alias("reranker_type"),
        F.when(user % 5 == 0, "ranker").alias("reranker_model"), F.when(user % 5 == 0, 4).alias("reranker_top_k"),
        F.when(user % 7 != 0, F.col("event_type") == "error").alias("fallback_used"), none.alias("fallback_provider"), none.alias("fallback_model"),
        F.concat(F.lit("routed "), F.col("event_type")).alias("routing_reason"),
        F.when(event % 10 != 0, F.concat(F.lit("Question "), event.cast("string"))).alias("question"),
        F.col("value").alias("latency_ms"), _trace().alias("trace_json"), F.col("ts").alias("created_at"),
    )
    scores = events.filter(event % 3 != 0).select(
        event.cast("string").alias("query_log_id"),
        (event % 4).cast("double").alias("groundedness_score"), (user % 50 / 10.0).alias("answer_relevance_score"),
        (event % 3 * 1.5).alias("citation_score"), (event % 11 / 4.0).alias("completeness_score"),
        (F.col("value") / 1024).alias("estimated_cost_usd"),
        F.when(event % 5 == 0, F.col("value") / 512).alias("provider_reported_cost_usd"),
        F.lit("card").alias("pricing_source"), none.alias("provider_usage_source"), none.alias("provider_generation_id"),
        (event % 2 == 0).alias("cost_is_estimated"),
    )
    return logs, scores


def rows_from_tables(spark: SparkSession, folder: str) -> DataFrame:
    return run_rows_from_tables(*log_tables(spark, folder))


TABLE_ROWS_SQL = f"""{TRACED_SQL},
run_rows AS (
  SELECT ts AS "timestamp", CASE WHEN agent THEN 'agent_run' ELSE 'query' END AS request_kind,
    CASE WHEN user_id % 2 = 0 THEN 'legal_qa' ELSE 'support' END AS task, event_type AS quality_mode, 'v1' AS prompt_version,
    CASE WHEN agent THEN 'agent_' || event_id END AS agent_run_id, CASE WHEN agent THEN 'answer_and_draft_email' END AS agent_task_type,
    CASE WHEN agent THEN CASE WHEN event_id % 2 = 0 THEN 'completed' ELSE 'aborted' END END AS agent_status,
    CASE WHEN agent THEN 3 END AS agent_step_count,
    CASE user_id % 4 WHEN 0 THEN 'guardrail' WHEN 2 THEN 'openai' WHEN 3 THEN 'openrouter' END AS provider,
    CASE WHEN user_id % 4 <> 0 THEN 'model-' || (user_id % 3) END AS model,
    CASE WHEN user_id % 5 = 0 THEN 'cross_encoder' ELSE 'pass_through' END AS reranker_type,
    CASE WHEN user_id % 5 = 0 THEN 'ranker' END AS reranker_model, CASE WHEN user_id % 5 = 0 THEN 4 END AS reranker_top_k,
    CASE WHEN user_id % 7 <> 0 THEN event_type = 'error' END AS fallback_used, 'routed ' || event_type AS routing_reason,
    value AS latency_ms, retrieval_ms, generation_ms, retrieval_mode, user_id % 4 = 0 AS guardrail_abstained,
    scope_status AS guardrail_scope_status, evidence_status AS guardrail_evidence_status,
    coalesce(reason, 'routed ' || event_type) AS guardrail_reason, n_events::INT AS trace_events,
    CASE WHEN scored THEN (event_id % 4)::DOUBLE END AS groundedness, CASE WHEN scored THEN (user_id % 50)::DOUBLE / 10 END AS answer_relevance,
    CASE WHEN scored THEN (event_id % 3)::DOUBLE * 1.5::DOUBLE END AS citation_score, CASE WHEN scored THEN (event_id % 11)::DOUBLE / 4 END AS completeness_score,
    CASE WHEN scored THEN value / 1024 END AS cost_usd, CASE WHEN scored AND event_id % 5 = 0 THEN value / 512 END AS provider_reported_cost_usd,
    CASE WHEN scored THEN CASE WHEN event_id % 5 = 0 THEN value / 512 ELSE value / 1024 END END AS display_cost_usd,
    CASE WHEN scored THEN 'card' END AS pricing_source, CASE WHEN scored THEN event_id % 2 = 0 END AS cost_is_estimated,
    CASE WHEN event_id % 10 <> 0 THEN 'Question ' || event_id END AS question
  FROM (SELECT *, event_type = 'signup' AS agent, event_id % 3 <> 0 AS scored FROM summarized)
)"""

SHOWN = (
    "timestamp", "request_kind", "task", "quality_mode", "agent_run_id", "agent_status", "agent_step_count", "provider", "model",
    "reranker_type", "reranker_model", "reranker_top_k", "fallback_used", "routing_reason", "latency_ms", "retrieval_ms", "generation_ms",
    "retrieval_mode", "guardrail_abstained", "guardrail_scope_status", "guardrail_evidence_status", "guardrail_reason", "trace_events",
    "groundedness", "answer_relevance", "citation_score", "completeness_score", "cost_usd", "provider_reported_cost_usd",
    "display_cost_usd", "pricing_source", "cost_is_estimated", "question",
)
SHOWN_SQL = ", ".join(f'"{name}"' for name in SHOWN)


def shown(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), *SHOWN[1:], *more)


def run_rows(spark: SparkSession, folder: str) -> DataFrame:
    return shown(rows_from_tables(spark, folder))


RUN_ROWS = f"WITH {TABLE_ROWS_SQL} SELECT {SHOWN_SQL} FROM run_rows"


def run_listing(spark: SparkSession, folder: str) -> DataFrame:
    listing = run_log(rows_from_tables(spark, folder))
    assert listing.columns == list(LISTED_COLUMNS)
    return listing


_ABSENT = ("agent_stop_reason", "fallback_provider", "fallback_model", "provider_usage_source", "provider_generation_id", "instruction")
RUN_LISTING = f"""WITH {TABLE_ROWS_SQL} SELECT {", ".join(
    f'NULL::VARCHAR AS {name}' if name in _ABSENT else f'"{name}"' for name in LISTED_COLUMNS)} FROM run_rows ORDER BY "timestamp" DESC"""


def run_filter(spark: SparkSession, folder: str) -> DataFrame:
    chosen = filter_rows(
        rows_from_tables(spark, folder),
        {"request_kind": ["query"], "task": [], "quality_mode": ["error", "view"], "retrieval_mode": ["dense", "lexical"]},
        fallback_only=True,
    )
    return shown(chosen)


RUN_FILTER = f"""WITH {TABLE_ROWS_SQL} SELECT {SHOWN_SQL} FROM run_rows
WHERE request_kind = 'query' AND quality_mode IN ('error', 'view') AND retrieval_mode IN ('dense', 'lexical') AND fallback_used"""


def run_abstentions(spark: SparkSession, folder: str) -> DataFrame:
    return shown(filter_rows(rows_from_tables(spark, folder), {"reranker_model": ["ranker"]}, abstentions_only=True))


RUN_ABSTENTIONS = f"WITH {TABLE_ROWS_SQL} SELECT {SHOWN_SQL} FROM run_rows WHERE reranker_model = 'ranker' AND guardrail_abstained"


def options(spark: SparkSession, folder: str) -> DataFrame:
    return filter_options(rows_from_tables(spark, folder), "retrieval_mode")


FILTER_OPTIONS = f"WITH {TABLE_ROWS_SQL} SELECT DISTINCT retrieval_mode FROM run_rows WHERE retrieval_mode <> '' ORDER BY 1"


def agent_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of the newest agent request."""
    rows = rows_from_tables(spark, folder)
    newest = rows.filter("request_kind = 'agent_run'").agg(F.max_by("agent_run_id", "timestamp")).first()[0]
    return agent_run(rows, newest).select("agent_run_id", "agent_status", "question")


AGENT_LOOKUP = f"""WITH {TABLE_ROWS_SQL} SELECT agent_run_id, agent_status, question FROM run_rows
WHERE agent_run_id = (SELECT arg_max(agent_run_id, "timestamp") FROM run_rows WHERE request_kind = 'agent_run')"""


def _rounded_mean_sql(value: str, digits: int) -> str:
    return f"round_even({value} * 1e{digits}::DOUBLE, 0) / 1e{digits}::DOUBLE"


def kpi_headline(spark: SparkSession, folder: str) -> DataFrame:
    return shown_headline(rows_from_tables(spark, folder))


HEADLINE_SQL = {
    "avg_latency_ms": "avg(latency_ms)", "avg_retrieval_ms": "avg(retrieval_ms)", "avg_generation_ms": "avg(generation_ms)",
    "avg_groundedness": "avg(groundedness)", "avg_relevance": "avg(answer_relevance)",
    "fallback_rate": "avg(coalesce(fallback_used, false)::INT) * 100", "abstention_rate": "avg(guardrail_abstained::INT) * 100",
    "avg_cost_usd": "avg(display_cost_usd)",
}
KPI_HEADLINE = f"WITH {TABLE_ROWS_SQL} SELECT count(*) AS requests, " + ", ".join(
    f"{_rounded_mean_sql(value, HEADLINE_DIGITS[name])} AS {name}" for name, value in HEADLINE_SQL.items()
) + " FROM run_rows"


SUMMARY_SQL = ", ".join(
    ["count(question) AS requests"]
    + [f"{_rounded_mean_sql(f'avg({column})', digits)} AS {name}" for name, column, digits in MEANS]
    + [f"coalesce({_rounded_mean_sql(f'avg({column}::INT) * 100', digits)}, 0) AS {name}" for name, column, digits in RATES]
)


def kpi_grouped(spark: SparkSession, folder: str) -> DataFrame:
    return group_summary(rows_from_tables(spark, folder), "retrieval_mode")


KPI_GROUPED = f"WITH {TABLE_ROWS_SQL} SELECT retrieval_mode, {SUMMARY_SQL} FROM run_rows GROUP BY 1"


def kpi_all_groups(spark: SparkSession, folder: str) -> DataFrame:
    return all_group_summaries(rows_from_tables(spark, folder))


KPI_ALL_GROUPS = f"WITH {TABLE_ROWS_SQL} " + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS value, {SUMMARY_SQL} FROM run_rows GROUP BY {d}" for d in DIMENSIONS
)


def _steps() -> Column:
    """Steps of an agent run made from an event row: one to three planned steps and, at times, an unknown one."""
    event, value = F.col("event_id"), F.col("value")
    kinds = F.array(F.lit("retrieve_context"), F.lit("answer_question"), F.lit("draft_email"), F.lit("summarize"))

    def step(kind: Column, at: Column) -> Column:
        output = F.struct(
            F.when(kind == "retrieve_context", "hybrid").alias("retrieval_mode"),
            F.when(kind == "retrieve_context", F.lit(4)).alias("retrieval_count"),
            F.when((kind == "retrieve_context") & (event % 2 == 0), "cross_encoder").alias("reranker_type"),
            F.when(kind == "answer_question", "openai").alias("provider"),
            F.when(kind == "answer_question", "gpt-4.1").alias("model"),
            F.when(kind == "answer_question", value / 2048).alias("estimated_cost_usd"),
            F.when((kind == "answer_question") & (event % 5 == 0), value / 1024).alias("provider_reported_cost_usd"),
        )
        checkpoint = F.when(
            event % 4 != 3,
            F.struct(
                F.when(at == 2, "abort").otherwise("allow").alias("decision"), F.concat(F.lit("after "), kind).alias("reason"),
                F.when(kind == "answer_question", F.create_map(F.lit("groundedness"), (event % 4).cast("double"), F.lit("completeness"), F.lit(1.25)))
                .otherwise(F.create_map().cast("map<string,double>")).alias("metrics"),
            ),
        )
        return F.struct(
            F.concat(F.lit("step_"), (at + 1).cast("string")).alias("step_id"), kind.alias("step_type"), F.lit("completed").alias("status"),
            F.when(at != 1, value * 0.25).otherwise(value * 0.5).alias("latency_ms"), output.alias("output"), checkpoint.alias("checkpoint"),
        )

    return F.transform(F.slice(kinds, 1, (event % 5).cast("int")), step)


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The log as JSON text, one line per event: sign-ups are agent runs, all else queries."""
    event, user, value = F.col("event_id"), F.col("user_id"), F.col("value")
    started = F.col("ts").cast("timestamp")
    agent = F.col("event_type") == "signup"
    request = F.struct(
        F.concat(F.lit("Question "), event.cast("string")).alias("question"), F.when(user % 2 == 0, "legal_qa").otherwise("support").alias("task"),
        F.when(user % 3 == 0, "").when(user % 3 == 1, F.col("event_type")).alias("quality_mode"), F.lit("v1").alias("prompt_version"),
        F.when(user % 5 == 0, "cross_encoder").alias("reranker_type"),
    )
    routing = F.struct(
        F.when(user % 4 == 0, "guardrail").otherwise("openai").alias("selected_provider"), F.lit("gpt-4.1").alias("selected_model"),
        (F.col("event_type") == "error").alias("fallback_used"), F.concat(F.lit("routed "), F.col("event_type")).alias("reason"),
    )
    guardrails = F.when(event % 8 != 0, F.struct(
        F.when(event % 3 == 0, "in_scope").when(event % 3 == 1, "").alias("scope_status"), F.when(event % 3 == 0, "sufficient").alias("evidence_status"),
        F.when(event % 6 != 0, user % 4 == 0).alias("abstained"), F.when(event % 12 == 1, "stated").alias("reason"),
    ))
    evaluation = F.struct(
        (event % 4).cast("double").alias("groundedness_score"), (user % 50 / 10.0).alias("answer_relevance_score"), F.lit(1.5).alias("citation_score"),
        (event % 11 / 4.0).alias("completeness_score"), (value / 1024).alias("estimated_cost_usd"),
        F.when(event % 5 == 0, value / 512).alias("provider_reported_cost_usd"), F.lit("card").alias("pricing_source"), F.lit(True).alias("cost_is_estimated"),
    )
    query_response = F.struct(
        value.alias("latency_ms"), routing.alias("routing"), F.struct(F.lit("pass_through").alias("reranker_type")).alias("reranking"),
        guardrails.alias("guardrails"), F.struct(_trace().alias("events")).alias("trace"), evaluation.alias("evaluation"),
    )
    stop = F.when(event % 2 == 1, F.lit("stopped early"))
    agent_response = F.struct(
        F.concat(F.lit("agent_"), event.cast("string")).alias("run_id"), F.lit("answer_and_draft_email").alias("task_type"),
        F.when(event % 2 == 0, "completed").otherwise("aborted").alias("status"), stop.alias("stop_reason"),
        started.alias("created_at"), (started + F.expr("INTERVAL '1.234567' SECOND")).alias("completed_at"), _steps().alias("steps"),
        F.when(event % 2 == 0, F.struct(
            F.lit("an answer").alias("answer"),
            F.struct(F.lit("openai").alias("provider"), F.lit("gpt-4.1").alias("model"), (user % 2 == 0).alias("fallback_used"),
                     F.lit(7).alias("prompt_tokens"), F.lit(5).alias("completion_tokens"), F.lit(12).alias("total_tokens")).alias("answer_metadata"),
        )).alias("final_output"),
    )
    kind = F.when(agent, "agent_run").when(event % 2 == 0, "query")
    options_ = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

    def line(response: Column) -> Column:
        return F.to_json(F.struct(started.alias("timestamp"), kind.alias("request_kind"), request.alias("request"), response.alias("response")), options_)

    return inputs.table(spark, folder, "events").select(F.when(agent, line(agent_response)).otherwise(line(query_response)).alias("value"))


def log_records(spark: SparkSession, folder: str) -> DataFrame:
    parsed = F.from_json("value", LOG_RECORD)
    return log_lines(spark, folder).select(parsed.alias("r")).select("r.*")


def run_rows_log(spark: SparkSession, folder: str) -> DataFrame:
    return shown(run_rows_from_log(log_records(spark, folder)))


LOG_ROWS_SQL = f"""{TRACED_SQL},
log_rows AS (
  SELECT ts AS "timestamp", CASE WHEN agent THEN 'agent_run' ELSE 'query' END AS request_kind,
    CASE WHEN user_id % 2 = 0 THEN 'legal_qa' ELSE 'support' END AS task, CASE WHEN user_id % 3 = 1 THEN event_type ELSE 'default' END AS quality_mode,
    CASE WHEN agent THEN 'agent_' || event_id END AS agent_run_id,
    CASE WHEN agent THEN CASE WHEN event_id % 2 = 0 THEN 'completed' ELSE 'aborted' END END AS agent_status,
    CASE WHEN agent THEN event_id % 5 END::INT AS agent_step_count,
    CASE WHEN agent THEN CASE WHEN event_id % 2 = 0 THEN 'openai' END WHEN user_id % 4 = 0 THEN 'guardrail' ELSE 'openai' END AS provider,
    CASE WHEN NOT agent OR event_id % 2 = 0 THEN 'gpt-4.1' END AS model,
    CASE WHEN NOT agent THEN 'pass_through' WHEN user_id % 5 = 0 THEN 'cross_encoder' END AS reranker_type,
    NULL::VARCHAR AS reranker_model, NULL::INT AS reranker_top_k,
    CASE WHEN NOT agent THEN event_type = 'error' WHEN event_id % 2 = 0 THEN user_id % 2 = 0 END AS fallback_used,
    CASE WHEN agent THEN stop ELSE 'routed ' || event_type END AS routing_reason,
    CASE WHEN NOT agent THEN value ELSE coalesce(list_sum(list_transform(range(steps), lambda i: value * CASE WHEN i = 1 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END)), 0) END AS latency_ms,
    CASE WHEN NOT agent THEN retrieval_ms WHEN steps >= 1 THEN value * 0.25::DOUBLE ELSE 0 END AS retrieval_ms,
    CASE WHEN NOT agent THEN generation_ms ELSE CASE WHEN steps >= 2 THEN value * 0.5::DOUBLE ELSE 0 END + CASE WHEN steps >= 3 THEN value * 0.25::DOUBLE ELSE 0 END END AS generation_ms,
    CASE WHEN NOT agent THEN retrieval_mode WHEN steps >= 1 THEN 'hybrid' END AS retrieval_mode,
    CASE WHEN agent THEN false WHEN event_id % 8 <> 0 AND event_id % 6 <> 0 THEN user_id % 4 = 0 ELSE user_id % 4 = 0 END AS guardrail_abstained,
    CASE WHEN agent THEN NULL WHEN event_id % 8 <> 0 AND event_id % 3 = 0 THEN 'in_scope' ELSE scope_status END AS guardrail_scope_status,
    CASE WHEN agent THEN NULL WHEN event_id % 8 <> 0 AND event_id % 3 = 0 THEN 'sufficient' ELSE evidence_status END AS guardrail_evidence_status,
    CASE WHEN agent THEN stop WHEN event_id % 8 <> 0 AND event_id % 12 = 1 THEN 'stated' ELSE coalesce(reason, 'routed ' || event_type) END AS guardrail_reason,
    CASE WHEN agent THEN steps ELSE n_events END::INT AS trace_events,
    CASE WHEN NOT agent OR (steps >= 2 AND event_id % 4 <> 3) THEN (event_id % 4)::DOUBLE END AS groundedness,
    CASE WHEN NOT agent THEN (user_id % 50)::DOUBLE / 10 END AS answer_relevance, CASE WHEN NOT agent THEN 1.5::DOUBLE END AS citation_score,
    CASE WHEN NOT agent THEN (event_id % 11)::DOUBLE / 4 WHEN steps >= 2 AND event_id % 4 <> 3 THEN 1.25::DOUBLE END AS completeness_score,
    CASE WHEN NOT agent THEN value / 1024 WHEN steps >= 2 THEN value / 2048 END AS cost_usd,
    CASE WHEN event_id % 5 = 0 THEN CASE WHEN NOT agent THEN value / 512 WHEN steps >= 2 THEN value / 1024 END END AS provider_reported_cost_usd,
    CASE WHEN NOT agent THEN CASE WHEN event_id % 5 = 0 THEN value / 512 ELSE value / 1024 END
      WHEN steps >= 2 THEN CASE WHEN event_id % 5 = 0 THEN value / 1024 ELSE value / 2048 END END AS display_cost_usd,
    CASE WHEN NOT agent THEN 'card' END AS pricing_source,
    CASE WHEN NOT agent THEN true ELSE NOT (event_id % 5 = 0 AND steps >= 2) END AS cost_is_estimated,
    'Question ' || event_id AS question
  FROM (SELECT *, event_type = 'signup' AS agent, event_id % 5 AS steps, CASE WHEN event_id % 2 = 1 THEN 'stopped early' END AS stop FROM summarized)
)"""
RUN_ROWS_LOG = f"WITH {LOG_ROWS_SQL} SELECT {SHOWN_SQL} FROM log_rows"


def _agent_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with the steps a run of that number would have."""
    events = inputs.table(spark, folder, "events")
    return events.withColumn("steps", F.from_json(F.to_json(_steps()), STEPS))


def agent_trace(spark: SparkSession, folder: str) -> DataFrame:
    exploded = _agent_events(spark, folder).select("event_id", F.posexplode(stored_trace(F.col("steps"))).alias("at", "e"))
    return exploded.select(
        "event_id", F.col("at").cast("bigint").alias("at"), "e.stage", "e.duration_ms",
        *[F.try_element_at("e.metadata", F.lit(n)).alias(n) for n in ("step_id", "status", "retrieval_mode", "retrieval_count", "model", "decision", "reason")],
    )


AGENT_TRACE = """WITH steps AS (
  SELECT event_id, value, i, ['retrieve_context', 'answer_question', 'draft_email', 'summarize'][i + 1] AS kind
  FROM events, unnest(range(event_id % 5)) u(i)
),
both_kinds AS (
  SELECT event_id, i, 0 AS part, CASE kind WHEN 'retrieve_context' THEN 'retrieval.search' WHEN 'answer_question' THEN 'generation.answer'
      WHEN 'draft_email' THEN 'generation.draft_email' ELSE 'agent.' || kind END AS stage,
    value * CASE WHEN i = 1 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS duration_ms, 'step_' || (i + 1) AS step_id, 'completed' AS status,
    CASE WHEN i = 0 THEN 'hybrid' END AS retrieval_mode, CASE WHEN i = 0 THEN '4' END AS retrieval_count, CASE WHEN i = 1 THEN 'gpt-4.1' END AS model,
    NULL AS decision, NULL AS reason
  FROM steps
  UNION ALL
  SELECT event_id, i, 1, 'checkpoint.' || kind, 0, NULL, NULL, NULL, NULL, NULL, CASE WHEN i = 2 THEN 'abort' ELSE 'allow' END, 'after ' || kind
  FROM steps WHERE event_id % 4 <> 3
)
SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY i, part) - 1 AS "at", stage, duration_ms, step_id, status,
  retrieval_mode, retrieval_count, model, decision, reason FROM both_kinds"""


def agent_log_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Log and evaluation rows of the agent runs in the log lines, side by side."""
    records = log_records(spark, folder)
    logs = agent_log_rows(records).select(
        "query_log_id", "agent_status", "agent_stop_reason", "agent_step_count", "selected_provider", "reranker_type", "fallback_used", "answer",
        "latency_ms", "total_tokens", F.size("trace_json").alias("trace_events"),
    )
    scores = agent_evaluation_rows(records).select(
        "query_log_id", "groundedness_score", "completeness_score", "estimated_cost_usd", "cost_is_estimated", F.col("latency_ms").alias("step_ms"), "notes"
    )
    return logs.join(scores, "query_log_id", "left")


AGENT_LOG_TABLES = """WITH runs AS (
  SELECT *, event_id % 5 AS steps, event_id % 2 = 0 AS done, event_id % 4 <> 3 AS checked FROM events WHERE event_type = 'signup'
)
SELECT 'agent_' || event_id AS query_log_id, CASE WHEN done THEN 'completed' ELSE 'aborted' END AS agent_status,
  CASE WHEN NOT done THEN 'stopped early' END AS agent_stop_reason, steps::INT AS agent_step_count, CASE WHEN done THEN 'openai' END AS selected_provider,
  CASE WHEN steps >= 1 AND event_id % 2 = 0 THEN 'cross_encoder' WHEN user_id % 5 = 0 THEN 'cross_encoder' END AS reranker_type,
  done AND user_id % 2 = 0 AS fallback_used, CASE WHEN done THEN 'an answer' ELSE '' END AS answer, 1234.57::DOUBLE AS latency_ms,
  CASE WHEN done THEN 12 ELSE 0 END AS total_tokens, (steps * CASE WHEN checked THEN 2 ELSE 1 END)::INT AS trace_events,
  CASE WHEN checked AND steps >= 2 THEN (event_id % 4)::DOUBLE END AS groundedness_score, CASE WHEN checked AND steps >= 2 THEN 1.25::DOUBLE END AS completeness_score,
  CASE WHEN checked AND steps >= 2 THEN value / 2048 END AS estimated_cost_usd, CASE WHEN checked AND steps >= 2 THEN event_id % 5 <> 0 END AS cost_is_estimated,
  CASE WHEN checked AND steps >= 2 THEN CASE WHEN value = 0 THEN 1234.57::DOUBLE ELSE value * 0.5::DOUBLE END END AS step_ms,
  CASE WHEN checked AND steps >= 2 THEN 'after answer_question' END AS notes
FROM runs"""


def run_latency(spark: SparkSession, folder: str) -> DataFrame:
    """Runs last as many milliseconds as their value says; every ninth is open."""
    start = F.col("ts").cast("timestamp")
    end = F.when(F.col("event_id") % 9 != 0, F.timestamp_micros(F.unix_micros(start) + (F.col("value") * 1000).cast("bigint")))
    return inputs.table(spark, folder, "events").select("event_id", run_latency_ms(start, end).alias("latency_ms"))


RUN_LATENCY = """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE
  CAST(format('{:.2f}', trunc(value * 1000)::DOUBLE / 1e6::DOUBLE * 1000) AS DOUBLE) END AS latency_ms FROM events"""


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    """Three steps per user turn with what their checks look at."""
    earlier = earlier_turns(spark, folder, EVIDENCE_DEPTH)
    asked = exchanges(spark, folder)
    seen = asked.select("query_id", article_asked(F.col("question")).alias("asked")).join(
        earlier.filter(F.col("rank") <= EVIDENCE_DEPTH), "query_id"
    ).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.bool_or(F.col("article_number") == F.col("asked")), F.lit(False)).alias("in_top")
    )
    kinds = F.array(*[F.lit(k) for k in ("retrieve_context", "answer_question", "draft_email", "other")])
    steps = asked.join(seen, "query_id", "left").select("*", F.posexplode(kinds).alias("at", "step_type"))
    n_chunks = F.coalesce("n_chunks", F.lit(0))
    decision = checkpoint_decision(
        F.col("step_type"), F.col("question"), n_chunks, F.coalesce("in_top", F.lit(False)), F.col("answer"),
        groundedness(F.col("answer"), n_chunks > 0), F.lit("Subject"), F.when(F.col("turn") > 3, " ").otherwise("Body"),
    )
    return steps.withColumn("check", decision)


def agent_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    return _checked(spark, folder).select("query_id", "step_type", "check.decision", "check.reason")


CHECKED_SQL = f"""{EXCHANGES_SQL},{scope_sql("exchanges")},
seen AS (
  SELECT s.query_id, any_value(turn) AS turn, any_value(answer) AS answer, any_value(asked) AS asked, any_value(scope_status) AS scope_status,
    any_value(scope_reason) AS scope_reason, count(e.rank) AS n_chunks, coalesce(bool_or(e.article_number = s.asked), false) AS in_top
  FROM scoped s LEFT JOIN earlier e ON e.query_id = s.query_id AND e.rank <= 3 GROUP BY 1
),
labelled AS (SELECT *, {EVIDENCE_SQL} FROM seen),
checked AS (
  SELECT query_id, scope_status, scope_reason, 0 AS pos, 'retrieve_context' AS step_type, CASE evidence_status WHEN 'sufficient' THEN 'allow' ELSE 'abort' END AS decision,
    CASE WHEN n_chunks = 0 THEN 'No supporting context was retrieved.' ELSE evidence_reason END AS reason FROM labelled
  UNION ALL
  SELECT query_id, scope_status, scope_reason, 1, 'answer_question', CASE WHEN trim(answer) <> '' AND n_chunks > 0 THEN 'allow' ELSE 'abort' END,
    CASE WHEN trim(answer) <> '' AND n_chunks > 0 THEN 'Answer step produced grounded output.' ELSE 'Answer step failed groundedness or returned an empty answer.' END FROM labelled
  UNION ALL
  SELECT query_id, scope_status, scope_reason, 2, 'draft_email', CASE WHEN turn > 3 THEN 'abort' ELSE 'allow' END,
    CASE WHEN turn > 3 THEN 'Email draft was empty.' ELSE 'Email draft generated successfully.' END FROM labelled
  UNION ALL
  SELECT query_id, scope_status, scope_reason, 3, 'other', 'abort', 'Unsupported step type ''other''.' FROM labelled
)"""
AGENT_CHECKPOINTS = f"WITH {CHECKED_SQL} SELECT query_id, step_type, decision, reason FROM checked"


def agent_status(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome of runs of three steps; some second steps end with an error."""
    error = F.when((F.col("at") == 1) & (F.col("turn") % 3 == 2), F.lit("timeout"))
    step = F.struct("at", F.col("step_type"), error.alias("error"), F.when(error.isNull(), F.col("check.decision")).alias("decision"), F.col("check.reason").alias("reason"))
    runs = _checked(spark, folder).filter("at < 3").groupBy("query_id", "question", "task").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    outcome = run_outcome(scope_label(F.col("question"), F.col("task")), F.col("steps"))
    return runs.select("query_id", outcome.alias("o")).select("query_id", "o.status", "o.stop_reason", F.col("o.step_count").cast("bigint").alias("step_count"))


AGENT_STATUS = f"""WITH {CHECKED_SQL},
ended AS (
  SELECT *, split_part(query_id, ':', 2)::INT % 3 = 2 AND pos = 1 AS broke FROM checked WHERE pos < 3
),
first_end AS (
  SELECT query_id, any_value(scope_status) AS scope_status, any_value(scope_reason) AS scope_reason,
    min(pos) FILTER (WHERE broke OR decision <> 'allow') AS pos FROM ended GROUP BY 1
)
SELECT f.query_id, CASE WHEN f.scope_status <> 'in_scope' THEN 'aborted' WHEN f.pos IS NULL THEN 'completed' WHEN e.broke THEN 'failed' ELSE 'aborted' END AS status,
  CASE WHEN f.scope_status <> 'in_scope' THEN f.scope_reason WHEN e.broke THEN 'timeout' ELSE e.reason END AS stop_reason,
  CASE WHEN f.scope_status <> 'in_scope' THEN 0 ELSE coalesce(f.pos + 1, 3) END::BIGINT AS step_count
FROM first_end f LEFT JOIN ended e ON e.query_id = f.query_id AND e.pos = f.pos"""


def written_log(spark: SparkSession, folder: str) -> str:
    path = scratch_folder(spark, "log-lines")
    log_lines(spark, folder).write.text(path)
    return path


def stream_log_flatten(spark: SparkSession, folder: str) -> DataFrame:
    records = stream_log_lines(spark, written_log(spark, folder), files_per_trigger=3)
    target = scratch_folder(spark, "run-rows")
    append_run_rows(records, target, scratch_folder(spark, "checkpoint")).awaitTermination()
    return shown(spark.read.parquet(target))


def stream_kpi(spark: SparkSession, folder: str) -> DataFrame:
    records = stream_log_lines(spark, written_log(spark, folder), files_per_trigger=3)
    target = scratch_folder(spark, "summary")
    publish_summary(records, "quality_mode", target, scratch_folder(spark, "checkpoint")).awaitTermination()
    return read_summary(spark, target)


STREAM_KPI = f"WITH {LOG_ROWS_SQL} SELECT quality_mode, {SUMMARY_SQL} FROM log_rows GROUP BY 1"


def stream_replace(spark: SparkSession, folder: str) -> DataFrame:
    """All documents stored; those with a label arrive again as a stream, twice, the later version counts."""
    docs = inputs.documents(spark, folder)
    store = scratch_folder(spark, "store")
    write_corpus(docs.drop("content"), plain_chunks(docs), store, buckets=4)
    labels = inputs.table(spark, folder, "labels")
    versions = docs.join(labels, F.col("doc_id") == F.col("document_id")).withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    arriving = versions.withColumn("content", F.concat(F.lit("Version "), F.col("version").cast("string"), F.lit("\n"), F.col("content")))
    inbox = scratch_folder(spark, "inbox")
    arriving.select(*docs.columns, "version").write.parquet(inbox)
    stream = spark.readStream.schema(spark.read.parquet(inbox).schema).parquet(inbox)
    replace_from_stream(stream, store, scratch_folder(spark, "checkpoint")).awaitTermination()
    return read_corpus(spark, store, "chunks").select("chunk_id", "content")


STREAM_REPLACE = f"""WITH {DOCUMENTS_SQL},
merged AS (
  SELECT source_path, CASE WHEN l.doc_id IS NULL THEN content ELSE 'Version 2' || chr(10) || content END AS content
  FROM docs LEFT JOIN labels l ON l.doc_id = document_id
),{cut_sql("merged", "content", 800, 100, "cut")}
SELECT source_path || '::chunk::' || piece_no AS chunk_id, piece AS content FROM cut"""


def stream_search(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents arrive in three batches, the newest version in the first and an older one in the last; then BM25 over the stored terms."""
    docs = inputs.documents(spark, folder)
    store, inbox, checkpoint = (scratch_folder(spark, name) for name in ("store", "inbox", "checkpoint"))
    write_corpus(docs.drop("content"), plain_chunks(docs), store, buckets=4, terms=4)
    arriving = docs.join(inputs.table(spark, folder, "labels"), F.col("doc_id") == F.col("document_id")).select(*docs.columns)
    for number in (3, 1, 2):
        # The last batch also brings what no other has.
        some = arriving if number != 3 else arriving.filter("document_id % 3 <> 0")
        text = F.concat(F.lit(f"Version {number}\n"), F.col("content"))
        some.withColumn("content", text).withColumn("version", F.lit(number)).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(spark.read.parquet(inbox).schema).parquet(inbox)
        replace_from_stream(stream, store, checkpoint).awaitTermination()
    asked = retrieval.lexical_queries(inputs.questions(spark, folder))
    return retrieval.result(bounded_bm25(asked, spark, store, retrieval.TOP_K).found)


STREAM_SEARCH = f"""WITH {DOCUMENTS_SQL},
merged AS (
  SELECT d.* REPLACE (CASE WHEN l.doc_id IS NULL THEN content WHEN document_id % 3 = 0 THEN 'Version 2' || chr(10) || content
    ELSE 'Version 3' || chr(10) || content END AS content)
  FROM docs d LEFT JOIN labels l ON l.doc_id = document_id
),{cut_sql("merged", "content", 800, 100, "cut")},
chunks AS (SELECT source_path || '::chunk::' || piece_no AS chunk_id, task, piece AS content FROM cut),
{QUESTIONS_SQL},{retrieval.terms_sql("questions")},{retrieval.postings_sql()},{retrieval.BM25_SQL}
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM bm25_ranked WHERE rank <= {retrieval.TOP_K}"""

QUERIES = {
    "trace_summary": (trace_summary, TRACE_SUMMARY),
    "run_rows": (run_rows, RUN_ROWS),
    "run_rows_log": (run_rows_log, RUN_ROWS_LOG),
    "run_listing": (run_listing, RUN_LISTING),
    "run_filter": (run_filter, RUN_FILTER),
    "run_abstentions": (run_abstentions, RUN_ABSTENTIONS),
    "filter_options": (options, FILTER_OPTIONS),
    "agent_lookup": (agent_lookup, AGENT_LOOKUP),
    "kpi_headline": (kpi_headline, KPI_HEADLINE),
    "kpi_grouped": (kpi_grouped, KPI_GROUPED),
    "kpi_all_groups": (kpi_all_groups, KPI_ALL_GROUPS),
    "agent_trace": (agent_trace, AGENT_TRACE),
    "agent_log_tables": (agent_log_tables, AGENT_LOG_TABLES),
    "agent_checkpoints": (agent_checkpoints, AGENT_CHECKPOINTS),
    "agent_status": (agent_status, AGENT_STATUS),
    "run_latency": (run_latency, RUN_LATENCY),
    "stream_log_flatten": (stream_log_flatten, RUN_ROWS_LOG),
    "stream_kpi": (stream_kpi, STREAM_KPI),
    "stream_search": (stream_search, STREAM_SEARCH),
    "stream_replace": (stream_replace, STREAM_REPLACE),
}
