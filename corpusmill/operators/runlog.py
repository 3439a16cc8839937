"""Run rows: one flat row per logged request or agent run, from tables or from log lines."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.functions.agent import ANSWER, RETRIEVE, first_step, log_trace, run_latency_ms, stored_trace
from corpusmill.functions.pricing import display_cost
from corpusmill.functions.trace import summarize_trace
from corpusmill.schemas import QUERY_LOGS

# Columns of a run row in order.
RUN_COLUMNS = (
    "timestamp", "request_kind", "task", "quality_mode", "prompt_version", "agent_run_id",
    "agent_task_type", "instruction", "agent_status", "agent_stop_reason", "agent_step_count",
    "agent_report_json", "provider", "model", "reranker_type", "reranker_model", "reranker_top_k",
    "fallback_used", "fallback_provider", "fallback_model", "routing_reason", "latency_ms",
    "retrieval_ms", "generation_ms", "retrieval_mode", "guardrail_abstained",
    "guardrail_scope_status", "guardrail_evidence_status", "guardrail_reason", "trace_events",
    "groundedness", "answer_relevance", "citation_score", "completeness_score", "cost_usd",
    "provider_reported_cost_usd", "display_cost_usd", "pricing_source", "provider_usage_source",
    "provider_generation_id", "cost_is_estimated", "question",
)

# Columns of the run log listing.
LISTED_COLUMNS = (
    "timestamp", "request_kind", "task", "quality_mode", "prompt_version", "agent_run_id",
    "agent_task_type", "agent_status", "agent_stop_reason", "agent_step_count", "provider", "model",
    "retrieval_mode", "reranker_type", "reranker_model", "reranker_top_k", "guardrail_abstained",
    "guardrail_scope_status", "guardrail_evidence_status", "guardrail_reason", "fallback_used",
    "fallback_provider", "fallback_model", "routing_reason", "latency_ms", "retrieval_ms",
    "generation_ms", "trace_events", "groundedness", "answer_relevance", "citation_score",
    "completeness_score", "cost_usd", "provider_reported_cost_usd", "provider_usage_source",
    "provider_generation_id", "pricing_source", "cost_is_estimated", "instruction", "question",
)

# Columns a listing can be filtered on.
FILTER_COLUMNS = (
    "request_kind", "task", "quality_mode", "prompt_version", "provider", "model", "retrieval_mode",
    "reranker_type", "reranker_model", "guardrail_scope_status",
)


def _run_row(frame: DataFrame, **columns: Column) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return frame.select(*[columns.get(name, nothing).alias(name) for name in RUN_COLUMNS])


def _filled(value: Column) -> Column:
    """Null for empty text, so that the next choice applies."""
    return F.nullif(value, F.lit(""))


def run_rows_from_tables(query_logs: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Run rows of the log table with its evaluations, one to one; requests without keep nulls."""
    scores = evaluations.select(
        "query_log_id", F.struct(*[c for c in evaluations.columns if c != "query_log_id"]).alias("e")
    )
    joined = query_logs.join(scores, "query_log_id", "left").withColumn(
        "s", summarize_trace(F.col("trace_json"))
    )
    same = (
        "request_kind", "task", "quality_mode", "prompt_version", "agent_run_id", "agent_task_type",
        "instruction", "agent_status", "agent_stop_reason", "agent_step_count", "agent_report_json",
        "reranker_type", "reranker_model", "reranker_top_k", "fallback_used", "fallback_provider",
        "fallback_model", "routing_reason", "latency_ms", "question",
    )
    return _run_row(
        joined,
        timestamp=F.col("created_at"),
        **{name: F.col(name) for name in same},
        provider=F.col("selected_provider"),
        model=F.col("model_name"),
        retrieval_ms=F.coalesce("s.retrieval_ms", F.lit(0.0)),
        generation_ms=F.coalesce("s.generation_ms", F.lit(0.0)),
        retrieval_mode=F.col("s.retrieval_mode"),
        guardrail_abstained=F.coalesce(F.col("selected_provider") == "guardrail", F.lit(False)),
        guardrail_scope_status=F.col("s.scope_status"),
        guardrail_evidence_status=F.col("s.evidence_status"),
        guardrail_reason=F.coalesce("s.reason", "routing_reason"),
        trace_events=F.coalesce(F.size("trace_json"), F.lit(0)),
        groundedness=F.col("e.groundedness_score"),
        answer_relevance=F.col("e.answer_relevance_score"),
        citation_score=F.col("e.citation_score"),
        completeness_score=F.col("e.completeness_score"),
        cost_usd=F.col("e.estimated_cost_usd"),
        provider_reported_cost_usd=F.col("e.provider_reported_cost_usd"),
        display_cost_usd=display_cost(F.col("e.provider_reported_cost_usd"), F.col("e.estimated_cost_usd")),
        pricing_source=F.col("e.pricing_source"),
        provider_usage_source=F.col("e.provider_usage_source"),
        provider_generation_id=F.col("e.provider_generation_id"),
        cost_is_estimated=F.col("e.cost_is_estimated"),
    )


def _agent_columns() -> dict[str, Column]:
    response, request = F.col("response"), F.col("request")
    output, metrics = F.col("a.output"), F.col("a.checkpoint.metrics")
    called = response["final_output"]["answer_metadata"]
    reported, estimated = output["provider_reported_cost_usd"], output["estimated_cost_usd"]

    def metric(name: str) -> Column:
        return F.try_element_at(metrics, F.lit(name))

    return {
        "agent_run_id": response["run_id"],
        "agent_task_type": response["task_type"],
        "instruction": request["instruction"],
        "agent_status": response["status"],
        "agent_stop_reason": response["stop_reason"],
        "agent_step_count": F.coalesce(F.size("response.steps"), F.lit(0)),
        "agent_report_json": F.to_json("response"),
        "provider": called["provider"],
        "model": called["model"],
        "reranker_type": request["reranker_type"],
        "fallback_used": called["fallback_used"],
        "routing_reason": response["stop_reason"],
        "latency_ms": F.coalesce(
            F.aggregate(
                "response.steps", F.lit(0.0), lambda total, step: total + F.coalesce(step["latency_ms"], F.lit(0.0))
            ),
            F.lit(0.0),
        ),
        "guardrail_abstained": F.lit(False),
        "guardrail_scope_status": F.col("s.scope_status"),
        "guardrail_evidence_status": F.col("s.evidence_status"),
        "guardrail_reason": response["stop_reason"],
        "groundedness": metric("groundedness"),
        "answer_relevance": metric("answer_relevance"),
        "citation_score": metric("citation_score"),
        "completeness_score": metric("completeness"),
        "cost_usd": estimated,
        "provider_reported_cost_usd": reported,
        "display_cost_usd": display_cost(reported, estimated),
        "pricing_source": output["pricing_source"],
        "provider_usage_source": output["provider_usage_source"],
        "provider_generation_id": output["provider_generation_id"],
        "cost_is_estimated": reported.isNull(),
    }


def _query_columns() -> dict[str, Column]:
    routing, evaluation = F.col("response.routing"), F.col("response.evaluation")
    reranking, guardrails = F.col("response.reranking"), F.col("response.guardrails")
    reported, estimated = evaluation["provider_reported_cost_usd"], evaluation["estimated_cost_usd"]
    guarded = routing["selected_provider"] == "guardrail"
    return {
        "provider": routing["selected_provider"],
        "model": routing["selected_model"],
        **{name: reranking[name] for name in ("reranker_type", "reranker_model", "reranker_top_k")},
        **{name: routing[name] for name in ("fallback_used", "fallback_provider", "fallback_model")},
        "routing_reason": routing["reason"],
        "latency_ms": F.col("response.latency_ms"),
        "guardrail_abstained": F.coalesce(guardrails["abstained"], guarded, F.lit(False)),
        "guardrail_scope_status": F.coalesce(_filled(guardrails["scope_status"]), "s.scope_status"),
        "guardrail_evidence_status": F.coalesce(_filled(guardrails["evidence_status"]), "s.evidence_status"),
        "guardrail_reason": F.coalesce(_filled(guardrails["reason"]), "s.reason", routing["reason"]),
        "groundedness": evaluation["groundedness_score"],
        "answer_relevance": evaluation["answer_relevance_score"],
        **{
            name: evaluation[name]
            for name in (
                "citation_score", "completeness_score", "pricing_source", "provider_usage_source",
                "provider_generation_id", "cost_is_estimated", "provider_reported_cost_usd",
            )
        },
        "cost_usd": estimated,
        "display_cost_usd": display_cost(reported, estimated),
    }


def run_rows_from_log(records: DataFrame) -> DataFrame:
    """Run rows of log lines, batch or stream; a line without kind is a query.

    Both kinds of line share one pass: each column is chosen per row.
    """
    is_agent = F.coalesce(F.col("request_kind") == "agent_run", F.lit(False))
    trace = F.when(is_agent, log_trace(F.col("response.steps"))).otherwise(F.col("response.trace.events"))
    prepared = (
        records.withColumn("_trace", trace)
        .withColumn("s", summarize_trace(F.col("_trace")))
        .withColumn("a", F.when(is_agent, first_step(F.col("response.steps"), ANSWER)))
    )
    shared = {
        "timestamp": F.col("timestamp"),
        "request_kind": F.when(is_agent, "agent_run").otherwise("query"),
        "task": F.col("request.task"),
        "quality_mode": F.coalesce(_filled(F.col("request.quality_mode")), F.lit("default")),
        "prompt_version": F.col("request.prompt_version"),
        "question": F.col("request.question"),
        "retrieval_ms": F.coalesce("s.retrieval_ms", F.lit(0.0)),
        "generation_ms": F.coalesce("s.generation_ms", F.lit(0.0)),
        "retrieval_mode": F.col("s.retrieval_mode"),
        "trace_events": F.coalesce(F.size("_trace"), F.lit(0)),
    }
    agents, queries = _agent_columns(), _query_columns()
    chosen = {
        name: F.when(is_agent, agents.get(name)).otherwise(queries.get(name, F.lit(None)))
        for name in RUN_COLUMNS
        if name not in shared
    }
    return _run_row(prepared, **shared, **chosen)


def filter_options(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values a column can be filtered on, in order."""
    value = F.col(column)
    return rows.filter(value.isNotNull() & (value != "")).select(column).distinct().orderBy(column)


def filter_rows(
    rows: DataFrame, selected: Mapping[str, Collection[str]], fallback_only: bool = False,
    abstentions_only: bool = False,
) -> DataFrame:
    """Rows matching all selections; an empty selection lets everything through."""
    chosen = rows
    for column, values in selected.items():
        if column not in FILTER_COLUMNS:
            raise ValueError(f"no filter on {column!r}")
        if values:
            chosen = chosen.filter(F.col(column).isin(*values))
    if fallback_only:
        chosen = chosen.filter(F.col("fallback_used"))
    return chosen.filter(F.col("guardrail_abstained")) if abstentions_only else chosen


def run_log(rows: DataFrame) -> DataFrame:
    """The listing columns, newest first."""
    return rows.select(*LISTED_COLUMNS).orderBy(F.desc("timestamp"))


def agent_run(rows: DataFrame, run_id: str) -> DataFrame:
    """The row of one agent run."""
    return rows.filter((F.col("request_kind") == "agent_run") & (F.col("agent_run_id") == run_id))


def _log_table(frame: DataFrame) -> DataFrame:
    """The columns of the log table in order, with typed nulls for those a kind of run does not have."""
    present = set(frame.columns)
    return frame.select(
        *[
            (F.col(field.name) if field.name in present else F.lit(None)).cast(field.dataType).alias(field.name)
            for field in StructType.fromDDL(QUERY_LOGS)
        ]
    )


def query_log_rows(responses: DataFrame) -> DataFrame:
    """Log table rows of answered requests; ``query_id`` is their key."""
    named = responses.withColumns(
        {
            "query_log_id": F.col("query_id"),
            "request_kind": F.lit("query"),
            "selected_provider": F.col("provider"),
            "model_name": F.when(~F.col("abstained"), F.col("model")),
            "status": F.lit("completed"),
        }
    )
    return _log_table(named)


def evaluation_rows(responses: DataFrame) -> DataFrame:
    """Evaluation rows of answered requests, one per request."""
    return responses.select(
        F.col("query_id").alias("query_log_id"),
        "groundedness_score", "answer_relevance_score", "citation_score", "completeness_score",
        "estimated_cost_usd", "input_cost_usd", "output_cost_usd", "pricing_source",
        "cost_is_estimated", "provider_reported_cost_usd", "provider_generation_id",
        "provider_usage_source", "latency_ms", "prompt_tokens", "completion_tokens", "total_tokens",
        F.col("routing_notes").alias("notes"),
    )


def _with_answer(records: DataFrame) -> DataFrame:
    runs = records.filter(F.col("request_kind") == "agent_run")
    steps = F.col("response.steps")
    return runs.withColumn("_answer", first_step(steps, ANSWER)).withColumn(
        "_search", first_step(steps, RETRIEVE)
    )


def _count(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def agent_log_rows(records: DataFrame) -> DataFrame:
    """Log table rows of agent runs; missing parts of a report count as empty."""
    run = F.col("response")
    called = F.col("response.final_output.answer_metadata")
    listed = F.transform("response.final_output.retrieved_chunks", lambda c: c["chunk_id"])
    rows = _with_answer(records).select(
        run["run_id"].alias("query_log_id"),
        F.lit("agent_run").alias("request_kind"),
        "request.task", "request.quality_mode", "request.prompt_version",
        run["run_id"].alias("agent_run_id"),
        run["task_type"].alias("agent_task_type"),
        "request.instruction",
        run["status"].alias("agent_status"),
        run["stop_reason"].alias("agent_stop_reason"),
        _count(F.size(run["steps"])).alias("agent_step_count"),
        F.to_json("response").alias("agent_report_json"),
        called["provider"].alias("selected_provider"),
        called["model"].alias("model_name"),
        F.coalesce(_filled(F.col("_search.output.reranker_type")), F.col("request.reranker_type")).alias("reranker_type"),
        F.coalesce(called["fallback_used"], F.lit(False)).alias("fallback_used"),
        run["stop_reason"].alias("routing_reason"),
        "request.question",
        F.coalesce(run["final_output"]["answer"], F.lit("")).alias("answer"),
        run_latency_ms(run["created_at"], run["completed_at"]).alias("latency_ms"),
        *[_count(called[n]).alias(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")],
        F.coalesce(
            F.filter(listed, lambda c: F.coalesce(c, F.lit("")) != ""), F.array().cast("array<string>")
        ).alias("retrieved_chunk_ids"),
        stored_trace(run["steps"]).alias("trace_json"),
        run["status"].alias("status"),
        F.col("timestamp").alias("created_at"),
    )
    return _log_table(rows)


def agent_evaluation_rows(records: DataFrame) -> DataFrame:
    """Evaluation rows of the agent runs whose answer step was checked."""
    checked = _with_answer(records).filter(F.col("_answer.checkpoint").isNotNull())
    called = F.col("response.final_output.answer_metadata")
    output = F.col("_answer.output")

    def metric(name: str) -> Column:
        return F.coalesce(F.try_element_at(F.col("_answer.checkpoint.metrics"), F.lit(name)), F.lit(0.0))

    run_ms = run_latency_ms(F.col("response.created_at"), F.col("response.completed_at"))
    return checked.select(
        F.col("response.run_id").alias("query_log_id"),
        metric("groundedness").alias("groundedness_score"),
        metric("answer_relevance").alias("answer_relevance_score"),
        metric("citation_score").alias("citation_score"),
        metric("completeness").alias("completeness_score"),
        F.coalesce(output["estimated_cost_usd"], F.lit(0.0)).alias("estimated_cost_usd"),
        F.lit(0.0).alias("input_cost_usd"),
        F.lit(0.0).alias("output_cost_usd"),
        output["pricing_source"].alias("pricing_source"),
        output["provider_reported_cost_usd"].isNull().alias("cost_is_estimated"),
        output["provider_reported_cost_usd"].alias("provider_reported_cost_usd"),
        output["provider_generation_id"].alias("provider_generation_id"),
        output["provider_usage_source"].alias("provider_usage_source"),
        F.coalesce(F.nullif(F.col("_answer.latency_ms"), F.lit(0.0)), run_ms).alias("latency_ms"),
        *[_count(called[n]).alias(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")],
        F.col("_answer.checkpoint.reason").alias("notes"),
    )
