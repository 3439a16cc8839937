"""Summaries of the stage events a request leaves behind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACE_TYPE = "array<struct<stage: string, duration_ms: double, metadata: map<string,string>>>"


def stage_time(trace: Column, prefix: str) -> Column:
    """Total duration of the stages that start with ``prefix``."""
    matching = F.filter(trace, lambda event: event["stage"].startswith(prefix))
    return F.aggregate(
        matching,
        F.lit(0.0),
        lambda total, event: total + F.coalesce(event["duration_ms"], F.lit(0.0)),
    )


def _values(trace: Column, stages: tuple[str, ...], key: str) -> Column:
    return F.transform(
        F.filter(trace, lambda event: event["stage"].isin(*stages)),
        lambda event: F.try_element_at(event["metadata"], F.lit(key)),
    )


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


SCOPE_STAGE = "guardrail.scope.result"
EVIDENCE_STAGE = "guardrail.evidence.result"


def summarize_trace(trace: Column) -> Column:
    """struct<retrieval_ms, generation_ms, retrieval_mode, scope_status, evidence_status, reason>."""
    modes = F.filter(_values(trace, ("retrieval.search",), "retrieval_mode"), lambda m: m.isNotNull())
    reasons = F.filter(
        _values(trace, (SCOPE_STAGE, EVIDENCE_STAGE), "reason"), lambda r: F.coalesce(r, F.lit("")) != ""
    )
    return F.struct(
        stage_time(trace, "retrieval.").alias("retrieval_ms"),
        stage_time(trace, "generation.").alias("generation_ms"),
        _first(modes).alias("retrieval_mode"),
        F.try_element_at(_values(trace, (SCOPE_STAGE,), "status"), F.lit(-1)).alias("scope_status"),
        F.try_element_at(_values(trace, (EVIDENCE_STAGE,), "status"), F.lit(-1)).alias("evidence_status"),
        _first(reasons).alias("reason"),
    )
