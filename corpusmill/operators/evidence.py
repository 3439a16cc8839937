"""Evidence labels and abstentions for whole tables of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.guardrails import NO_EVIDENCE_ANSWER, OUT_OF_SCOPE_ANSWER, evidence_label
from corpusmill.functions.lexical_query import article_asked

#: Places of a list in which the asked article has to appear.
EVIDENCE_DEPTH = 3


def label_evidence(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Requests with ``evidence`` (status, reason).

    ``candidates(query_id, rank, article_number)``; only the first places of a list are looked at.
    """
    asked = requests.select("query_id", article_asked(F.col("question")).alias("asked"))
    top = candidates.filter(F.col("rank") <= EVIDENCE_DEPTH).select("query_id", "article_number")
    seen = (
        asked.join(top, "query_id")
        .groupBy("query_id")
        .agg(
            F.count(F.lit(1)).alias("n_chunks"),
            F.coalesce(F.bool_or(F.col("article_number") == F.col("asked")), F.lit(False)).alias("in_top"),
        )
    )
    return requests.join(seen, "query_id", "left").select(
        *requests.columns,
        evidence_label(F.col("question"), F.col("n_chunks"), F.coalesce("in_top", F.lit(False))).alias("evidence"),
    )


def abstention_reason(scope: Column, evidence: Column) -> Column:
    """Why a request is not answered, or null when it is."""
    return F.when(scope["status"] != "in_scope", scope["reason"]).when(
        evidence["status"] != "sufficient", evidence["reason"]
    )


def abstention_answer(scope: Column) -> Column:
    """The fixed text given instead of an answer."""
    return F.when(scope["status"] != "in_scope", OUT_OF_SCOPE_ANSWER).otherwise(NO_EVIDENCE_ANSWER)


def with_abstentions(answered: DataFrame) -> DataFrame:
    """Responses in which requests stopped by a guardrail carry the fixed answer and no costs.

    ``answered`` has scope, evidence and the response columns of requests that went through; the
    columns of the others may hold anything.
    """
    reason = abstention_reason(F.col("scope"), F.col("evidence"))
    stopped = reason.isNotNull()
    fixed: dict[str, Column] = {
        "answer": abstention_answer(F.col("scope")),
        "provider": F.lit("guardrail"),
        "model": F.lit("guardrail"),
        "fallback_used": F.lit(False),
        "fallback_provider": F.lit(None).cast("string"),
        "fallback_model": F.lit(None).cast("string"),
        "routing_reason": reason,
        "routing_notes": reason,
        "latency_ms": F.lit(0.0),
        **{name: F.lit(0) for name in ("prompt_tokens", "completion_tokens", "total_tokens")},
        **{
            name: F.lit(0.0)
            for name in (
                "groundedness_score", "answer_relevance_score", "citation_score",
                "completeness_score", "estimated_cost_usd", "input_cost_usd", "output_cost_usd",
            )
        },
        "pricing_source": F.lit(None).cast("string"),
        "cost_is_estimated": F.lit(True),
        "provider_reported_cost_usd": F.lit(None).cast("double"),
        "provider_generation_id": F.lit(None).cast("string"),
        "provider_usage_source": F.lit(None).cast("string"),
    }
    replaced = [
        F.when(stopped, fixed[name]).otherwise(F.col(name)).alias(name) if name in fixed else F.col(name)
        for name in answered.columns
    ]
    evidence_status = F.when(F.col("scope.status") == "in_scope", F.col("evidence.status"))
    return answered.select(
        *replaced,
        stopped.alias("abstained"),
        reason.alias("guardrail_reason"),
        F.col("scope.status").alias("scope_status"),
        evidence_status.alias("evidence_status"),
    )
