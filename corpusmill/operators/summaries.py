"""Headline figures and grouped summaries of run rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dimensions summarised side by side.
DIMENSIONS = (
    "request_kind", "quality_mode", "retrieval_mode", "model", "reranker_type",
    "guardrail_scope_status", "agent_status",
)

#: Summary column, run column and decimals of each mean.
MEANS = (
    ("avg_latency_ms", "latency_ms", 1),
    ("avg_retrieval_ms", "retrieval_ms", 1),
    ("avg_generation_ms", "generation_ms", 1),
    ("avg_groundedness", "groundedness", 2),
    ("avg_relevance", "answer_relevance", 2),
    ("avg_citation", "citation_score", 2),
    ("avg_completeness", "completeness_score", 2),
    ("avg_cost_usd", "display_cost_usd", 6),
)
RATES = (("fallback_rate", "fallback_used", 1), ("abstention_rate", "guardrail_abstained", 1))


#: Decimals the headline figures are shown with.
HEADLINE_DIGITS = {
    "avg_latency_ms": 1, "avg_retrieval_ms": 1, "avg_generation_ms": 1, "avg_groundedness": 2,
    "avg_relevance": 2, "fallback_rate": 1, "abstention_rate": 1, "avg_cost_usd": 6,
}


def shown_headline(rows: DataFrame) -> DataFrame:
    """The headline rounded as it is shown."""
    return headline(rows).select(
        "requests",
        *[(F.rint(F.col(n) * 10.0**d) / 10.0**d).alias(n) for n, d in HEADLINE_DIGITS.items()],
    )


def headline(rows: DataFrame) -> DataFrame:
    """One row of overall figures; a missing flag counts as false, no rows give zeros."""
    def share(flag: str) -> Column:
        return F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("double")) * 100

    means = {
        "avg_latency_ms": F.avg("latency_ms"),
        "avg_retrieval_ms": F.avg("retrieval_ms"),
        "avg_generation_ms": F.avg("generation_ms"),
        "avg_groundedness": F.avg("groundedness"),
        "avg_relevance": F.avg("answer_relevance"),
        "fallback_rate": share("fallback_used"),
        "abstention_rate": share("guardrail_abstained"),
        "avg_cost_usd": F.avg("display_cost_usd"),
    }
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("requests"),
        *[F.when(n == 0, F.lit(0.0)).otherwise(mean).alias(name) for name, mean in means.items()],
    )


def _parts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums and counts per combination of keys, from which means of any coarser grouping follow."""
    totals = [F.count("question").alias("requests")]
    for _, column, _ in (*MEANS, *RATES):
        value = F.col(column).cast("double")
        totals += [F.sum(value).alias(f"sum_{column}"), F.count(value).alias(f"n_{column}")]
    return rows.groupBy(*keys).agg(*totals)


def _from_parts(digits: int, column: str, factor: int = 1) -> Column:
    mean = F.sum(f"sum_{column}") / F.nullif(F.sum(f"n_{column}"), F.lit(0)) * factor
    scale = 10.0**digits
    return F.rint(mean * scale) / scale


def _measures() -> list[Column]:
    means = [_from_parts(digits, column).alias(name) for name, column, digits in MEANS]
    # A group without any flag has rate 0, but missing flags among others do not count.
    rates = [
        F.coalesce(_from_parts(digits, column, 100), F.lit(0.0)).alias(name) for name, column, digits in RATES
    ]
    return [F.sum("requests").alias("requests"), *means, *rates]


def group_summary(rows: DataFrame, dimension: str) -> DataFrame:
    """Means and rates per value of one dimension; rows without a value form a group too."""
    return _parts(rows, [dimension]).groupBy(dimension).agg(*_measures())


def all_group_summaries(rows: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """``group_summary`` of several dimensions as rows of (dimension, value, measures).

    The run rows are reduced once to sums per combination of values; only those few sums are
    regrouped per dimension, instead of copying every run row for each of them.
    """
    parts = _parts(rows, dimensions)
    unfolded = parts.withColumn(
        "_entry",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("dimension"), F.col(name).cast("string").alias("value"))
                    for name in dimensions
                ]
            )
        ),
    )
    return unfolded.groupBy("_entry.dimension", "_entry.value").agg(*_measures())
