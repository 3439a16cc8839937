"""Evaluation reports and their comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_COMPARED = ("hit_rate@1", "hit_rate@3", "mrr", "precision@1", "precision@3")


def generation_method(samples: DataFrame, metadata: str = "metadata") -> DataFrame:
    """One row: the generation method all samples share, "mixed", or null when none is recorded."""
    method = F.trim(F.try_element_at(F.col(metadata), F.lit("generation_method")))
    span = samples.select(method.alias("method")).agg(
        F.min("method").alias("first"), F.max("method").alias("last")
    )
    return span.select(
        F.when(F.col("first") == F.col("last"), F.col("first"))
        .when(F.col("first").isNotNull(), F.lit("mixed"))
        .alias("dataset_generation_method")
    )


def metric_map(names: Sequence[str]) -> Column:
    """Metric columns as one map."""
    return F.map_from_arrays(
        F.array(*[F.lit(name) for name in names]), F.array(*[F.col(f"`{name}`") for name in names])
    )


def compare_reports(
    reports: DataFrame, experiment_id: str, metrics: Sequence[str] = DEFAULT_COMPARED
) -> DataFrame:
    """One row per report of an experiment, chosen metrics as columns, ordered by file name.

    ``reports`` has the report fields and ``file``, see ``sources.reports``.
    """
    def setting(name: str) -> Column:
        return F.try_element_at("config", F.lit(name)).alias(name)

    return (
        reports.filter(F.try_element_at("config", F.lit("experiment_id")) == experiment_id)
        .select(
            setting("experiment_id"), setting("dataset_generation_method"), setting("retrieval_mode"),
            setting("reranker_type"), "n_samples",
            *[F.try_element_at("aggregate", F.lit(name)).alias(name) for name in metrics],
            "file",
        )
        .orderBy("file")
    )


def pivot_metrics(long_form: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Reports as rows and metrics as columns from rows of (report, metric, value)."""
    return long_form.groupBy("report").pivot("metric", list(metrics)).agg(F.first("value"))
