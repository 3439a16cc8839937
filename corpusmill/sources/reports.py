"""Evaluation reports as JSON files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.metrics import mean_metrics, metric_names
from corpusmill.operators.reports import compare_reports, metric_map
from corpusmill.schemas import REPORT


def report_tables(
    per_sample: DataFrame, config: Mapping[str, str | None], k_values: Sequence[int]
) -> tuple[DataFrame, DataFrame]:
    """Per-sample results and the one-row summary of a report."""
    names = metric_names(k_values)
    kept = [c for c in ("question", "relevant_chunk_ids", "retrieved_ids") if c in per_sample.columns]
    results = per_sample.select(*kept, metric_map(names).alias("metrics"))
    entries = [F.lit(part) for pair in config.items() for part in pair]
    summary = mean_metrics(per_sample, k_values).select(
        metric_map(names).alias("aggregate"),
        "n_samples",
        F.array(*[F.lit(k) for k in k_values]).alias("k_values"),
        F.create_map(*entries).cast("map<string,string>").alias("config"),
    )
    return results, summary


def write_report(results: DataFrame, summary: DataFrame, folder: str, name: str) -> None:
    """Results as JSON lines under ``folder/name/results``, the summary under ``folder/name/summary``."""
    results.write.mode("overwrite").json(f"{folder}/{name}/results")
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}/summary")


def read_reports(spark: SparkSession, pattern: str) -> DataFrame:
    """Report files matching a glob, one row each, with ``file``; written single-document or by
    ``write_report``."""
    found = spark.read.schema(REPORT).option("multiLine", True).json(pattern)
    return found.select("*", F.col("_metadata.file_path").alias("file"))


def compare_report_files(
    spark: SparkSession, pattern: str, experiment_id: str, metrics: Sequence[str]
) -> DataFrame:
    """Comparison of the reports of one experiment; none is an error."""
    compared = compare_reports(read_reports(spark, pattern), experiment_id, metrics)
    if compared.isEmpty():
        raise ValueError(f"no report matching {pattern!r} belongs to experiment {experiment_id!r}")
    return compared
