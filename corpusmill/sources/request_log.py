"""The request log: tables of requests and evaluations, and the line-by-line JSON copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.runlog import run_rows_from_log, run_rows_from_tables
from corpusmill.schemas import LOG_RECORD


def append_log(query_logs: DataFrame, evaluations: DataFrame, folder: str) -> None:
    """Append both tables; requests are laid out by day."""
    days = query_logs.withColumn("day", F.to_date("created_at"))
    days.write.mode("append").partitionBy("day").parquet(f"{folder}/query_logs")
    evaluations.write.mode("append").parquet(f"{folder}/evaluations")


def append_log_lines(records: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    records.write.mode("append").json(path)


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with their declared schema."""
    return spark.read.schema(LOG_RECORD).json(path)


def run_rows(spark: SparkSession, tables: str | None = None, lines: str | None = None) -> DataFrame:
    """Run rows from the tables or, when those are not given, from the log lines, labelled with their
    origin. The caller chooses; there is no silent switch."""
    if tables is not None:
        logs = spark.read.parquet(f"{tables}/query_logs")
        scores = spark.read.parquet(f"{tables}/evaluations")
        return run_rows_from_tables(logs, scores).withColumn("data_source", F.lit("tables"))
    if lines is None:
        raise ValueError("give the folder of the tables or the path of the log lines")
    return run_rows_from_log(read_log_lines(spark, lines)).withColumn("data_source", F.lit("log lines"))


def clear_log(spark: SparkSession, tables: str, lines: str | None = None) -> None:
    """Empty both tables, and the log lines when their path is given; schemas stay."""
    for name in ("evaluations", "query_logs"):
        kept = spark.read.parquet(f"{tables}/{name}").limit(0)
        # Dynamic overwrite would leave partitions alone that get no rows.
        kept.drop("day").write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{tables}/{name}")
    if lines is not None:
        read_log_lines(spark, lines).limit(0).write.mode("overwrite").json(lines)
