"""The request log as a stream."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators.runlog import run_rows_from_log
from corpusmill.operators.summaries import MEANS, RATES
from corpusmill.schemas import LOG_RECORD
from corpusmill.sources.versions import delete, numbered, read_small, write_once


def stream_log_lines(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """New log files of a folder as they appear."""
    reader = spark.readStream.schema(LOG_RECORD)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def append_run_rows(records: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Run rows appended to Parquet files for all log files present; each record is written once."""
    rows = run_rows_from_log(records)
    return (
        rows.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_sums(rows: DataFrame, dimension: str) -> DataFrame:
    """Sums and counts per value of a dimension, kept up to date; the state is one row per value."""
    totals = [F.count("question").alias("requests")]
    for _, column, _ in (*MEANS, *RATES):
        value = F.col(column).cast("double")
        totals += [F.sum(value).alias(f"sum_{column}"), F.count(value).alias(f"n_{column}")]
    return rows.groupBy(dimension).agg(*totals)


def means_of_sums(sums: DataFrame, dimension: str) -> DataFrame:
    """The grouped summary from running sums."""
    def mean(column: str, digits: int, factor: int = 1):
        scale = 10.0**digits
        value = F.col(f"sum_{column}") / F.nullif(F.col(f"n_{column}"), F.lit(0)) * factor
        return F.rint(value * scale) / scale

    return sums.select(
        dimension, "requests",
        *[mean(column, digits).alias(name) for name, column, digits in MEANS],
        *[F.coalesce(mean(column, digits, 100), F.lit(0.0)).alias(name) for name, column, digits in RATES],
    )


#: Folders of changed groups after which they are brought together in one.
MOST_CHANGES = 8


def publish_summary(records: DataFrame, dimension: str, target: str, checkpoint: str) -> StreamingQuery:
    """The grouped summary of everything read so far, kept up to date by what each batch of files changes.

    A batch writes its changed groups to a folder of its own, and a small file that names all folders of the summary makes them
    readable in one step: readers see a whole summary at any time, also while a batch is written or after one has failed. Many folders are
    brought together into one; those that only older summaries name are deleted one batch later. A batch that is run again after
    it was committed changes nothing.
    """
    sums = running_sums(run_rows_from_log(records), dimension)

    def publish(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = numbered(spark, target, "summary")
        if done and done[-1] >= number:
            return
        folders = _folders(spark, target, done[-1]) if done else []
        path = f"changes-{number}"
        means_of_sums(batch, dimension).withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/{path}")
        named = [*folders, path]
        if len(named) > MOST_CHANGES:
            named = [f"whole-{number}"]
            _newest(spark, target, [*folders, path], dimension).write.mode("overwrite").parquet(f"{target}/{named[0]}")
        write_once(spark, target, f"summary-{number}.json", json.dumps({"folders": named, "dimension": dimension}))
        before = _folders(spark, target, done[-2]) if len(done) > 1 else []
        for old in set(before) - set(folders) - set(named):
            delete(spark, f"{target}/{old}")
        for old in done[:-1]:
            delete(spark, f"{target}/summary-{old}.json")

    return (
        sums.writeStream.outputMode("update")
        .foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _folders(spark: SparkSession, target: str, number: int) -> list[str]:
    return json.loads(read_small(spark, f"{target}/summary-{number}.json"))["folders"]


def _newest(spark: SparkSession, target: str, folders: list[str], dimension: str) -> DataFrame:
    """The last row of each group."""
    rows = spark.read.parquet(*[f"{target}/{folder}" for folder in folders])
    newest = rows.groupBy(dimension).agg(F.max_by(F.struct(*rows.columns), "_batch").alias("row"))
    return newest.select("row.*")


def read_summary(spark: SparkSession, target: str) -> DataFrame:
    """The summary of the last batch that was committed."""
    newest = numbered(spark, target, "summary")[-1]
    named = json.loads(read_small(spark, f"{target}/summary-{newest}.json"))
    return _newest(spark, target, named["folders"], named["dimension"]).drop("_batch")
