"""Evaluation datasets and question lists as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import strip
from corpusmill.schemas import DATASET, QUESTION_LIST


def write_dataset(samples: DataFrame, path: str) -> None:
    """One JSON object per line, null answers written as null, in order of ``sample_pos`` if there is one."""
    chosen = samples.select("question", "relevant_chunk_ids", "gold_answer", "metadata", *(
        ["sample_pos"] if "sample_pos" in samples.columns else []
    ))
    if "sample_pos" in samples.columns:
        chosen = chosen.orderBy("sample_pos").drop("sample_pos")
    chosen.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Samples in file order with ``sample_pos`` from 0; blank lines are skipped, missing metadata is empty.

    The number of a line is the number of lines in the file parts before its own plus its place there.
    """
    lines = (
        spark.read.text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        )
        .filter(strip(F.col("value")) != "")
    )
    order = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    parts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select("file", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("line")) - 1
    parsed = F.from_json("value", DATASET)
    return (
        lines.join(before, ["file", "block"])
        .select((F.col("before") + inside).alias("sample_pos"), parsed.alias("s"))
        .select("sample_pos", "s.*")
        .withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    )


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON array of objects, trimmed; entries without a question are skipped."""
    listed = spark.read.schema(QUESTION_LIST).option("multiLine", True).json(path)
    kept = listed.filter(F.coalesce("question", F.lit("")) != "").withColumn("question", strip(F.col("question")))
    if kept.isEmpty():
        raise ValueError("the question file holds no usable question")
    return kept
