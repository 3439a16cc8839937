"""Plain-text documents from a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_documents(spark: SparkSession, root: str) -> DataFrame:
    """``(source, content)`` of every ``*.txt`` file of a folder, ordered by path."""
    files = spark.read.text(f"{root.rstrip('/')}/*.txt", wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content")).orderBy("source")
