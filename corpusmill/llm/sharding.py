"""Contiguous shards of nearly equal byte size, cut from global prefix sums. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import read, running_sums, stored

SHARDS = 40
OVERHEAD_BYTES = 16


def balanced_shards(frame: DataFrame, size: str, order: Sequence[str], shards: int) -> DataFrame:
    """Adds shard (0 to ``shards`` - 1) and slot (0, 1, ... in each shard).

    Rows are range-partitioned by ``order`` and written with the number of their range. Sizes and row counts
    of the ranges are added up over the ranges (one row per range) and over the rows of each range; a row goes
    to the shard in whose equal part of all bytes its middle byte lies. A shard's size is therefore within one
    row of the mean. Shards follow the order, so any shard is one contiguous run of it.

    ``size`` must be positive and not null. Ties in ``order`` are cut anywhere; rows equal in every column are
    interchangeable. Null order values come first. An empty frame gives no rows. Columns the frame has are
    kept; ``shard`` and ``slot`` replace columns of these names.
    """
    kept = [column for column in frame.columns if column.lower() not in ("shard", "slot")]
    ranges = frame.select(*[F.col(f"`{column}`") for column in kept]).repartitionByRange(*[F.col(f"`{c}`") for c in order])
    parts = stored(ranges.withColumn("_range", F.spark_partition_id()), "shard-ranges")
    summed = running_sums(
        parts, [], "_range", [F.col(f"`{column}`") for column in [*order, size]],
        {"_bytes": F.col(f"`{size}`"), "_row": F.lit(1).cast("long")},
    )
    total = parts.agg(F.sum(f"`{size}`")).first()[0] or 1
    # Twice the middle byte times the shard count, in whole numbers: no rounding at the cuts.
    cut = F.expr(f"least(int((2 * _bytes + `{size}`) * {shards} div {2 * total}L), {shards - 1})")
    placed = summed.withColumn("shard", cut)
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        *[F.col(f"`{column}`") for column in kept], "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )


def op4_balanced_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard by bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has 16 bytes and the checksum of no bytes, 0. A null doc_id comes first.
    """
    slim = read(spark, folder, "documents").select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + OVERHEAD_BYTES).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    return balanced_shards(slim, "size", ["doc_id", "text_crc32"], SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP4_SQL = """
WITH RECURSIVE byte(n, c, round) AS (
  SELECT n, n, 0 FROM range(256) AS t(n)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, round + 1 FROM byte WHERE round < 8
),
crc_table AS (SELECT list(c ORDER BY n) AS crc FROM byte WHERE round = 8),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
        lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM documents, crc_table
),
summed AS (
  SELECT *, coalesce(sum(size) OVER earlier, 0)::HUGEINT AS before, sum(size) OVER ()::HUGEINT AS total,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS nth
  FROM sized
  WINDOW earlier AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
placed AS (SELECT *, least((2 * before + size) * 40 // (2 * total), 39)::INTEGER AS shard FROM summed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
  (nth - min(nth) OVER (PARTITION BY shard))::BIGINT AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed"""
