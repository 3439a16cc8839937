"""Top-k per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Decimals kept when scores decide an order. Equal texts then tie exactly, whatever order the
#: partial sums were added in, and the identifier decides.
SCORE_DIGITS = 10

#: Largest result list a request may ask for.
MAX_TOP_K = 20


def top_k(frame: DataFrame, key: str, order: list[Column], limit: int, per_row: str | None = None) -> DataFrame:
    """Rows ranked from 1 within ``key``, at most ``limit`` of them, or the row's own ``per_row`` if less.

    The constant bound lets Spark keep only ``limit`` rows per key and task before the shuffle, so a
    key that owns most rows costs no more than any other.
    """
    ranked = frame.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    kept = ranked.filter(F.col("rank") <= limit)
    return kept.filter(F.col("rank") <= F.col(per_row)) if per_row else kept
