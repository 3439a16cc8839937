"""Words, shared tables and distributed running sums used by several operators of this subpackage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.session import discard, fits_broadcast, ship_package, small_batches, stored

__all__ = ["WORD", "discard", "fits_broadcast", "fresh", "hash_sample", "join_hot", "read", "running_sums", "ship_package", "small_batches", "stored", "word_array"]

#: Characters that separate words; everything else belongs to one.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(frame: DataFrame, name: str) -> str:
    """The name, with marks added until no column of the frame has it."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_sample(frame: DataFrame, by: Sequence[str], rows: int, limit: int) -> DataFrame:
    """At most ``limit`` rows of a frame of ``rows`` rows, those with the smallest hash of the columns ``by``.

    A bound on the hash leaves little more than ``limit`` rows before any task sends rows to the driver, so what is sent does not
    grow with the number of tasks. Rows equal in ``by`` stay in any order.
    """
    place = F.xxhash64(*[F.col(f"`{column}`") for column in by])
    part = min(1.0, (1.2 * limit + 100) / max(rows, 1))
    bound = int(-(2**63) + part * (2**64 - 1)) if part < 1 else 2**63 - 1
    return frame.filter(place <= F.lit(bound).cast("long")).orderBy(place, *[F.col(f"`{column}`") for column in by]).limit(limit)


def join_hot(many: DataFrame, one: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """Inner join with a side that has each key once. Keys with ``hot_rows`` rows or more are few; theirs are joined where they are read."""
    hot = stored(many.groupBy(key).agg(F.count("*").alias("_rows")).filter(F.col("_rows") >= hot_rows).select(key), "hot-keys")
    if hot.isEmpty() or not fits_broadcast(hot, 100_000):
        return many.join(one, key)
    few = F.broadcast(hot)
    return many.join(F.broadcast(one.join(few, key, "left_semi")), key).unionByName(many.join(few, key, "left_anti").join(one, key))


def word_array(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def running_sums(
    frame: DataFrame, groups: Sequence[str], bucket: str, order: Sequence[Column], measures: Mapping[str, Column],
    per_group: DataFrame | None = None,
) -> DataFrame:
    """Adds, per measure, its sum over all earlier rows of the row's group.

    A group is cut into ``bucket`` values that follow its order. Sums run inside each bucket, bucket totals
    (one row each) run inside the group, and a join on group and bucket adds the two. A group of any size is
    thereby spread over as many tasks as it has buckets. Groups and buckets must not be null, measures neither.
    ``frame`` is read twice, so it should be cheap to read. Columns of ``per_group`` (groups and more) are added
    by way of the bucket totals, so that a hot group's rows are never brought together for it.
    """
    keys = [*groups, bucket]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = frame.groupBy(*keys).agg(*[F.sum(value).alias(f"_total_{name}") for name, value in measures.items()])
    before = totals.select(
        *keys, *[F.coalesce(F.sum(f"_total_{name}").over(over), F.lit(0)).alias(f"_before_{name}") for name in measures]
    )
    if per_group is not None:
        before = before.join(per_group, list(groups))
    local = frame.select(
        "*", *[F.coalesce(F.sum(value).over(inside), F.lit(0)).alias(f"_inside_{name}") for name, value in measures.items()]
    )
    joined = local.join(before, keys)
    return joined.select(
        *[F.col(f"`{column}`") for column in frame.columns],
        *[(F.col(f"_before_{name}") + F.col(f"_inside_{name}")).alias(name) for name in measures],
        *[column for column in (per_group.columns if per_group is not None else []) if column not in groups],
    )
