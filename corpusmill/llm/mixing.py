"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets, repeated epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import BLANKS, read, running_sums, stored, word_array

MAX_EPOCHS = 3
SEED = 8


def source_targets(sizes: DataFrame, weight: Column, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds target: every source's share of all sizes by weight, at most ``max_epochs`` times its own size.

    What a limit cuts off is shared again by weight among the others until none is above; the end of that is
    a level, the same for all sources below their limit, times the weight. ``sizes`` has one row per source
    (source_key, source_size), sorted and summed in one task like any list of sources.
    """
    everything = Window.partitionBy()
    by_limit = Window.orderBy("_limit_level", "source_key")
    earlier = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    weighed = sizes.withColumn("weight", weight).withColumn("_limit", F.col("source_size") * max_epochs)
    levels = (
        weighed.withColumn("_limit_level", F.col("_limit").cast("double") / F.col("weight"))
        .withColumn("_spent", F.coalesce(F.sum("_limit").over(earlier), F.lit(0)))
        .withColumn("_open", F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_level", (F.col("_all") - F.col("_spent")).cast("double") / F.col("_open"))
        .withColumn("_nth", F.row_number().over(by_limit))
    )
    # The first source whose limit is not below the level sets the level of all that follow.
    fits = F.when(F.col("_limit_level") >= F.col("_level"), F.col("_nth"))
    level = F.min_by(F.col("_level"), fits).over(everything)
    return levels.withColumn(
        "target", F.least(F.col("_limit").cast("double"), F.col("weight") * level)
    ).select("source_key", "source_size", "weight", "target")


def mix_sources(
    frame: DataFrame, identity: str, source: str, size: str, carried: str | None = None,
    max_epochs: int = MAX_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """identity, source, size, source_size, target and taken of every row, and the column ``carried``.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. Rows get hash-random keys and are cut by
    key ranges inside their source; prefix sums over ranges and rows give each row its place. A source's
    budget is its target rounded to whole words: it takes all its rows as often as the budget allows, then
    rows in key order up to exactly the budget, so that at most one row per source is taken in part.

    Null sizes count 0; a null identity has the key of the empty string. Rows equal in all three columns
    follow each other. Sources without words take nothing. An empty frame gives no rows. Rerunning gives the
    same rows.
    """
    keyed = frame.select(
        F.col(f"`{identity}`").alias("_identity"), F.col(f"`{source}`").alias("_source"),
        F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)).alias("_size"),
        *[F.col(f"`{column}`").alias("_carried") for column in [carried] if column],
    ).withColumn("_key", F.md5(F.concat(F.coalesce(F.col("_identity").cast("string"), F.lit("")), F.lit(f":{seed}"))))
    # A null source and an empty name stay apart through the mark before it.
    marked = F.when(F.col("_source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("_source")))
    rows = stored(
        keyed.withColumn("source_key", marked).withColumn("_range", F.substring("_key", 1, 3)), "mix-rows"
    )
    sizes = rows.groupBy("source_key").agg(F.sum("_size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy("source_key"))
    targets = source_targets(sizes, (nth - 1) % 3 + 1, max_epochs)
    placed = running_sums(rows, ["source_key"], "_range", [F.col("_key"), F.col("_identity"), F.col("_size")], {"_before": F.col("_size")}, targets)
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("_before"), F.lit(0)), F.col("_size"))
    return placed.select(
        F.col("_identity").alias(identity), F.col("_source").alias(source), F.col("_size").alias(size), "source_size", "target",
        (epochs * F.col("_size") + part).cast("long").alias("taken"),
        *[F.col("_carried").alias(column) for column in [carried] if column],
    )


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The mix itself, with the columns of documents: each document as often as it is taken.

    Its last copy ends after the words that its source's budget still has, at most one document per source being cut; a cut text
    keeps its lines and blanks up to the last word taken, and n_chars, if there is such a column, is that text's. Documents without words go.
    """
    rows = documents.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("of"),
        F.size(word_array(F.col("text"))).cast("long").alias("words"),
    )
    mixed = mix_sources(rows, "id", "of", "words", "row").filter("taken > 0")
    copies = mixed.select("row", "words", "taken", F.explode(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("words")))).alias("nth"))
    left = F.col("taken") - F.col("nth") * F.col("words")
    text = F.col("row.text")
    spaced = F.split(F.ltrim(text, F.lit(BLANKS)), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")  # each word with the blanks behind it
    before = F.left(text, F.char_length(text) - F.char_length(F.ltrim(text, F.lit(BLANKS))))
    cut = F.concat(before, F.rtrim(F.array_join(F.slice(spaced, 1, left.cast("int")), ""), F.lit(BLANKS)))
    whole = copies.select("row", F.when(left < F.col("words"), cut).alias("cut"))
    changed = {"text": F.coalesce("cut", "row.text"), "n_chars": F.when(F.col("cut").isNotNull(), F.char_length("cut").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in documents.columns else None}
    return whole.select(*[
        changed[column].alias(column) if column in changed else F.col("row").getField(column).alias(column) for column in documents.columns
    ])


def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """What a mix of all documents takes: doc_id, size, source_size, target, taken, source."""
    slim = read(spark, folder, "documents").select("doc_id", "source", F.size(word_array(F.col("text"))).cast("long").alias("size"))
    return mix_sources(slim, "doc_id", "source", "size").select("doc_id", "size", "source_size", "target", "taken", "source")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':8') AS key
  FROM documents
),
weighed AS (
  SELECT source, source_size, 3 * source_size AS limit_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)
),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(limit_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    limit_size::DOUBLE / weight AS limit_level, row_number() OVER o AS nth
  FROM weighed WINDOW o AS (ORDER BY limit_size::DOUBLE / weight, source NULLS LAST)
),
targets AS (
  SELECT source, source_size, least(limit_size::DOUBLE, weight
    * (SELECT level FROM levels WHERE limit_level >= level ORDER BY nth LIMIT 1)) AS target
  FROM levels
),
placed AS (
  SELECT s.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, source,
  (CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
    + least(greatest(budget % source_size - before, 0), size) END)::BIGINT AS taken
FROM placed"""
