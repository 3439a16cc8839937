"""Review state of evaluation samples."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import strip

UNREVIEWED = "unreviewed"


def review_status(metadata: Column) -> Column:
    """Recorded status, or "unreviewed"."""
    return F.coalesce(F.try_element_at(metadata, F.lit("review_status")), F.lit(UNREVIEWED))


def review_counts(samples: DataFrame) -> DataFrame:
    """(review_status, n), ordered by status."""
    return (
        samples.groupBy(review_status(F.col("metadata")).alias("review_status"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("review_status")
    )


def filter_reviewed(
    samples: DataFrame, keep: Collection[str] | None = None, drop: Collection[str] | None = None
) -> DataFrame:
    """Samples with a status of ``keep`` (None keeps all, empty none), then without those of ``drop``."""
    status = review_status(F.col("metadata"))
    chosen = samples
    if keep is not None:
        chosen = chosen.filter(status.isin(*keep)) if keep else chosen.filter(F.lit(False))
    return chosen.filter(~status.isin(*drop)) if drop else chosen


def _with_entry(metadata: Column, name: str, value: Column, change: Column) -> Column:
    """Map with ``name`` set to ``value``, or removed where that is null, when ``change`` holds."""
    without = F.map_filter(metadata, lambda key, _: key != name)
    added = F.when(value.isNotNull(), F.map_concat(without, F.create_map(F.lit(name), value))).otherwise(without)
    return F.when(F.coalesce(change, F.lit(False)), added).otherwise(metadata)


def apply_edits(samples: DataFrame, edits: DataFrame) -> DataFrame:
    """Samples with edits applied by ``sample_pos``; null fields of an edit change nothing.

    ``edits(sample_pos, status, question, gold_answer, relevant_chunk_ids, reviewer_note,
    clear_note)``. Blank gold answers and notes remove the old value, blank chunk ids are dropped.
    """
    change = edits.select("sample_pos", F.struct(*[c for c in edits.columns if c != "sample_pos"]).alias("_e"))
    joined = samples.join(change, "sample_pos", "left")
    edit = F.col("_e")
    ids = F.filter(F.transform(edit["relevant_chunk_ids"], strip), lambda chunk: chunk != "")
    gold = F.when(edit["gold_answer"].isNotNull(), F.nullif(strip(edit["gold_answer"]), F.lit(""))).otherwise(
        F.col("gold_answer")
    )
    metadata = _with_entry(F.col("metadata"), "review_status", edit["status"], edit["status"].isNotNull())
    clears = F.coalesce(edit["clear_note"], F.lit(False))
    note = F.when(~clears, F.nullif(strip(edit["reviewer_note"]), F.lit("")))
    metadata = _with_entry(metadata, "reviewer_note", note, clears | edit["reviewer_note"].isNotNull())
    return joined.select(
        "sample_pos",
        F.coalesce(strip(edit["question"]), "question").alias("question"),
        F.coalesce(ids, "relevant_chunk_ids").alias("relevant_chunk_ids"),
        gold.alias("gold_answer"),
        metadata.alias("metadata"),
    )


def edits_out_of_range(samples: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits whose position no sample has."""
    return edits.join(samples.select("sample_pos"), "sample_pos", "left_anti")


def list_samples(samples: DataFrame, status: str | None = None, position: int | None = None) -> DataFrame:
    """Samples of one status, or the one at a position."""
    chosen = samples if status is None else samples.filter(review_status(F.col("metadata")) == status)
    return chosen if position is None else chosen.filter(F.col("sample_pos") == position)
