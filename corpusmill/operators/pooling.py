"""More relevance labels from pooled retrieval results and verdicts on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.benchmark_text import is_yes
from corpusmill.functions.text import strip


def lexical_backends(choice: str) -> list[str]:
    """Backends meant by bm25, fts or mixed."""
    backends = {"mixed": ["fts", "bm25"], "fts": ["fts"], "bm25": ["bm25"]}
    try:
        return backends[choice.strip().lower()]
    except KeyError:
        raise ValueError("pool lexical backend must be one of: bm25, fts, mixed") from None


def pool_sources(modes: Sequence[str], backends: Sequence[str]) -> list[tuple[str, str | None]]:
    """Searches of a pool in order: a lexical mode once per backend."""
    return [
        (mode, backend)
        for mode in modes
        for backend in (backends if mode == "lexical" else [None])
    ]


def pool_candidates(lists: Sequence[DataFrame]) -> DataFrame:
    """Union of result lists in which each chunk keeps its first place.

    Every list has (query_id, chunk_id, rank); gives (query_id, chunk_id, source_order, rank,
    pool_pos), where ``pool_pos`` orders the pool.
    """
    stacked = None
    for order, found in enumerate(lists):
        labelled = found.select("query_id", "chunk_id", F.lit(order).alias("source_order"), "rank")
        stacked = labelled if stacked is None else stacked.unionByName(labelled)
    first = stacked.groupBy("query_id", "chunk_id").agg(
        F.min(F.struct("source_order", "rank")).alias("place")
    )
    return first.select(
        "query_id", "chunk_id", "place.source_order", "place.rank", F.col("place").alias("pool_pos")
    )


def to_judge(samples: DataFrame, pool: DataFrame) -> DataFrame:
    """Pool members of each sample that are not labelled relevant yet."""
    labels = samples.select("query_id", F.explode("relevant_chunk_ids").alias("chunk_id"))
    return pool.join(samples.select("query_id"), "query_id").join(labels, ["query_id", "chunk_id"], "left_anti")


def expand_labels(samples: DataFrame, pool: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Samples with the chunks judged relevant appended, and what was judged.

    ``verdicts(query_id, chunk_id, content, raw)`` hold the judge's words; a blank passage is never
    relevant. A pool has at most a few lists of top-k entries, so the lists gathered per sample stay
    short.
    """
    judged = to_judge(samples, pool).join(
        verdicts.select(
            "query_id", "chunk_id",
            F.coalesce(is_yes(F.col("raw")) & (strip(F.col("content")) != ""), F.lit(False)).alias("yes"),
        ),
        ["query_id", "chunk_id"],
        "left",
    )
    ordered = F.array_sort(F.collect_list(F.struct("pool_pos", "chunk_id", F.coalesce("yes", F.lit(False)).alias("yes"))))
    gathered = judged.groupBy("query_id").agg(ordered.alias("_judged"))
    none = F.array().cast("array<string>")
    judged_ids = F.coalesce(F.transform("_judged", lambda j: j["chunk_id"]), none)
    positive = F.coalesce(
        F.transform(F.filter("_judged", lambda j: j["yes"]), lambda j: j["chunk_id"]), none
    )
    return (
        samples.join(gathered, "query_id", "left")
        .withColumn("candidates_judged", judged_ids)
        .withColumn("judged_relevant", positive)
        .withColumn("relevant_chunk_ids", F.concat("relevant_chunk_ids", "judged_relevant"))
        .drop("_judged")
    )


def pooling_record(
    samples: DataFrame, provider: str, model: str, top_k: int, modes: Sequence[str], backends: Sequence[str]
) -> DataFrame:
    """Samples whose metadata say how their labels were pooled."""
    record = F.to_json(
        F.struct(
            F.lit(provider).alias("judge_provider"),
            F.lit(model).alias("judge_model"),
            F.lit(top_k).alias("pool_top_k"),
            F.array(*[F.lit(m) for m in modes]).alias("pool_retrieval_modes"),
            F.array(*[F.lit(b) for b in backends]).alias("pool_lexical_backends"),
            "candidates_judged",
            "judged_relevant",
        )
    )
    without = F.map_filter("metadata", lambda key, _: key != "relevance_pooling")
    return samples.withColumn(
        "metadata", F.map_concat(without, F.create_map(F.lit("relevance_pooling"), record))
    )
