"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import discard, join_hot, stored

#: Links of one node from which on they are joined where they are read, in tables that have so many links at all.
HOT_LINKS = 100_000


def _with(edges: DataFrame, least: DataFrame, many: bool) -> DataFrame:
    return join_hot(edges, least, "a", HOT_LINKS) if many else edges.join(least, "a")


def _large_star(edges: DataFrame, many: bool) -> DataFrame:
    """Every node's larger neighbours are tied to the smallest node next to it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _with(both.filter("b > a"), least, many).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, many: bool) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them. Edges lead from large to small."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = _with(edges, least, many).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node of ``edges`` (columns a, b of one number type).

    Both steps keep the components and only shorten paths; when a round changes nothing every node hangs on
    its root. Rounds grow with the logarithm of the longest path. Each round is written to the shared scratch
    folder, so a lost executor costs one round at most. Self-links and repeated or empty edges are no problem.
    """
    directed = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    current, seen = stored(directed, "component-edges"), None
    while True:
        mark = current.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        many = mark[0] >= HOT_LINKS
        large = _large_star(current, many)
        before, current = current, stored(_small_star(stored(large, "component-edges") if many else large, many), "component-edges")
        discard(before)
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
