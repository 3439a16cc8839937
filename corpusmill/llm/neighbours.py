"""Approximate nearest neighbours by inner product: a forest of random-projection trees, one priority queue, exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import hash_sample, join_hot, read, ship_package, stored

NEIGHBOURS = 20
QUERY_STEP = 20

#: Distinct vectors the forest is fitted on and its reach is set with; all others are only put in.
SAMPLE_ROWS = 20_000
#: Queries out of the sample whose neighbours in it set the reach, and the part of these to be reached.
REACH_QUERIES = 300
REACH_PART = 0.97
TREES = 4
#: Rows a leaf should get, and sample rows it needs at least.
LEAF_ROWS = 512
LEAF_SAMPLE = 16
#: Rows of a leaf that one task compares with the leaf's queries at once.
CHUNK_ROWS = 20_000
#: Query vectors that one task compares with a chunk: a leaf asked by more is compared in several tasks.
QUERY_BLOCK = 50_000
#: Rows down to which a chunk is cut inside its task; parts beyond a query's reach are not compared with it.
PART_ROWS = 1024
#: Queries with one vector from which on they are joined where they are read.
HOT_QUERIES = 100_000
#: Cells (rows times queries) of a score block.
BLOCK_CELLS = 2_000_000


@dataclass
class Tree:
    """Inner nodes as planes; children are node numbers, or leaves as -1 - leaf."""

    planes: list[np.ndarray] = field(default_factory=list)
    cuts: list[float] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0


@dataclass
class Forest:
    """Trees over vectors scaled by the largest norm and lifted by one coordinate, so that all have norm 1.

    Inner products with a query then order like distances to it. ``sample`` has the unlifted sample vectors.
    """

    scale: float
    trees: list[Tree]
    sample: np.ndarray
    reach: float
    chunks: int

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / self.scale
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", scaled, scaled)))
        return np.column_stack([scaled, rest])

    def leaves(self, lifted: np.ndarray, tree: Tree) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(lifted), np.int64)
        waiting = [(0, np.arange(len(lifted)))] if tree.planes else []
        while waiting:
            node, rows = waiting.pop()
            right = lifted[rows] @ tree.planes[node] > tree.cuts[node]
            for child, some in zip(tree.children[node], (rows[~right], rows[right])):
                if child < 0:
                    out[some] = -1 - child
                elif len(some):
                    waiting.append((child, some))
        return out

    def search(self, query: np.ndarray) -> list[tuple[int, int, float]]:
        """Trees and leaves to look in, and how far beyond a plane each lies. One queue over all trees holds nodes by how far beyond a plane of their
        path the query lies; the nearest node is opened first, until all that is left lies beyond the reach."""
        unit = np.append(query, 0.0) / np.linalg.norm(query)
        margins = [np.array(tree.planes) @ unit - np.array(tree.cuts) if tree.planes else None for tree in self.trees]
        queue = [(0.0, at, 0 if tree.planes else -1) for at, tree in enumerate(self.trees)]
        found = []
        while queue:
            far, at, node = heapq.heappop(queue)
            if far > self.reach:
                break
            if node < 0:
                found.append((at, -1 - node, far))
                continue
            left, right = self.trees[at].children[node]
            margin = float(margins[at][node])
            heapq.heappush(queue, (max(far, margin), at, left))
            heapq.heappush(queue, (max(far, -margin), at, right))
        return found


def _grow(vectors: np.ndarray, leaf: int, chance: np.random.Generator) -> Tree:
    """A tree of median cuts along random directions; a node that no direction cuts becomes a leaf."""
    tree = Tree()

    def node(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            plane = chance.normal(size=vectors.shape[1])
            plane /= np.linalg.norm(plane)
            along = vectors[rows] @ plane
            cut = float(np.median(along))
            right = along > cut
            if right.any() and not right.all():
                here = len(tree.planes)
                tree.planes.append(plane)
                tree.cuts.append(cut)
                tree.children.append([0, 0])
                tree.children[here] = [node(rows[~right]), node(rows[right])]
                return here
        tree.leaves += 1
        return -tree.leaves

    node(np.arange(len(vectors)))
    return tree


def fit(sample: np.ndarray, scale: float, rows: int, neighbours: int = NEIGHBOURS, seed: int = 1) -> Forest:
    """Forest from sample vectors for a table of ``rows`` vectors.

    The reach is the margin within which REACH_PART of the sample queries' true neighbours in the sample lie. In the whole table
    neighbours are at least as near, so their part is not smaller. Leaves become smaller with more rows until the sample is used up.
    """
    chance = np.random.default_rng(seed)
    leaf = max(LEAF_SAMPLE, -(-LEAF_ROWS * len(sample) // max(rows, 1)))
    forest = Forest(scale, [], sample, 0.0, 1)
    lifted = forest.lift(sample)
    forest.trees = [_grow(lifted, leaf, chance) for _ in range(TREES)]
    forest.chunks = max(1, round(rows * leaf / max(len(sample), 1) / CHUNK_ROWS))
    asked = chance.permutation(len(sample))[:REACH_QUERIES]
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    count = min(neighbours, len(sample) - 1)
    if count > 0:
        near = np.argpartition(-scores, count - 1, axis=1)[:, :count]
        needed = np.full(near.shape, np.inf)
        units = np.column_stack([sample[asked], np.zeros(len(asked))])
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        for tree in forest.trees:
            far = np.zeros(near.shape)
            waiting = [(0, np.ones(near.shape, bool))] if tree.planes else []
            while waiting:
                node, inside = waiting.pop()
                margin = (units @ tree.planes[node] - tree.cuts[node])[:, None]
                right = (lifted[near.ravel()] @ tree.planes[node] > tree.cuts[node]).reshape(near.shape)
                for child, some, beyond in zip(tree.children[node], (inside & ~right, inside & right), (margin, -margin)):
                    far = np.where(some, np.maximum(far, beyond), far)
                    if child >= 0 and some.any():
                        waiting.append((child, some))
            needed = np.minimum(needed, far)
        forest.reach = float(np.quantile(needed, REACH_PART))
    return forest


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _parts(lifted: np.ndarray, units: np.ndarray, reach: float, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of a chunk's rows, each with the queries that reach it: the tree goes on inside the chunk, so leaves stay small in any table."""
    chance = np.random.default_rng(seed)
    waiting = [(np.arange(len(lifted)), np.arange(len(units)))]
    while waiting:
        rows, asked = waiting.pop()
        if not len(asked):
            continue
        if len(rows) <= PART_ROWS:
            yield rows, asked
            continue
        plane = chance.normal(size=lifted.shape[1])
        plane /= np.linalg.norm(plane)
        along = lifted[rows] @ plane
        cut = float(np.median(along))
        right = along > cut
        if not right.any() or right.all():
            yield rows, asked
            continue
        margin = units[asked] @ plane - cut
        waiting += [(rows[~right], asked[margin <= reach]), (rows[right], asked[-margin <= reach])]


def _scan(rows: pa.Table, queries: pa.Table, limit: int, forest: Forest) -> pa.Table:
    """A chunk's best rows for each of its queries: of each part that a query reaches at most ``limit``, none below the query's bar.

    A query with an open bar belongs to the leaf and is compared with all of the chunk, so that it is never short of rows.
    """
    schema = pa.schema([("query_class", pa.int64()), ("class_id", pa.int64()), ("score", pa.float64())])
    if not rows.num_rows or not queries.num_rows:
        return schema.empty_table()
    ids = rows.column("class_id").to_numpy()
    order = np.argsort(ids)
    ids, vectors = ids[order], _matrix(rows.column("embedding").combine_chunks())[order]
    asked, bars = queries.column("query_class").to_numpy(), queries.column("bar").to_numpy()
    wanted = _matrix(queries.column("embedding").combine_chunks())
    own = np.isneginf(bars)
    work = [(np.arange(len(ids)), np.flatnonzero(own))]
    if not own.all():
        units = np.column_stack([wanted / np.linalg.norm(wanted, axis=1, keepdims=True), np.zeros(len(wanted))])
        others = np.flatnonzero(~own)
        seed = int(rows.column("leaf")[0].as_py()) + 1
        work += [(part, others[asking]) for part, asking in _parts(forest.lift(vectors), units[others], forest.reach, seed)]
    out = [schema.empty_table()]
    for part, asking in work:
        step = max(1, BLOCK_CELLS // len(part))
        for at in range(0, len(asking), step):
            some = asking[at : at + step]
            scores = wanted[some] @ vectors[part].T
            bar = bars[some]
            if len(part) > limit:
                bar = np.maximum(bar, np.partition(scores, len(part) - limit, axis=1)[:, len(part) - limit])
            query, row = np.nonzero(scores >= bar[:, None])
            out.append(pa.Table.from_arrays([pa.array(asked[some[query]]), pa.array(ids[part[row]]), pa.array(scores[query, row])], schema=schema))
    return pa.concat_tables(out)


def usable(vectors: DataFrame, identity: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and embedding of the rows that take part.

    Not: null ids, null, empty or zero vectors, vectors with null or non-finite components, and vectors of another length than
    most have (of two such lengths the smaller counts).
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.select(F.col(f"`{identity}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0)
    )
    sizes = good.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    return good.filter(F.size("embedding") == (sizes[0]["width"] if sizes else 0))


def nearest(vectors: DataFrame, is_query, neighbours: int = NEIGHBOURS, identity: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the rows found nearest to each query row, not counting the query itself.

    Equal vectors are one class with its ``neighbours`` + 1 smallest ids: no result needs more of them, so a vector that a third of the rows
    share costs one comparison. All classes are put into the leaves of all trees; each class that holds a query is sent to the
    leaves its search names; a leaf's rows and queries meet in one task, those of a large leaf, in chunks and blocks, in several. A query's bar, its
    ``neighbours`` + 1st best score in the sample, keeps rows that cannot count from being sent on. Repeated ids with equal vectors count
    once. Ties go to the smaller vec_id.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    good = usable(vectors, identity, vector).distinct()
    limit = neighbours + 1
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    least = good.withColumn("_nth", F.row_number().over(by_vector)).filter(F.col("_nth") <= limit)
    classes = stored(
        least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("class_id", F.get("ids", F.lit(0))),
        "vector-classes",
    )
    asking = stored(
        join_hot(good.filter(is_query(F.col("vec_id"))), classes.select("embedding", "class_id"), "embedding", HOT_QUERIES).select(
            F.col("vec_id").alias("query_id"), F.col("class_id").alias("query_class")
        ), "vector-queries",
    )
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    rows, scale = classes.agg(F.count("*"), F.max(norm)).first()
    if not rows:
        return spark.createDataFrame([], schema)
    sampled = hash_sample(classes.select("class_id", "embedding"), ["class_id"], rows, SAMPLE_ROWS).toArrow()
    shared = spark.sparkContext.broadcast(fit(_matrix(sampled.column("embedding").combine_chunks()), float(scale), rows, neighbours))

    blocks = max(1, -(-asking.select("query_class").distinct().count() // QUERY_BLOCK))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            lifted = forest.lift(_matrix(batch.column("embedding")))
            ids = batch.column("class_id").to_numpy()
            chunk = np.repeat((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % forest.chunks, blocks)
            block, copied = np.tile(np.arange(blocks), len(ids)), pa.array(np.repeat(np.arange(len(ids)), blocks))
            for at, tree in enumerate(forest.trees):
                leaf = np.repeat(forest.leaves(lifted, tree), blocks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(leaf), at)), pa.array(leaf), pa.array(chunk), pa.array(block), batch.column("class_id").take(copied), batch.column("embedding").take(copied)],
                    ["tree", "leaf", "chunk", "block", "class_id", "embedding"],
                )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            wanted = _matrix(batch.column("embedding"))
            for first in range(0, len(wanted), 256):
                block = wanted[first : first + 256]
                scores = block @ forest.sample.T
                # A little below, as sums of products depend on how many are taken at once.
                bars = (
                    np.partition(scores, -limit, axis=1)[:, -limit] - 1e-9 * forest.scale * np.linalg.norm(block, axis=1)
                    if scores.shape[1] >= limit else np.full(len(block), -np.inf)
                )
                # The leaves that the query itself belongs to give their best rows in any case, so no query stays short of rows.
                places = [
                    (row, at, leaf, chunk, -np.inf if far <= 0 else bars[row]) for row, query in enumerate(block)
                    for at, leaf, far in forest.search(query) for chunk in range(forest.chunks)
                ]
                row, at, leaf, chunk = np.array([place[:4] for place in places], np.int64).reshape(-1, 4).T
                bar, chosen = np.array([place[4] for place in places], np.float64), pa.array(first + row)
                asked = batch.column("query_class").take(chosen)
                spread = (asked.to_numpy().astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)).astype(np.int64) % blocks
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array(leaf), pa.array(chunk), pa.array(spread), asked, pa.array(bar), batch.column("embedding").take(chosen)],
                    ["tree", "leaf", "chunk", "block", "query_class", "bar", "embedding"],
                )

    kind = classes.schema["embedding"].dataType.simpleString()
    where = ["tree", "leaf", "chunk", "block"]
    index = classes.select("class_id", "embedding").mapInArrow(place, f"tree long, leaf long, chunk long, block long, class_id long, embedding {kind}")
    query_classes = classes.join(asking.select(F.col("query_class").alias("class_id")).distinct(), "class_id", "left_semi").select(
        F.col("class_id").alias("query_class"), "embedding"
    )
    asked = query_classes.mapInArrow(ask, f"tree long, leaf long, chunk long, block long, query_class long, bar double, embedding {kind}")
    met = index.groupBy(*where).cogroup(asked.groupBy(*where)).applyInArrow(
        lambda left, right: _scan(left, right, limit, shared.value), "query_class long, class_id long, score double"
    )
    # A row met in several trees counts once.
    once = met.groupBy("query_class", "class_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_class").orderBy(F.desc("score"), "class_id")
    top = once.withColumn("_nth", F.row_number().over(best)).filter(F.col("_nth") <= limit)
    members = top.join(classes.select("class_id", "ids"), "class_id")
    lists = members.groupBy("query_class").agg(F.flatten(F.collect_list(
        F.transform("ids", lambda vec_id: F.struct((-F.col("score")).alias("worse"), vec_id.alias("vec_id")))
    )).alias("found"))
    others = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    return join_hot(asking, lists, "query_class", HOT_QUERIES).select(
        "query_id", F.posexplode(F.slice(F.sort_array(others), 1, neighbours))
    ).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.worse")).alias("score"))


def op1_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest rows found for every vec_id divisible by 20."""
    return nearest(read(spark, folder, "embeddings"), lambda vec_id: vec_id % QUERY_STEP == 0)
