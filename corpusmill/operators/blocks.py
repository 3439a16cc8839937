"""Best chunks per query out of score blocks, kept while a task reads its partition."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

SCORED = "query_id string, chunk_id string, score double"

#: Score cells (chunks times queries) held at a time.
BLOCK_CELLS = 4_000_000

#: Candidates collected before they are reduced to the best again.
PENDING_ROWS = 500_000


class RunningTopK:
    """The ``limit`` best chunks of each query so far, one limit for all or one for each; equal scores go to the smaller chunk id.

    ``bars`` are scores that so many chunks of a query reach for sure, wherever they are; what is below is left out.
    """

    def __init__(self, query_ids: np.ndarray, limit: int | np.ndarray, bars: np.ndarray | None = None) -> None:
        self.query_ids = query_ids
        self.limits = np.broadcast_to(limit, len(query_ids))
        self.limit = int(self.limits.max(initial=0))
        self.bars = np.full(len(query_ids), -np.inf) if bars is None else bars.copy()
        self.pending: list[pd.DataFrame] = []
        self.pending_rows = 0

    def add(self, scores: np.ndarray, chunk_ids: np.ndarray) -> None:
        """Offer a block of scores, chunks by queries; minus infinity marks pairs that do not count.

        Only pairs that reach the block's and the running k-th best score are kept, ties included.
        """
        keep = min(self.limit, len(scores))
        block_bar = np.partition(scores, len(scores) - keep, axis=0)[len(scores) - keep]
        if keep < self.limit:
            block_bar = np.full_like(block_bar, -np.inf)
        bar = np.maximum(block_bar, self.bars)
        chunk_at, query_at = np.nonzero((scores >= bar) & np.isfinite(scores))
        if len(chunk_at):
            self.pending.append(
                pd.DataFrame({"query": query_at, "chunk_id": chunk_ids[chunk_at], "score": scores[chunk_at, query_at]})
            )
            self.pending_rows += len(chunk_at)
        if self.pending_rows > PENDING_ROWS:
            self._reduce()

    def add_pairs(self, query_at: np.ndarray, chunk_ids: np.ndarray, scores: np.ndarray) -> None:
        """Offer single pairs, at most one of each chunk and query.

        As in ``add``, what reaches neither bar goes at once; a query's ``limit``-th best pair here raises its bar.
        """
        keep = scores >= self.bars[query_at]
        query_at, chunk_ids, scores = query_at[keep], chunk_ids[keep], scores[keep]
        order = np.lexsort((-scores, query_at))
        query_at, chunk_ids, scores = query_at[order], chunk_ids[order], scores[order]
        first = np.nonzero(np.diff(query_at, prepend=-1))[0]
        limit = self.limits[query_at[first]]
        enough = np.append(first[1:], len(query_at)) - first >= limit
        full = query_at[first[enough]]
        self.bars[full] = np.maximum(self.bars[full], scores[first[enough] + limit[enough] - 1])
        keep = scores >= self.bars[query_at]
        if keep.any():
            self.pending.append(pd.DataFrame({"query": query_at[keep], "chunk_id": chunk_ids[keep], "score": scores[keep]}))
            self.pending_rows += int(keep.sum())
        if self.pending_rows > PENDING_ROWS:
            self._reduce()

    def _reduce(self) -> None:
        if not self.pending:
            return
        ordered = pd.concat(self.pending, ignore_index=True).sort_values(
            ["query", "score", "chunk_id"], ascending=[True, False, True]
        )
        best = ordered[ordered.groupby("query", sort=False).cumcount() < self.limits[ordered["query"].to_numpy(dtype=np.int64)]]
        counts = best.groupby("query")["score"].agg(["size", "min"])
        full = counts[counts["size"] == self.limits[counts.index.to_numpy(dtype=np.int64)]]
        at = full.index.to_numpy(dtype=np.int64)
        self.bars[at] = np.maximum(self.bars[at], full["min"].to_numpy())
        self.pending, self.pending_rows = [best], 0

    def result(self) -> pa.RecordBatch:
        self._reduce()
        best = self.pending[0] if self.pending else pd.DataFrame({"query": [], "chunk_id": [], "score": []})
        at = best["query"].to_numpy(dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.query_ids[at].tolist(), pa.string()),
                pa.array(best["chunk_id"].tolist(), pa.string()),
                pa.array(best["score"].tolist(), pa.float64()),
            ],
            ["query_id", "chunk_id", "score"],
        )


def row_blocks(rows: int, queries: int) -> list[slice]:
    """Row ranges whose score block stays within ``BLOCK_CELLS``."""
    size = max(1, BLOCK_CELLS // max(1, queries))
    return [slice(start, min(start + size, rows)) for start in range(0, rows, size)]


def objects(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Column as an array of Python values."""
    values = np.empty(len(column), dtype=object)
    values[:] = column.to_pylist()
    return values


def by_task(tasks: np.ndarray) -> dict[str, np.ndarray]:
    """Row numbers of each task name."""
    codes, names = pd.factorize(tasks)
    return {name: np.nonzero(codes == code)[0] for code, name in enumerate(names)}
