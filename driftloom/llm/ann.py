"""Approximate nearest neighbours: forests of random-projection trees, searched best-first, then reranked exactly.

The index holds every row.  Rows are dealt into shards of bounded size; a shard's forest splits its rows at the median
of a random projection, level by level (the nodes of a level share a direction).  A query walks all trees of a shard
through one priority queue ordered by the distance to the split it would have to cross, until it has gathered a set
share of the shard's rows; those get their exact distances.  The best of all shards are merged.  Recall does not
depend on the number of shards, because the share holds in each.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.common import vectors
from driftloom.llm.topk import matrix, meet
from driftloom.sources.stage import stage

#: Rows of a shard and of a query block at most, on average.
SHARD_ROWS, QUERY_ROWS = 32_768, 8_192
#: Trees of a shard, rows of a leaf, and the share of a shard's rows that a query gathers (at least LEAST rows).
#: Vectors without any cluster structure in 64 dimensions need this share for a recall of 0.9.
TREES, LEAF_ROWS, SHARE, LEAST = 24, 24, 0.55, 400


class Forest:
    """Random-projection trees over the rows of one shard."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 7):
        n, dim = rows.shape
        self.rows, self.trees = rows, trees
        self.depth = max(0, int(np.ceil(np.log2(max(1, n / leaf_rows)))))
        self.directions = np.random.default_rng(seed).normal(size=(trees, max(1, self.depth), dim))
        self.cuts = np.zeros((trees, 1 << self.depth))  # of node 2**level - 1 + place in level
        self.members: list[list[np.ndarray]] = []
        for t in range(trees):
            shadow = rows @ self.directions[t].T
            held = [np.arange(n)]
            for level in range(self.depth):
                below = []
                for place, rows_here in enumerate(held):
                    value = shadow[rows_here, level]
                    order = np.argsort(value, kind="stable")  # equal rows still split in halves
                    half = len(order) // 2
                    if len(order):
                        self.cuts[t, (1 << level) - 1 + place] = value[order[max(half - 1, 0) : half + 1]].mean()
                    below += [rows_here[order[:half]], rows_here[order[half:]]]
                held = below
            self.members.append(held)

    def gather(self, query: np.ndarray, want: int) -> np.ndarray:
        """Rows of the leaves that the shared queue reaches first."""
        margin = np.einsum("tld,d->tl", self.directions, query)
        seen = np.zeros(len(self.rows), dtype=bool)
        queue = [(0.0, t, 0, 0) for t in range(self.trees)]
        heapify(queue)
        got, since, size = 0, 0, max(1, len(self.rows) >> self.depth)
        while queue and got < want:
            far, t, level, place = heappop(queue)
            gaps, cuts = margin[t], self.cuts[t]
            while level < self.depth:
                gap = gaps[level] - cuts[(1 << level) - 1 + place]
                right = gap > 0
                heappush(queue, (max(far, abs(gap)), t, level + 1, 2 * place + (not right)))
                level, place = level + 1, 2 * place + right
            seen[self.members[t][place]] = True
            since += size
            if got + since >= want or not queue:  # no fewer leaves could do
                got, since = int(seen.sum()), 0
        return np.flatnonzero(seen)


def nearest(vectors_df: DataFrame, queries_df: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows found for each query by Euclidean distance: query_id, rank, vec_id, score (the distance).

    Nearest first, ties to the smaller vec_id; a query's own id is no candidate.  Scores are exact; the set is
    approximate (recall 0.9 or more on vectors without structure, see SHARE).  Rows with a null id, a null, empty or
    zero vector or null or non-finite components take no part; rows that repeat id and vector count once.  Vectors
    are compared within their dimension.  With fewer candidates all are returned; empty tables give no rows.
    """

    def ready(df: DataFrame) -> DataFrame:
        return vectors(df, id_col, vector_col).where(F.exists("vector", lambda x: x != 0))

    rows, queries = stage(ready(vectors_df), "ann-rows"), stage(ready(queries_df), "ann-queries")

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if q.num_rows and c.num_rows:
            ids, points = c["vec_id"].to_numpy(), matrix(c["vector"])
            forest = Forest(points)
            want = min(len(ids), max(LEAST, k + 1, int(np.ceil(SHARE * len(ids)))))
            for own, point in zip(q["vec_id"].to_numpy(), matrix(q["vector"]), strict=True):
                at = forest.gather(point, want)
                at = at[ids[at] != own]
                score = np.sqrt(((points[at] - point) ** 2).sum(axis=1))
                if len(at) > k:
                    keep = score <= np.partition(score, k - 1)[k - 1]
                    at, score = at[keep], score[keep]
                order = np.lexsort((ids[at], score))[:k]
                out += [(own, i, s) for i, s in zip(ids[at[order]], score[order], strict=True)]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds.items(), columns, strict=True)})

    cells = meet(queries, rows, run, "query_id long, vec_id long, score double", rows.count(), queries.count(), SHARD_ROWS, QUERY_ROWS)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return cells.dropDuplicates().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
