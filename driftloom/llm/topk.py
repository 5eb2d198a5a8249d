"""Exact top-k search by integer inner product, pruned with segment statistics from coarse to fine.

A vector is cut into segments; each segment keeps its mean and its deviation from that mean.  For two vectors the
product of the means plus the product of the deviations bounds the segment's inner product from above (which is the
squared distance bounded from below, the norms being known).  Coarse bounds leave out most work early: one segment,
then four, then sixteen; the survivors get their exact scores.

Queries and candidates meet in cells of bounded size: every group of candidates meets every block of queries once, and
a cell returns its best k.  The work is the stated query set against all rows; no task holds more than one cell.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.common import finite, parts, vectors
from driftloom.sources.stage import stage

#: Rows of a candidate group and of a query block at most, on average.
GROUP_ROWS, QUERY_ROWS = 65_536, 8_192
#: Segments of each level; tiles of queries and candidates that are bounded together.
LEVELS = (1, 4, 16)
TILE_QUERIES, TILE_ROWS = 64, 4_096
#: Scores and sums of this size are exact in 64 bits; larger ones are added up in Python.
SAFE = 2.0**62


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def statistics(rows: np.ndarray, segments: int) -> np.ndarray:
    """Per segment sqrt(length) * mean and the norm of what is left; products of these bound inner products."""
    width = -(-rows.shape[1] // segments)
    cut = np.pad(rows, ((0, 0), (0, width * segments - rows.shape[1]))).reshape(len(rows), segments, width)
    mean = cut.mean(axis=2)
    rest = np.sqrt(((cut - mean[:, :, None]) ** 2).sum(axis=2))
    return np.concatenate([mean * np.sqrt(width), rest], axis=1)


def products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact integer inner products, and which are not below a long: in doubles while these hold them, else in 64-bit
    integers, else in Python.  One above a long raises."""
    most = max(float(np.abs(a).max(initial=0)), 1.0) * max(float(np.abs(b).max(initial=0)), 1.0) * a.shape[1]
    fits = np.ones((len(a), len(b)), dtype=bool)
    if most < 2**53:
        return (a @ b.T).astype(np.int64), fits
    with np.errstate(invalid="ignore", over="ignore"):  # what does not fit is added up below
        out = a.astype(np.int64) @ b.astype(np.int64).T
        wide = np.argwhere(~(np.abs(a) @ np.abs(b).T < SAFE)) if most >= SAFE else ()
    for i, j in wide:
        score = sum(int(x) * int(y) for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True))
        if score >= 2**63:
            raise OverflowError(f"the score {score} does not fit a long")
        fits[i, j] = score >= -(2**63)
        out[i, j] = score if fits[i, j] else 0
    return out, fits


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(score) > k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        keep = score >= floor
        score, ids = score[keep], ids[keep]
    order = np.lexsort((ids, ~score))[:k]  # the least long has no negative
    return score[order], ids[order]


def search_cell(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Top k of each query among the candidates, without the query's own id."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q_ids]
    near = [statistics(c, n) for n in LEVELS]
    sizes = np.sqrt((c**2).sum(axis=1))
    order = np.argsort(-near[0][:, 0], kind="stable")  # similar means stand together
    for low in range(0, len(q), TILE_QUERIES):
        own = slice(low, min(low + TILE_QUERIES, len(q)))
        mine = [statistics(q[own], n) for n in LEVELS]
        own_sizes = np.sqrt((q[own] ** 2).sum(axis=1))
        floor = np.full(own.stop - low, -np.inf)
        for start in range(0, len(order), TILE_ROWS):
            rows = order[start : start + TILE_ROWS]
            for have, want in zip(near, mine, strict=True):
                bound = want @ have[rows].T
                bound += 1e-6 * (1 + np.abs(bound)) + 1e-9 * np.outer(own_sizes, sizes[rows])  # rounding must not lose a row
                rows = rows[~(bound < floor[:, None]).all(axis=0)]  # a bound that is no number keeps it
                if not len(rows):
                    break
            if not len(rows):
                continue
            exact, fits = products(q[own], c[rows])
            for i in range(own.stop - low):
                at = np.flatnonzero(fits[i] & (exact[i] >= floor[i]) & (c_ids[rows] != q_ids[low + i]))
                if len(at):
                    score, ids = found[low + i]
                    found[low + i] = best(np.append(score, exact[i, at]), np.append(ids, c_ids[rows[at]]), k)
                    if len(found[low + i][0]) == k:
                        floor[i] = found[low + i][0][-1]
    return found


def meet(queries: DataFrame, rows: DataFrame, run, schema: str, n_rows: int, n_queries: int, group_rows: int, query_rows: int) -> DataFrame:
    """Brings each group of candidates together with each block of queries, as one bounded cell.

    Vectors of other dimensions never share a cell.  Groups and blocks are dealt by a hash of id and vector.
    """
    groups, query_blocks = parts(rows, n_rows, group_rows), -(-n_queries // query_rows) or 1
    deal = F.xxhash64("vec_id", "vector")

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.select(
            F.size("vector").alias("dim"),
            F.pmod(deal, F.lit(n_own)).alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)).cast("array<long>")).alias(other),
            "vec_id",
            "vector",
        )

    key = ["dim", "grp", "blk"]
    left = dealt(queries, "blk", query_blocks, "grp", groups).groupBy(*key)
    right = dealt(rows, "grp", groups, "blk", query_blocks).groupBy(*key)
    return left.cogroup(right).applyInArrow(run, schema)


def top_k(
    vectors_df: DataFrame, queries_df: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, *, whole: bool = False
) -> DataFrame:
    """The k rows with the highest inner product of floor(scale * x), for each query: query_id, rank, vec_id, score.

    Ties go to the smaller vec_id; a query's own id is no candidate; with fewer candidates all are returned, and a
    query without any has no rows.  Rows with a null id, a null or empty vector, or components that are null or not
    finite (before or after scaling) take no part.  Rows that repeat id and vector count once.  Vectors are
    compared with those of their own dimension.  Extra columns are not read; empty tables give an empty result.

    With ``whole`` all other rows take part: a score above a long raises, a pair whose score is below a long is left
    out.  Without it, vectors whose inner product with themselves (scaled) is not below 2**63 are left out too, also
    where their scores with others would fit; no score is outside of a long then.
    """
    large = F.lit(2.0**52)  # doubles from here on are integers, and may not fit a long
    cell = F.transform("vector", lambda x: F.when(F.abs(x * scale) < large, F.floor(x * scale).cast("double")).otherwise(x * scale))

    def ready(df: DataFrame) -> DataFrame:
        rows = vectors(df, id_col, vector_col).select("vec_id", cell.alias("vector")).where(finite(F.col("vector")))
        if not whole:
            rows = rows.where(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x) < 2.0**63)
        return rows.dropDuplicates()

    rows, queries = stage(ready(vectors_df), "topk-rows"), stage(ready(queries_df), "topk-queries")

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        q_ids = q["vec_id"].to_numpy()
        found = search_cell(q_ids, matrix(q["vector"]), c["vec_id"].to_numpy(), matrix(c["vector"]), k)
        return pa.table(
            {
                "query_id": np.repeat(q_ids, [len(s) for s, _ in found]),
                "vec_id": np.concatenate([i for _, i in found]).astype(np.int64),
                "score": np.concatenate([s for s, _ in found]).astype(np.int64),
            }
        )

    cells = meet(queries, rows, run, "query_id long, vec_id long, score long", rows.count(), queries.count(), GROUP_ROWS, QUERY_ROWS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return cells.dropDuplicates().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
