"""Shards of near-equal bytes along a Hilbert curve, with groups of equal texts kept together.

Several metadata dimensions are quantised and combined to an index along a Hilbert curve; groups of equal texts are
sorted by it and cut into runs, so that a shard covers a compact region of all dimensions and files can be pruned on
any of them.  A group that is large against a shard is assigned first, to the lightest shard; the runs of the others
then fill every shard to the same size.  Running sums go through three levels (regions of the curve, cells, groups),
and a very large group numbers its rows in parts, so no task holds more than a cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from driftloom.sources.stage import stage

#: Bits of each dimension; bits of a region of the curve.
BITS, REGION_BITS = 6, 12
#: A group is large from this share of a shard on, so there are shards / LARGE of them at most.
LARGE = 1 / 256
#: Rows of a group that one task numbers.
NUMBERED = 100_000


def hilbert_numbers(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (one row each, ``bits`` bits a coordinate).

    From the highest bit down, the coordinates are turned into the frame of the sub-cube they lie in; the Gray code of
    the bits is undone, and the bits are interleaved.
    """
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            inside = (x[:, i] >> level) & 1 == 1
            swap = np.where(inside, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(inside, low, swap)
            if i:
                x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, n - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip[:, None]
    out = np.zeros(len(x), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[:, i] >> level) & 1
    return out


def hilbert(dims: list[Column], bits: int = BITS) -> Column:
    """The curve index of integer columns; null counts as 0."""

    @pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_numbers(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    top = (1 << bits) - 1
    return index(*[F.greatest(F.lit(0), F.least(F.lit(top), F.coalesce(d.cast("int"), F.lit(0)))) for d in dims])


def text_dims(docs: DataFrame, text_col: str = "text", categories: tuple[str, ...] = ("lang", "source")) -> list[Column]:
    """Size on a log scale, share of bytes beyond ASCII, and hashed categories: the dimensions of ``documents``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_bytes, n_chars = F.octet_length(text), F.char_length(text)
    top = 1 << BITS
    beyond = (F.lit(top) * (n_bytes - n_chars) / F.greatest(n_bytes, F.lit(1))).cast("int")
    return [(F.log2(n_bytes + 1) * 3).cast("int"), beyond, *[F.pmod(F.xxhash64(c), F.lit(top)).cast("int") for c in categories]]


def _assign(heavy: list, total: int, n_shards: int) -> tuple[list[tuple], list[int]]:
    """Large groups to shards, largest first to the lightest; and the bytes that the other groups add to each shard."""
    load, rows = [0] * n_shards, [0] * n_shards
    out = []
    for r in sorted(heavy, key=lambda r: (-r["bytes"], r["sha"])):
        s = min(range(n_shards), key=lambda k: (load[k], k))
        out.append((r["sha"], s, rows[s]))
        load[s] += r["bytes"]
        rows[s] += r["n"]
    left = total - sum(load)
    open_to, level = sorted(range(n_shards), key=lambda k: load[k]), 0.0
    for k in range(1, n_shards + 1):  # the common height that the rest reaches
        level = (left + sum(load[s] for s in open_to[:k])) / k
        if k == n_shards or level <= load[open_to[k]]:
            break
    return out, [max(0.0, level - b) for b in load]


def shards(docs: DataFrame, dims: list[Column], n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A shard and a slot for every document: doc_id, size, text_crc32, shard, slot.

    size is the text's bytes plus 1 (null: 1).  Equal texts (null is one text, and not the empty one) share a shard.
    Shards are of near-equal bytes: large groups are placed first, and the rest is cut at the same height, so sizes
    differ by LARGE of a shard or so, unless one group alone is more than a shard.  Slots are gapless from 0 in each
    shard: large groups, then the order of the curve.  One row per input row; repeated rows and null ids get slots of
    their own.  Columns other than id, text and those of ``dims`` are not read; an empty table stays empty.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")).alias("text_crc32"),
        F.coalesce(F.sha2(F.col(text_col), 256), F.lit("null")).alias("sha"),
        *[d.alias(f"_d{i}") for i, d in enumerate(dims)],
    )
    names = [f"_d{i}" for i in range(len(dims))]
    rows = stage(rows, "shard-rows")
    groups = rows.groupBy("sha").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *[F.min(c).alias(c) for c in names])
    groups = stage(groups.select("sha", "bytes", "n", hilbert([F.col(c) for c in names]).alias("curve"), F.substring("sha", 1, 3).alias("pre")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") >= F.lit(LARGE * total / n_shards)
    heavy, room = _assign(groups.where(large).select("sha", "bytes", "n").collect(), total, n_shards)  # n_shards / LARGE rows at most
    heavy_rows = spark.createDataFrame(heavy, "sha string, shard int, base long")
    taken = heavy_rows.join(groups, "sha").groupBy("shard").agg(F.sum("n").alias("taken"))

    small = groups.where(~large).withColumn("region", F.shiftright("curve", REGION_BITS))
    cells = small.groupBy("region", "curve", "pre").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    regions = cells.groupBy("region").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))

    def before(df: DataFrame, own: list[str], order: list[str], name: str) -> DataFrame:
        w = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(*own, *order, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{name}_{c}") for c in ("bytes", "n")])

    in_region = before(cells, ["region"], ["curve", "pre"], "b")
    in_all = before(regions.withColumn("all", F.lit(0)), ["all"], ["region"], "a").drop("all")  # 4096 rows at most
    in_cell = before(small, ["curve", "pre"], ["sha"], "c")
    start = in_cell.join(in_region, ["curve", "pre"]).join(in_all, "region")
    start = start.select("sha", F.expr("a_bytes + b_bytes + c_bytes").alias("first_byte"), F.expr("a_n + b_n + c_n").alias("first_row"))
    ends = np.cumsum(room)
    shard = F.lit(n_shards - 1)
    for s in range(n_shards - 2, -1, -1):
        shard = F.when(F.col("first_byte") < F.lit(float(ends[s])), F.lit(s)).otherwise(shard)
    placed = stage(start.select("sha", shard.alias("shard"), "first_row"), "shard-runs")
    begins = placed.groupBy("shard").agg(F.min("first_row").alias("begin")).join(taken, "shard", "left")
    light = placed.join(F.broadcast(begins), "shard").select("sha", "shard", (F.col("first_row") - F.col("begin") + F.coalesce("taken", F.lit(0))).alias("base"))
    where = stage(light.unionByName(heavy_rows).join(groups.select("sha", "n"), "sha"), "shard-places")

    part = F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("n") / NUMBERED))
    numbered = rows.select("doc_id", "size", "text_crc32", "sha").join(where, "sha").withColumn("part", part)
    sums = numbered.groupBy("sha", "part").agg(F.count("*").alias("rows"))
    w = Window.partitionBy("sha").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sha", "part", F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("sha", "part").orderBy("doc_id")) - 1
    out = numbered.withColumn("own", own).join(sums, ["sha", "part"])
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("ahead") + F.col("own")).cast("long").alias("slot"))
