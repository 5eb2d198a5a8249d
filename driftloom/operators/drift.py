"""Drift of production batches against a reference, all features and batches in one job.

The reference is sorted once.  Batches ask it for ranks ("how many reference
rows lie below x") instead of being paired with its rows, so the work is
n log n in rows and never reference rows x batches.

Input rows carry ``is_reference``, the batch column, optional ``keys`` (such
as a model id; each key value has its own reference) and the features.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from driftloom.functions import thresholds as T
from driftloom.functions.statistics import band, chi2_p_value, clip, ks_p_value, psi_severity, ratio
from driftloom.operators.ordered import (
    BUCKET,
    add_feature_bucket,
    bucket_count,
    clean,
    cuts_of_row,
    feature_cuts,
    melt,
    melted_counts,
    quantiles_of_counts,
    running_sums,
    value_counts,
)
from driftloom.sources.stage import stage

REF = "is_reference"
PER_GROUP = 50_000  # distinct values of a bucket that are compared together
PER_TASK = 500_000  # distinct values of a task's buckets, where there are more than the session's shuffle width takes


def null_is_a_key(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Lets a drift operator see its keys and batch as structs, which are equal to themselves also where they hold null."""

    @wraps(work)
    def run(df: DataFrame, *args, keys: Sequence[str] = (), batch: str = "batch_id", **rest) -> DataFrame:
        named = [*keys, batch]
        out = work(df.withColumns({c: F.struct(F.col(c).alias("v")) for c in named}), *args, keys=keys, batch=batch, **rest)
        return out.withColumns({c: F.col(c)["v"] for c in named})

    return run


def _sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(REF)), df.filter(~F.col(REF))


def side_ranges(df: DataFrame, features: Sequence[str], keys: Sequence[str], batch: str) -> DataFrame:
    """Min, max, count and population std per (keys, batch, feature), reference beside batch.

    One wide pass with map-side aggregation.  The result is one small row per
    batch and feature and is staged, so that joins with it see its true size.
    """
    keys = list(keys)
    per_side = (
        df.withColumn("_batch", F.when(~F.col(REF), F.col(batch)))
        .groupBy(*keys, REF, "_batch")
        .agg(
            *[
                F.struct(
                    F.min(clean(f)).alias("lo"),
                    F.max(clean(f)).alias("hi"),
                    F.count(clean(f)).alias("n"),
                    F.stddev_pop(clean(f)).alias("sd"),
                ).alias(f)
                for f in features
            ]
        )
        .unpivot([*keys, REF, "_batch"], list(features), "feature", "s")
    )
    per_side = stage(per_side, "ranges")
    ref, prod = _sides(per_side)
    ref = ref.select(*keys, "feature", *[F.col(f"s.{c}").alias(f"ref_{c}") for c in ("lo", "hi", "n", "sd")])
    prod = prod.select(
        *keys, F.col("_batch").alias(batch), "feature", *[F.col(f"s.{c}").alias(f"_{c}") for c in ("lo", "hi", "n")]
    )
    return prod.join(ref, [*keys, "feature"], "left").select(
        *keys,
        batch,
        "feature",
        F.least("_lo", "ref_lo").alias("lo"),
        F.greatest("_hi", "ref_hi").alias("hi"),
        F.coalesce("ref_n", F.lit(0).cast("long")).alias("n_ref"),
        F.col("_n").alias("n_prod"),
        "ref_sd",
    )


def _edge(i: Column, lo: Column, hi: Column, n_bins: Column) -> Column:
    return i * ((hi - lo) / n_bins) + lo


def _with_bins(df: DataFrame, n_bins: Sequence[int]) -> DataFrame:
    """One row per (row, n_bins) with ``bin`` = number of inner edges <= x.

    The bin is guessed by division and then settled against the exact edges;
    guess and settlement are separate projections so each is computed once.
    """
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")

    def guess(n: int) -> Column:
        width = (hi - lo) / float(n)
        return F.when(width > 0, clip(F.floor((x - lo) / F.when(width > 0, width)).cast("int"), 0, n - 1)).otherwise(n - 1)

    def settled(n: int) -> Column:
        g, total = F.col(f"_g{n}"), F.lit(float(n))
        down = (g > 0) & (x < _edge(g, lo, hi, total))
        up = (g < n - 1) & (x >= _edge(g + 1, lo, hi, total))
        return F.when(up, g + 1).when(down, g - 1).otherwise(g)

    df = df.withColumns({f"_g{n}": guess(n) for n in n_bins})
    cells = F.array(*[F.struct(F.lit(n).alias("n_bins"), settled(n).alias("bin")) for n in n_bins])
    return df.select("*", F.inline(cells)).drop("x", "lo", "hi", *[f"_g{n}" for n in n_bins])


def _limits(df: DataFrame, features: Sequence[str], keys: Sequence[str], batch: str, ranges: DataFrame) -> DataFrame:
    """Batch values (x) beside the limits of their batch and feature (lo, hi)."""
    per_batch = ranges.groupBy(*keys, batch).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("lo", "hi")))).alias("_m")
    )
    per_batch = per_batch.select(*keys, batch, *[F.col("_m")[f].alias(f"_l_{f}") for f in features])
    _, prod = _sides(df)
    sides = [F.struct(clean(f).alias("x"), F.col(f"_l_{f}.lo"), F.col(f"_l_{f}.hi")).alias(f) for f in features]
    return (
        prod.select(*keys, batch, *features)
        .join(per_batch, [*keys, batch])
        .select(*keys, batch, *sides)
        .unpivot([*keys, batch], list(features), "feature", "_s")
        .select(*keys, batch, "feature", "_s.x", "_s.lo", "_s.hi", F.lit(1).cast("long").alias("n"))
        .filter(F.col("x").isNotNull())
    )


@null_is_a_key
def histograms(
    df: DataFrame, features: Sequence[str], n_bins: Sequence[int], *, keys: Sequence[str] = (), batch: str = "batch_id",
) -> DataFrame:
    """Counts of both sides in equal-width bins over the combined range.

    Returns (keys, batch, feature, n_bins, bin, c_ref, c_prod, n_ref, n_prod);
    bins empty on both sides have no row.  Batch rows are binned where they
    are read and only bins are shuffled; the reference is collapsed to counts.
    """
    keys = list(keys)
    ranges = side_ranges(df, features, keys, batch)
    ref, _ = _sides(df)
    ref_counts = value_counts(melt(ref, features, keys), [*keys, "feature"])
    points = _limits(df, features, keys, batch, ranges)
    return _histograms(ranges, points, ref_counts, feature_cuts(ref_counts), n_bins, keys, batch)


def _histograms(
    ranges: DataFrame, points: DataFrame, ref_counts: DataFrame, cuts: DataFrame, n_bins: Sequence[int], keys: Sequence[str], batch: str
) -> DataFrame:
    """Bins from batch points (x, lo, hi, n) and from the ranks of the inner edges in the reference."""
    who = [*keys, batch, "feature"]
    cell = [*who, "n_bins", "bin"]
    prod_cells = _with_bins(points, n_bins).groupBy(*cell).agg(F.sum("n").alias("c_prod"))

    inner = (
        ranges.filter((F.col("n_prod") > 0) & (F.col("n_ref") > 0))
        .withColumn("n_bins", F.explode(F.array(*[F.lit(n) for n in n_bins])))
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)))
    )
    probes = inner.filter(F.col("bin") > 0).select(
        *cell,
        _edge(F.col("bin"), F.col("lo"), F.col("hi"), F.col("n_bins").cast("double")).alias("value"),
        F.lit(0).cast("long").alias("n"),
    )
    rows = ref_counts.select(*keys, "feature", "value", "n").unionByName(probes, allowMissingColumns=True)
    rows = add_feature_bucket(rows, cuts)
    at = Window.partitionBy(*keys, "feature", BUCKET, "value")
    ranked = (
        running_sums(rows, [*keys, "feature"], ["value"], ["n"])
        .withColumn("below", F.col("n_cum") - F.sum("n").over(at))
        .filter(F.col("bin").isNotNull())
        .select(*cell, "below")
    )
    order = Window.partitionBy(*who, "n_bins").orderBy("bin")
    ref_cells = (
        inner.select(*cell, "n_ref", "n_prod")
        .join(ranked, cell, "left")
        .withColumn("below", F.coalesce("below", F.lit(0)))
        .withColumn("c_ref", F.coalesce(F.lead("below").over(order), F.col("n_ref")) - F.col("below"))
    )
    return (
        ref_cells.join(prod_cells, cell, "left")
        .withColumn("c_prod", F.coalesce("c_prod", F.lit(0).cast("long")))
        .filter((F.col("c_ref") > 0) | (F.col("c_prod") > 0))
        .select(*cell, "c_ref", "c_prod", "n_ref", "n_prod")
    )


def _shares() -> tuple[Column, Column]:
    return ratio(F.col("c_ref"), F.col("n_ref")), ratio(F.col("c_prod"), F.col("n_prod"))


def psi_term() -> Column:
    r, p = _shares()
    r, p = r + T.SMOOTHING, p + T.SMOOTHING
    return (p - r) * F.ln(p / r)


def divergence_term(n_bins: Column) -> Column:
    """One bin's part of the Jensen-Shannon divergence of smoothed, renormalised shares."""
    r, p = _shares()
    norm = 1 + n_bins * T.SMOOTHING
    r, p = (r + T.SMOOTHING) / norm, (p + T.SMOOTHING) / norm
    m = (r + p) / 2
    return (r * F.ln(r / m) + p * F.ln(p / m)) / 2


def psi(df, features, n_bins=(T.PSI_BINS,), *, keys=(), batch="batch_id") -> DataFrame:
    """Population stability index and its severity per (keys, batch, feature, n_bins)."""
    return (
        histograms(df, features, n_bins, keys=keys, batch=batch)
        .groupBy(*keys, batch, "feature", "n_bins")
        .agg(F.sum(psi_term()).alias("psi"))
        .withColumn("severity", psi_severity(F.col("psi")))
    )


def jensen_shannon(df, features, n_bins=T.JSD_BINS, *, keys=(), batch="batch_id") -> DataFrame:
    """Jensen-Shannon distance (root of the divergence, natural log)."""
    return (
        histograms(df, features, [n_bins], keys=keys, batch=batch)
        .groupBy(*keys, batch, "feature")
        .agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(divergence_term(F.col("n_bins"))))).alias("jsd"))
    )


def batch_counts(
    df: DataFrame, features: Sequence[str], keys: Sequence[str], batch: str
) -> tuple[DataFrame, DataFrame]:
    """Bucketed counts of the distinct values of every batch and of the reference (NULL ``_batch``), and their totals.

    This is the only scan of the rows; all ordered statistics read the staged counts.  The totals are one staged row
    per bucket and side.  Their squares are taken around the feature's middle cut point, which keeps the one-pass
    variance exact enough.
    """
    side = df.withColumn("_batch", F.when(~F.col(REF), F.col(batch)))
    counts = melted_counts(side, features, [*keys, REF, "_batch"])
    cuts = feature_cuts(counts)
    counts = add_feature_bucket(counts, cuts)
    n = F.col("n")
    middle = F.coalesce(F.get(cuts_of_row(cuts), F.lit(bucket_count(df.sparkSession) // 2 - 1)), F.lit(0.0))
    d = F.col("_d")
    totals = counts.withColumn("_d", F.col("value") - middle).groupBy(*keys, "feature", BUCKET, REF, "_batch").agg(
        F.count(F.lit(1)).alias("rows"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum(n).alias("n"),
        F.sum(n * F.col("value")).alias("sum"), F.sum(n * d).alias("_s1"), F.sum(n * d * d).alias("_s2"),
    )
    return counts, stage(totals, "bucket-totals")


def ranges_of_totals(totals: DataFrame, keys: Sequence[str], batch: str) -> DataFrame:
    """``side_ranges`` computed from totals, with mean and sample std of both sides; staged.

    A constant side has std 0.
    """
    n = F.col("n")
    group = [*keys, "feature", REF, "_batch"]
    sums = totals.groupBy(*group).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.sum(c).alias(c) for c in ("n", "sum", "_s1", "_s2")]
    )
    squares = F.when(F.col("lo") == F.col("hi"), 0.0).otherwise(
        F.greatest(F.lit(0.0), F.col("_s2") - F.col("_s1") * F.col("_s1") / n)
    )
    sums = sums.select(*group, "lo", "hi", "n", (F.col("sum") / n).alias("mean"), squares.alias("sq"))
    ref, prod = _sides(stage(sums, "ranges"))
    ref = ref.select(*keys, "feature", *[F.col(c).alias(f"ref_{c}") for c in ("lo", "hi", "n", "mean", "sq")])
    prod = prod.select(*keys, F.col("_batch").alias(batch), "feature", "lo", "hi", "n", "mean", "sq")

    def sample_std(sq: str, rows: str) -> Column:
        rows = F.col(rows)
        return F.when(rows > 1, F.sqrt(F.col(sq) / F.when(rows > 1, rows - 1)))

    return prod.join(ref, [*keys, "feature"], "left").select(
        *keys,
        batch,
        "feature",
        F.least("lo", "ref_lo").alias("lo"),
        F.greatest("hi", "ref_hi").alias("hi"),
        F.coalesce("ref_n", F.lit(0).cast("long")).alias("n_ref"),
        F.col("n").alias("n_prod"),
        F.sqrt(F.col("ref_sq") / F.col("ref_n")).alias("ref_sd"),
        "ref_mean",
        sample_std("ref_sq", "ref_n").alias("ref_std"),
        F.col("mean").alias("prod_mean"),
        sample_std("sq", "n").alias("prod_std"),
    )


class _Steps:
    """The reference share inside a bucket, a step function from ``start`` on, and its integral."""

    def __init__(self, value: np.ndarray, n: np.ndarray, before: int, size: int, start: float):
        order = np.argsort(value)
        self.value = value[order]
        self.n = np.append(0, np.cumsum(n[order]))
        self.at = np.append(start, self.value)
        self.share = (before + self.n) / size
        self.area = np.append(0.0, np.cumsum(self.share[:-1] * np.diff(self.at)))

    def upto(self, x: np.ndarray) -> np.ndarray:
        return self.share[np.searchsorted(self.value, x, "right")]

    def below(self, x: np.ndarray) -> np.ndarray:
        return self.share[np.searchsorted(self.value, x, "left")]

    def integral(self, x: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.value, x, "right")
        return self.area[i] + self.share[i] * (x - self.at[i])

    def reaches(self, share: np.ndarray, end: float) -> np.ndarray:
        """Where the reference share first is as large; ``end`` if it is not in this bucket."""
        return np.append(self.at, end)[np.searchsorted(self.share, share, "left")]

    def cells(self, edges: np.ndarray) -> np.ndarray:
        """Reference rows between the edges."""
        return np.diff(self.n[np.searchsorted(self.value, edges, "left")], prepend=0, append=self.n[-1])


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value, null included; the values are structs of one field."""
    values = column.combine_chunks().flatten()[0]
    if pa.types.is_nested(values.type):
        values = pa.array([repr(v) for v in values.to_pylist()], pa.string())
    return values.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)


def _compare_bucket(values: pa.Table, heads: pa.Table, names: Sequence[str], n_bins: Sequence[int]) -> pa.Table:
    """KS distance, integral of the gap between the shares and cells of every batch inside one bucket.

    ``heads`` has one row a batch: what lies before the bucket, and the bucket's ends.  Between two values of a batch
    its share is constant and the reference share only grows, so the gap changes its sign once at most.
    """
    is_ref, value, n = (values[c].to_numpy() for c in (REF, "value", "n"))
    at = {c: heads[c].to_numpy() for c in AT}
    k = heads.num_rows
    ks, distance, cells = np.full(k, np.nan), np.full(k, np.nan), [[] for _ in range(k)]
    if k and at["n_ref"][0] > 0:
        start, end = at["first"][0], at["next"][0]
        ref = _Steps(value[is_ref], n[is_ref], at["r_before"][0], at["n_ref"][0], start)
        code = _codes(pa.chunked_array([*heads["_batch"].chunks, *values["_batch"].filter(pa.array(~is_ref)).chunks]))
        of_head = np.empty(code.max() + 1, dtype=int)
        of_head[code[:k]] = np.arange(k)
        own, head = of_head[code], np.arange(len(code)) < k
        v = np.append(np.full(k, start), value[~is_ref])
        n = np.append(at["n_before"], n[~is_ref])
        order = np.lexsort((~head, v, own))
        own, v, n, head = own[order], v[order], n[order], head[order]
        starts = np.flatnonzero(head)
        passed = np.cumsum(n)
        passed -= (passed[starts] - n[starts])[own]
        size = at["n_prod"][own]
        g, g_below = passed / size, (passed - n) / size
        gap = np.maximum(np.abs(ref.upto(v) - g), np.abs(ref.below(v) - g_below))
        ks = np.maximum.reduceat(np.where(head, -1.0, gap), starts)
        ks[ks < 0] = np.nan
        upto = np.append(v[1:], end)
        upto[np.append(head[1:], True)] = end
        turn = np.clip(ref.reaches(g, end), v, upto)
        area, area_turn, area_upto = ref.integral(v), ref.integral(turn), ref.integral(upto)
        distance = np.add.reduceat(g * (turn - v) - (area_turn - area) + (area_upto - area_turn) - g * (upto - turn), starts)
        n = np.where(head, 0, n)
        for i, (a, b) in enumerate(zip(starts, np.append(starts[1:], len(v)), strict=True)):
            for bins in n_bins:
                edges = np.arange(1, bins) * ((at["hi"][i] - at["lo"][i]) / bins) + at["lo"][i]
                prod = np.bincount(np.searchsorted(edges, v[a:b], "right"), n[a:b], bins).astype(int)
                both = ref.cells(edges)
                cells[i] += [
                    {"n_bins": bins, "bin": j, "c_ref": int(both[j]), "c_prod": int(prod[j])} for j in np.flatnonzero(both + prod).tolist()
                ]
    return pa.table(
        [*[heads[c] for c in names], pa.array(ks, from_pandas=True), pa.array(distance, from_pandas=True), pa.array(cells, CELLS)],
        [*names, "ks", "distance", "cells"],
    )


AT = ("first", "next", "r_before", "n_before", "n_ref", "n_prod", "lo", "hi")
CELLS = pa.list_(pa.struct([("n_bins", pa.int32()), ("bin", pa.int32()), ("c_ref", pa.int64()), ("c_prod", pa.int64())]))


def _compared(
    counts: DataFrame, totals: DataFrame, ranges: DataFrame, keys: Sequence[str], batch: str, n_bins: Sequence[int] = ()
) -> tuple[DataFrame, DataFrame]:
    """KS distance and integral of the gap between both shares per (keys, batch, feature), and the cells of all n_bins.

    One exchange brings the values of a bucket together, those of the reference once for all batches.  A bucket
    reaches from its first value to the first of the next one, and holds some PER_GROUP values.
    """
    feature = [*keys, "feature"]
    who = [*feature, "_batch"]
    spark = counts.sparkSession
    totals = totals.filter(F.col(REF).isNotNull())
    sizes = totals.groupBy(*feature).agg(F.sum("rows").alias("n")).agg(F.max("n"), F.sum("n")).first()
    most, whole = sizes[0] or 0, sizes[1] or 0
    n = bucket_count(spark)
    merged = F.shiftright(BUCKET, max(0, n.bit_length() - 1 - (most // PER_GROUP).bit_length())).alias(BUCKET)

    per = totals.withColumn(BUCKET, merged).groupBy(*feature, BUCKET, REF, "_batch").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")
    )
    along = Window.partitionBy(*feature).orderBy(BUCKET)
    before = (Window.unboundedPreceding, -1)
    places = per.groupBy(*feature, BUCKET).agg(
        F.min("lo").alias("first"), F.max("hi").alias("last"), F.sum(F.when(F.col(REF), F.col("n")).otherwise(0)).alias("r")
    ).select(
        *feature, BUCKET, "first", F.coalesce(F.lead("first").over(along), "last").alias("next"),
        F.coalesce(F.sum("r").over(along.rowsBetween(*before)), F.lit(0)).alias("r_before"),
    )
    batches = ranges.select(*feature, F.col(batch).alias("_batch"), "n_ref", "n_prod", "lo", "hi")
    own = per.filter(~F.col(REF)).select(*who, BUCKET, "n")
    of_batch = Window.partitionBy(*who).orderBy(BUCKET).rowsBetween(*before)
    heads = places.join(batches, feature).join(own, [*who, BUCKET], "left").withColumn(
        "n_before", F.coalesce(F.sum("n").over(of_batch), F.lit(0))
    )
    heads = heads.select(*who, BUCKET, *AT)
    values = counts.filter(F.col(REF).isNotNull()).select(*feature, merged, REF, "_batch", "value", "n")
    shape = heads.select(*who).schema.add("ks", "double").add("distance", "double")
    cell = StructType().add("n_bins", "integer").add("bin", "integer").add("c_ref", "long").add("c_prod", "long")
    shape = shape.add("cells", ArrayType(cell))
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), whole // PER_TASK)
    values, heads = (t.repartition(width, *feature, BUCKET).groupBy(*feature, BUCKET) for t in (values, heads))
    found = values.cogroup(heads).applyInArrow(lambda v, h: _compare_bucket(v, h, who, n_bins), shape)
    found = stage(found, "compared").withColumnRenamed("_batch", batch)
    who = [*feature, batch]
    cells = found.select(*who, F.inline("cells")).groupBy(*who, "n_bins", "bin").agg(
        F.sum("c_ref").alias("c_ref"), F.sum("c_prod").alias("c_prod")
    )
    distances = found.groupBy(*who).agg(F.max("ks").alias("ks"), F.sum("distance").alias("distance"))
    return distances, cells.join(ranges.select(*who, "n_ref", "n_prod"), who)


@null_is_a_key
def ks(df, features, *, keys=(), batch="batch_id") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance and limiting p-value.

    Between two batch points the batch share is constant and the reference
    share only grows, so the largest gap lies at a batch point or just below it.
    """
    keys = list(keys)
    who = [*keys, batch, "feature"]
    counts, totals = batch_counts(df, features, keys, batch)
    ranges = ranges_of_totals(totals, keys, batch)
    distances, _ = _compared(counts, totals, ranges, keys, batch)
    out = distances.select(*who, "ks").join(ranges.select(*who, "n_ref", "n_prod"), who)
    return out.withColumn("ks_p", ks_p_value(F.col("ks"), F.col("n_ref"), F.col("n_prod")))


def _normalised(distance: Column, sd: Column) -> Column:
    return F.when(sd < 1e-10, F.lit(0.0)).otherwise(distance / sd)


@null_is_a_key
def wasserstein(df, features, *, keys=(), batch="batch_id") -> DataFrame:
    """Wasserstein-1 distance over the reference's population std (0 if that is 0)."""
    keys = list(keys)
    who = [*keys, batch, "feature"]
    counts, totals = batch_counts(df, features, keys, batch)
    ranges = ranges_of_totals(totals, keys, batch)
    out = _compared(counts, totals, ranges, keys, batch)[0].join(ranges, who)
    return out.select(*who, _normalised(F.col("distance"), F.col("ref_sd")).alias("wasserstein"))


def _shape_scores(cells: DataFrame, who: Sequence[str]) -> DataFrame:
    return cells.groupBy(*who).agg(
        F.sum(F.when(F.col("n_bins") == T.PSI_BINS, psi_term())).alias("psi"),
        F.sqrt(
            F.greatest(F.lit(0.0), F.sum(F.when(F.col("n_bins") == T.JSD_BINS, divergence_term(F.col("n_bins")))))
        ).alias("jsd"),
    )


BOTH_BINS = sorted({T.PSI_BINS, T.JSD_BINS})


def _all_batches(df: DataFrame, features: Sequence[str], keys: Sequence[str], batch: str) -> DataFrame:
    """Every batch with every feature: a feature without values still gets a verdict."""
    _, prod = _sides(df)
    names = F.explode(F.array(*[F.lit(f) for f in features])).alias("feature")
    return prod.select(*keys, batch).distinct().select(*keys, batch, names)


@null_is_a_key
def numeric_scores(df, features, *, keys=(), batch="batch_id", with_stats: bool = False) -> DataFrame:
    """PSI, KS, JSD and Wasserstein per (keys, batch, feature), with row counts of both sides.

    Rows are read into counts, from which every statistic comes; a second scan of keys alone lists the batches.
    """
    keys = list(keys)
    who = [*keys, batch, "feature"]
    counts, totals = batch_counts(df, features, keys, batch)
    ranges = ranges_of_totals(totals, keys, batch)
    distances, cells = _compared(counts, totals, ranges, keys, batch, BOTH_BINS)
    out = (
        _all_batches(df, features, keys, batch)
        .join(ranges, who, "left")
        .join(_shape_scores(cells, who), who, "left")
        .join(distances, who, "left")
        .withColumn("n_prod", F.coalesce("n_prod", F.lit(0).cast("long")))
        .withColumn("ks_p", ks_p_value(F.col("ks"), F.col("n_ref"), F.col("n_prod")))
        .withColumn("wasserstein", _normalised(F.col("distance"), F.col("ref_sd")))
        .drop("lo", "hi", "ref_sd", "distance")
    )
    if with_stats:
        return out.join(_side_quartiles(counts, keys, batch), who, "left")
    return out.drop("ref_mean", "ref_std", "prod_mean", "prod_std")


def numeric_drift(df, features, *, keys=(), batch="batch_id", with_stats: bool = True) -> DataFrame:
    """Scores, verdict and summary statistics of every numeric feature in every batch."""
    return numeric_verdict(numeric_scores(df, features, keys=keys, batch=batch, with_stats=with_stats))


def numeric_verdict(scores: DataFrame) -> DataFrame:
    """Severity from PSI, raised to a warning when KS agrees; too few rows give no verdict."""
    small = F.col("n_prod") < T.MIN_SAMPLES
    few = small | F.col("psi").isNull()
    by_psi = psi_severity(F.col("psi"))
    raised = (by_psi == "none") & (F.col("ks_p") < T.KS_P_VALUE) & (F.col("psi") > T.PSI_WARNING * 0.5)
    severity = F.when(few, "none").when(raised, "warning").otherwise(by_psi)
    message = F.when(
        small,
        F.format_string(f"Insufficient samples (%d < {T.MIN_SAMPLES})", F.col("n_prod")),
    ).when(few, F.lit("No reference values to compare with")).otherwise(
        F.format_string(
            "PSI=%.4f | KS_p=%.4f | JSD=%.4f | Wass=%.4f",
            F.col("psi"), F.col("ks_p"), F.col("jsd"), F.col("wasserstein"),
        )
    )
    return scores.withColumns(
        {
            "method": F.when(few, "PSI").otherwise("PSI+KS+JSD+Wasserstein"),
            "score": F.when(few, F.lit(0.0)).otherwise(F.col("psi")),
            "p_value": F.when(~few, F.col("ks_p")),
            "severity": severity,
            "is_drifted": severity != "none",
            "jsd_severity": band(F.col("jsd"), T.JSD_WARNING, T.JSD_CRITICAL),
            "wasserstein_severity": band(F.col("wasserstein"), T.WASSERSTEIN_WARNING, T.WASSERSTEIN_CRITICAL),
            "message": message,
        }
    )


def _side_quartiles(counts: DataFrame, keys: Sequence[str], batch: str) -> DataFrame:
    """Exact quartiles of both sides, prefixed ref_ and prod_."""
    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    ref, prod = _sides(counts)
    feature = [*keys, "feature"]
    r = quantiles_of_counts(ref.select(*feature, "value", "n", BUCKET), feature, quartiles)
    p = quantiles_of_counts(prod.withColumnRenamed("_batch", batch).select(*feature, batch, "value", "n", BUCKET), [*feature, batch], quartiles)
    return p.select(*feature, batch, *[F.col(q).alias(f"prod_{q}") for q in quartiles]).join(
        r.select(*feature, *[F.col(q).alias(f"ref_{q}") for q in quartiles]), feature
    )


@null_is_a_key
def side_statistics(df, features, *, keys=(), batch="batch_id") -> DataFrame:
    """Mean, sample std and quartiles of both sides, prefixed ref_ and prod_."""
    keys = list(keys)
    who = [*keys, batch, "feature"]
    counts, totals = batch_counts(df, features, keys, batch)
    moments = ranges_of_totals(totals, keys, batch).select(*who, "ref_mean", "ref_std", "prod_mean", "prod_std")
    return moments.join(_side_quartiles(counts, keys, batch), who)


# Categorical features -------------------------------------------------------


def melt_text(df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    wide = df.select(*keys, *[F.col(f).cast("string").alias(f) for f in features])
    return wide.unpivot(list(keys), list(features), "feature", "category").filter(F.col("category").isNotNull())


def category_counts(df, features, *, keys=(), batch="batch_id") -> tuple[DataFrame, DataFrame]:
    """Counts per category: (reference, batches)."""
    keys = list(keys)
    ref, prod = _sides(df)
    r = melt_text(ref, features, keys).groupBy(*keys, "feature", "category").agg(F.count(F.lit(1)).alias("r"))
    p = (
        melt_text(prod, features, [*keys, batch])
        .groupBy(*keys, batch, "feature", "category")
        .agg(F.count(F.lit(1)).alias("p"))
    )
    return r, p


@null_is_a_key
def aligned_categories(df, features, *, keys=(), batch="batch_id") -> DataFrame:
    """Counts of both sides for every category seen on either; an absent one counts 1.

    One group-by per category; the list of a key's batches, one entry per batch,
    is laid against it, so no rows are paired.
    """
    keys = list(keys)
    cat = [*keys, "feature", "category"]
    r, p = category_counts(df, features, keys=keys, batch=batch)
    both = (
        r.unionByName(p, allowMissingColumns=True)
        .groupBy(*cat)
        .agg(
            F.max("r").alias("_r"),
            F.map_from_entries(
                F.collect_list(F.when(F.col("p").isNotNull(), F.struct(batch, "p")))
            ).alias("_by_batch"),
        )
    )
    _, prod = _sides(df)
    if keys:
        batches = prod.groupBy(*keys).agg(F.collect_set(batch).alias("_batches"))
        both = both.join(batches, keys)
    else:
        both = both.withColumn("_batches", prod.agg(F.collect_set(batch)).scalar())
    both = both.withColumn(batch, F.explode("_batches"))
    count = F.element_at("_by_batch", F.col(batch))
    return both.filter(F.col("_r").isNotNull() | count.isNotNull()).select(
        *keys,
        batch,
        "feature",
        "category",
        F.coalesce("_r", F.lit(1).cast("long")).alias("n_ref"),
        F.coalesce(count, F.lit(1).cast("long")).alias("n_prod"),
    )


def _matched(df, features, keys, batch) -> tuple[DataFrame, DataFrame]:
    """Batch categories beside their reference count, and per-feature reference sums."""
    r, p = category_counts(df, features, keys=keys, batch=batch)
    one = F.lit(1.0)
    r_d = F.col("r").cast("double")
    sums = r.groupBy(*keys, "feature").agg(
        F.sum("r").alias("ref_rows"),
        F.count(F.lit(1)).alias("ref_categories"),
        F.sum(one / (r_d + 1)).alias("a0"),
        F.sum(r_d / (r_d + 1)).alias("a1"),
        F.sum(r_d * r_d / (r_d + 1)).alias("a2"),
        top_category("r").alias("ref_top_category"),
    )
    return p.join(r, [*keys, "feature", "category"], "left"), sums


def top_category(count: str) -> Column:
    """Most frequent category, the alphabetically first one on a tie."""
    return F.min_by("category", F.struct(-F.col(count), F.col("category")))


@null_is_a_key
def categorical_scores(df, features, *, keys=(), batch="batch_id") -> DataFrame:
    """Chi-square (2 x k, absent categories count 1, Yates at k = 2) and JSD over shares.

    Reference categories a batch lacks enter through sums over the whole
    reference minus the matched part, so they are never copied per batch.
    """
    keys = list(keys)
    who = [*keys, batch, "feature"]
    joined, sums = _matched(df, features, keys, batch)
    r, p = F.col("r").cast("double"), F.col("p").cast("double")
    full = F.coalesce(r, F.lit(1.0))
    matched = r.isNotNull()
    one = F.lit(1.0)
    per_batch = joined.groupBy(*who).agg(
        F.sum("p").alias("prod_rows"),
        F.count(F.lit(1)).alias("prod_categories"),
        F.sum(F.when(matched, 1).otherwise(0)).alias("n_matched"),
        F.sum(F.when(matched, r).otherwise(F.lit(0.0))).alias("r_matched"),
        F.sum(F.when(matched, p).otherwise(F.lit(0.0))).alias("p_matched"),
        # matched parts to take away from the reference sums
        F.sum(F.when(matched, one / (r + 1)).otherwise(F.lit(0.0))).alias("m0"),
        F.sum(F.when(matched, r / (r + 1)).otherwise(F.lit(0.0))).alias("m1"),
        F.sum(F.when(matched, r * r / (r + 1)).otherwise(F.lit(0.0))).alias("m2"),
        # parts of the categories the batch has
        F.sum(p * p / (full + p)).alias("b0"),
        F.sum(full * p / (full + p)).alias("b1"),
        F.sum(full * full / (full + p)).alias("b2"),
        # one cell pair for the 2 x 2 case
        F.max_by(full, F.col("category")).alias("_r1"),
        F.max_by(p, F.col("category")).alias("_p1"),
        top_category("p").alias("prod_top_category"),
    )
    out = per_batch.join(sums, [*keys, "feature"])

    absent = F.col("ref_categories") - F.col("n_matched")
    unseen = F.col("prod_categories") - F.col("n_matched")
    k = F.col("ref_categories") + unseen
    big_r = (F.col("ref_rows") + unseen).cast("double")
    big_p = (F.col("prod_rows") + absent).cast("double")
    # sum over categories of (r P - p R)^2 / (R P (r + p))
    c2 = F.col("b2") + F.col("a2") - F.col("m2")
    c1 = F.col("b1") + F.col("a1") - F.col("m1")
    c0 = F.col("b0") + F.col("a0") - F.col("m0")
    plain = F.greatest(F.lit(0.0), big_p / big_r * c2 - 2 * c1 + big_r / big_p * c0)
    out = out.withColumns({"k": k, "_R": big_r, "_P": big_p, "_plain": plain})

    # Yates correction of a 2 x 2 table
    total = F.col("_R") + F.col("_P")
    col1 = F.col("_r1") + F.col("_p1")
    expected = F.col("_R") * col1 / total
    gap = F.abs(F.col("_r1") - expected)
    gap = gap - F.least(F.lit(0.5), gap)
    col2 = total - col1
    yates = gap * gap * (
        1 / (F.col("_R") * col1 / total)
        + 1 / (F.col("_P") * col1 / total)
        + 1 / (F.col("_R") * col2 / total)
        + 1 / (F.col("_P") * col2 / total)
    )
    statistic = F.when(F.col("k") == 1, F.lit(0.0)).when(F.col("k") == 2, yates).otherwise(F.col("_plain"))
    # JSD over category shares
    totals = out.select(*who, "ref_rows", "prod_rows")
    divergence = (
        joined.filter(F.col("r").isNotNull())
        .join(totals, who)
        .select(*who, (r / F.col("ref_rows")).alias("x"), (p / F.col("prod_rows")).alias("y"))
        .groupBy(*who)
        .agg(
            F.sum((F.col("x") * F.ln(2 * F.col("x") / (F.col("x") + F.col("y")))
                   + F.col("y") * F.ln(2 * F.col("y") / (F.col("x") + F.col("y")))) / 2).alias("_shared")
        )
    )
    alone = (
        1 - F.col("r_matched") / F.col("ref_rows") + 1 - F.col("p_matched") / F.col("prod_rows")
    ) * F.lit(0.5) * F.ln(F.lit(2.0))
    out = out.join(divergence, who, "left")
    return out.select(
        *who,
        statistic.alias("chi2"),
        (F.col("k") - 1).alias("dof"),
        F.sqrt(F.greatest(F.lit(0.0), F.coalesce("_shared", F.lit(0.0)) + alone)).alias("jsd"),
        F.col("ref_rows").alias("n_ref"),
        F.col("prod_rows").alias("n_prod"),
        "ref_top_category",
        "prod_top_category",
        F.col("ref_categories"),
        F.col("prod_categories"),
    )


def categorical_drift(df, features, *, keys=(), batch="batch_id") -> DataFrame:
    """Chi-square p-value and verdict per (keys, batch, feature)."""
    scores = categorical_scores(df, features, keys=keys, batch=batch).withColumn(
        "p_value", chi2_p_value(F.col("chi2"), F.col("dof").cast("double"))
    )
    drifted = F.col("p_value") < T.CHI2_P_VALUE
    severity = (
        F.when(drifted & (F.col("jsd") > T.JSD_CRITICAL), "critical").when(drifted, "warning").otherwise("none")
    )
    return scores.withColumns(
        {
            "method": F.lit("Chi2+JSD"),
            "score": F.col("chi2"),
            "severity": severity,
            "is_drifted": drifted,
            "message": F.format_string("Chi2=%.2f | p=%.4f | JSD=%.4f", F.col("chi2"), F.col("p_value"), F.col("jsd")),
        }
    )


def label_drift(df, target: str, *, keys=(), batch="batch_id") -> DataFrame:
    """Chi-square and JSD of the target's classes."""
    return categorical_drift(df, [target], keys=keys, batch=batch)


@null_is_a_key
def prediction_drift(df, score: str, *, keys=(), batch="batch_id") -> DataFrame:
    """PSI, KS and JSD of the model's own scores; severity from PSI alone."""
    keys = list(keys)
    rows = df.select(*keys, batch, REF, F.col(score).alias("prediction_score"))
    who = [*keys, batch, "feature"]
    counts, totals = batch_counts(rows, ["prediction_score"], keys, batch)
    ranges = ranges_of_totals(totals, keys, batch)
    distances, cells = _compared(counts, totals, ranges, keys, batch, BOTH_BINS)
    distances = distances.select(*who, "ks").join(ranges.select(*who, "n_ref", "n_prod"), who)
    out = _shape_scores(cells, who).join(distances, who)
    out = out.withColumn("ks_p", ks_p_value(F.col("ks"), F.col("n_ref"), F.col("n_prod")))
    return prediction_verdict(out)


def prediction_verdict(scores: DataFrame) -> DataFrame:
    """Severity of score drift from PSI alone; without scores there is no row."""
    severity = psi_severity(F.col("psi"))
    return scores.filter(F.col("psi").isNotNull()).withColumns(
        {
            "method": F.lit("PSI+KS"),
            "score": F.col("psi"),
            "p_value": F.col("ks_p"),
            "severity": severity,
            "is_drifted": severity != "none",
            "message": F.format_string(
                "Prediction PSI=%.4f | KS_p=%.4f | JSD=%.4f", F.col("psi"), F.col("ks_p"), F.col("jsd")
            ),
        }
    )


# Reports ---------------------------------------------------------------------

DETAIL = ["feature", "method", "score", "p_value", "severity", "is_drifted", "message"]


def drift_details(numeric: DataFrame | None, categorical: DataFrame | None, *, keys=(), batch="batch_id") -> DataFrame:
    """Flat rows of all feature verdicts, one per (keys, batch, feature)."""
    parts = [d.select(*keys, batch, *DETAIL) for d in (numeric, categorical) if d is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def batch_report(details: DataFrame, *, keys=(), batch="batch_id") -> DataFrame:
    """One row per batch: overall score and severity, and the drifted features by name."""
    drifted = F.sum(F.col("is_drifted").cast("int"))
    critical = F.sum((F.col("severity") == "critical").cast("int"))
    numeric = F.col("method").startswith("PSI")
    out = details.groupBy(*keys, batch).agg(
        F.avg(F.when(~F.isnan("score"), F.col("score"))).alias("overall_drift_score"),
        F.avg(F.when(numeric & ~F.isnan("score"), F.col("score"))).alias("mean_psi"),
        F.count(F.lit(1)).alias("n_features"),
        drifted.alias("n_drifted_features"),
        critical.alias("n_critical"),
        F.array_sort(F.collect_list(F.when(F.col("is_drifted"), F.col("feature")))).alias("drifted_features"),
    )
    severity = (
        F.when(
            (F.col("n_critical") > 0)
            | (F.col("n_drifted_features") > F.col("n_features") * F.lit(T.DRIFTED_SHARE_CRITICAL)),
            "critical",
        )
        .when(F.col("n_drifted_features") > 0, "warning")
        .otherwise("none")
    )
    return out.withColumn("overall_severity", severity).withColumn(
        "overall_drift_score", F.coalesce("overall_drift_score", F.lit(0.0))
    )
