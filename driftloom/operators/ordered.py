"""Running sums, ranks and exact quantiles that stay parallel under skew.

A window partitioned by a hot key would sort that key's rows in one task.
Here rows first get a bucket number from cut points of the order columns, so no
(key, bucket) group exceeds about 1/n of the table.  Windows run inside the
groups, and the small per-bucket totals carry the sums across buckets.  The
bucket is a pure function of the row and of one scalar-subquery result, and the
rows behind the cut points are chosen by a hash, so a recomputed task gives the
same answer.

Null is a key like any other.  Keys travel as one struct, which compares equal
where both sides are null, so joins keep such rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.sources.stage import stage

BUCKET = "_bucket"
KEY = "_key"
MAX_BUCKETS = 4096
PER_BUCKET = 64
NESTED = 8  # blocks in a step of a search for a bucket
PLAIN = 200  # parts to which a shuffle writes directly, without holding rows in memory (Spark's default)
HELD = 1 << 19  # rows a task holds before it hands on their counts


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the keys as one struct, which is equal to itself also where a key is null."""
    return df.withColumn(KEY, F.struct(*keys) if keys else F.lit(0))


def _share(columns: Sequence[str], wanted: float, size: Column) -> Column:
    """True for about ``wanted`` of ``size`` rows, the same ones in every run."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)).cast("double") * size <= float(wanted) * (1 << 30)


def bucket_count(spark: SparkSession) -> int:
    """A power of two, at least four times the session's shuffle width where the cap allows.

    Several buckets per task even out how the groups hash to tasks.
    """
    width = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(MAX_BUCKETS, 1 << max(3, (width - 1).bit_length()))


def _fractions(n: int) -> list[float]:
    return [i / n for i in range(1, n)]


def _sketch(column: Column, n: int) -> Column:
    return F.percentile_approx(column, _fractions(n), 8 * n)


def _for_cuts(df: DataFrame, n: int) -> DataFrame:
    """Rows from which cut points are read: all of a small table, some 400 per bucket of a large one.

    Cut points only balance the work, as in range partitioning; every row is
    processed.  Without this the sketches of all tasks would meet in one task.
    """
    size = df.agg(F.count(F.lit(1))).scalar()
    return df.filter(_share(df.columns, 400.0 * n, size))


def clean(name: str) -> Column:
    """The column as double, with NaN turned into NULL."""
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c), c)


def bounds_of(df: DataFrame, order: Column, n: int) -> Column:
    """Scalar subquery: n-1 ascending cut points of ``order``, staged, as the order of a sketch's merges may differ."""
    return stage(_for_cuts(df, n).agg(_sketch(order.cast("double"), n).alias("cuts")), "bounds").scalar()


def feature_cuts(counts: DataFrame) -> DataFrame:
    """Cut points of every feature's distinct-value rows: (feature, cuts), staged.

    The rows are what the windows will sort, so the cuts balance exactly them.
    One row per column of the table, so the size is known before the query runs.
    A feature too rare for a cut stays in one bucket, which is small.
    """
    n = bucket_count(counts.sparkSession)
    rows = _for_cuts(counts, 8 * n)
    return stage(rows.groupBy("feature").agg(_sketch(F.col("value"), n).alias("cuts")), "cuts")


def cuts_of_row(cuts: DataFrame) -> Column:
    """The cut points of the row's feature."""
    table = cuts.agg(F.map_from_entries(F.collect_list(F.struct("feature", "cuts")))).scalar()
    return F.element_at(table, F.col("feature"))


def add_feature_bucket(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Bucket (feature, value) rows by the cut points of their feature."""
    return add_bucket(rows, F.col("value"), cuts_of_row(cuts), bucket_count(rows.sparkSession))


def _cases(value: Column, bounds: Callable[[int], Column], low: int, high: int) -> Column:
    """The first place from low to high whose bound is above the value, by nested CASEs, which compile."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(value >= bounds(middle), _cases(value, bounds, middle + 1, high)).otherwise(_cases(value, bounds, low, middle))


def _add_search(df: DataFrame, value: str, n: int) -> DataFrame:
    """Add the number of cut points in ``_bounds`` <= value as the bucket, by search in blocks, blocks of these, and so on.

    Every step is a small expression of its own, as the JVM compiles no large methods.
    """
    df = df.withColumn(BUCKET, F.lit(0))
    while n > 1:
        width = max(1, n // NESTED)
        block = _cases(F.col(value), lambda i, w=width: F.get("_bounds", F.col(BUCKET) + ((i + 1) * w - 1)), 0, n // width - 1)
        df = df.withColumn("_block", block).withColumn(BUCKET, F.col(BUCKET) + F.col("_block") * width).drop("_block")
        n = width
    return df


def add_bucket(df: DataFrame, value: Column, bounds: Column, n: int) -> DataFrame:
    """Add the bucket of ``value``; equal values always share a bucket."""
    df = df.withColumns({"_bounds": bounds, "_value": value.cast("double")})
    return _add_search(df, "_value", n).drop("_bounds", "_value")


def _places(df: DataFrame, order: Sequence[str], n: int) -> tuple[DataFrame, list[str]]:
    """Distinct places chosen by hash, PER_BUCKET a bucket, staged; and the leading order columns that tell them apart.

    Leading columns are enough if no value of theirs holds more places than half a bucket: rows that share it then
    share a bucket.  Most orders begin with a column that is enough by itself.
    """
    size = df.agg(F.count(F.lit(1))).scalar()
    held = stage(df.select(*order).filter(_share(order, PER_BUCKET * n, size)).distinct(), "places")
    for k in range(1, len(order)):
        most = held.groupBy(*order[:k]).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= PER_BUCKET // 2:
            return held, list(order[:k])
    return held, list(order)


def add_order_bucket(df: DataFrame, order: Sequence[str], *, n: int | None = None) -> DataFrame:
    """Bucket rows by their order columns together, each in its own type and order.

    A struct compares column by column as a window's ORDER BY does, nulls first,
    so buckets follow the sort whatever the types, and a heavy instant is split
    by the columns after it.  Only as many leading columns are compared as that
    needs.  The cut points are taken from distinct places chosen by hash: a
    key's rows stand at distinct places.
    """
    n = n or bucket_count(df.sparkSession)
    held, leading = _places(df, list(order), n)
    sorted_places = held.agg(F.sort_array(F.collect_list(F.struct(*leading))).alias("a"))
    at = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get("a", F.floor(i * F.size("a") / n).cast("int")))
    df = df.withColumns({"_bounds": sorted_places.select(at).scalar(), "_place": F.struct(*leading)})
    return _add_search(df, "_place", n).drop("_bounds", "_place")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    columns: Sequence[str],
    *,
    by_row: bool = False,
    totals: bool = False,
) -> DataFrame:
    """Add ``<c>_cum`` (and ``<c>_all``) for bucketed rows.

    By default rows with equal order values share the sum up to and including
    them; ``by_row`` needs a total order and counts row by row.
    """
    df = keyed(df, keys)
    group = [KEY, BUCKET]
    per_bucket = df.groupBy(*group).agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    whole = Window.partitionBy(KEY)
    before = whole.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    carried = [F.coalesce(F.sum(f"_t_{c}").over(before), zero).alias(f"_o_{c}") for c in columns]
    if totals:
        carried += [F.sum(f"_t_{c}").over(whole).alias(f"{c}_all") for c in columns]
    # a fixed number of parts, which are not put together again: a task sorts no more as the table grows with the width
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = df.repartition(width, *group).join(per_bucket.select(*group, *carried), group)
    w = Window.partitionBy(*group).orderBy(*order)
    if by_row:
        w = w.rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.withColumns(
        {f"{c}_cum": F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(w), zero) for c in columns}
    )
    return joined.drop(KEY, *[f"_o_{c}" for c in columns])


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    *,
    out: str = "row_number",
    totals: str | None = None,
) -> DataFrame:
    """1-based position of each bucketed row within its key; ``order`` must be total."""
    df = keyed(df, keys)
    group = [KEY, BUCKET]
    per_bucket = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_t"))
    whole = Window.partitionBy(KEY)
    before = whole.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o")]
    if totals:
        carried.append(F.sum("_t").over(whole).alias(totals))
    w = Window.partitionBy(*group).orderBy(*order)
    return (
        df.join(per_bucket.select(*group, *carried), group)
        .withColumn(out, F.col("_o") + F.row_number().over(w))
        .drop("_o", KEY, BUCKET)
    )


def rank_values(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, out: str = "row_number", totals: str | None = None
) -> DataFrame:
    """``add_order_bucket`` followed by ``row_numbers``."""
    return row_numbers(add_order_bucket(df, order), keys, order, out=out, totals=totals)


def chunked(df: DataFrame, position: str, size: int, halo: int) -> DataFrame:
    """Split numbered rows into fixed chunks, each preceded by ``halo`` copied rows.

    Adds ``_chunk`` and ``_own``; a window over (key, _chunk) then sees enough
    earlier rows, and only ``_own`` rows are to be kept.
    """
    if halo > size:
        raise ValueError("a chunk must be at least as long as its halo")
    offset = (F.col(position) - 1) % size
    chunk = F.floor((F.col(position) - 1) / size)
    copies = F.when(
        offset >= size - halo,
        F.array(F.struct(chunk.alias("c"), F.lit(True).alias("own")),
                F.struct((chunk + 1).alias("c"), F.lit(False).alias("own"))),
    ).otherwise(F.array(F.struct(chunk.alias("c"), F.lit(True).alias("own"))))
    return (
        df.withColumn("_copy", F.explode(copies))
        .withColumn("_chunk", F.col("_copy.c"))
        .withColumn("_own", F.col("_copy.own"))
        .drop("_copy")
    )


def value_counts(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Distinct values with their counts ``n``, staged.

    Ordered operators read the counts several times; staging them keeps the
    table itself to a single scan.
    """
    return stage(long.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")), "counts")


def order_statistics(
    counts: DataFrame, keys: Sequence[str], ranks: dict[str, Callable[[Column], Column]], value: str = "value"
) -> DataFrame:
    """Values at 0-based sorted positions of bucketed (key, value, n) rows.

    Each rank is a function of the group's row count.  Returns keys,
    ``n_values`` and one column per rank.
    """
    ranked = running_sums(counts, keys, [value], ["n"], totals=True)
    below, size = F.col("n_cum") - F.col("n"), F.col("n_all")
    picks = [
        F.max(F.when((below <= rank(size)) & (rank(size) < F.col("n_cum")), F.col(value))).alias(name)
        for name, rank in ranks.items()
    ]
    return ranked.groupBy(*keys).agg(F.max("n_all").alias("n_values"), *picks)


def quantiles_of_counts(
    counts: DataFrame, keys: Sequence[str], probs: dict[str, float], value: str = "value"
) -> DataFrame:
    """Exact linear-interpolation quantiles from bucketed (key, value, n) rows."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    final = []
    for name, p in probs.items():
        ranks[f"_lo_{name}"] = lambda n, p=p: F.floor((n - 1) * F.lit(p))
        ranks[f"_hi_{name}"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p))
        exact = (F.col("n_values") - 1) * F.lit(p)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        final.append((lo + (hi - lo) * (exact - F.floor(exact))).alias(name))
    return order_statistics(counts, keys, ranks, value).select(*keys, "n_values", *final)


def bucketed_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts of the distinct values of one column per key, with their bucket."""
    rows = df.select(*keys, clean(value).alias("value")).filter(F.col("value").isNotNull())
    counts = value_counts(rows, keys)
    n = bucket_count(df.sparkSession)
    return add_bucket(counts, F.col("value"), bounds_of(counts, F.col("value"), n), n)


def exact_quantiles(
    df: DataFrame, features: Sequence[str], keys: Sequence[str], probs: dict[str, float]
) -> DataFrame:
    """Quantiles of several numeric columns at once, one row per (keys, feature)."""
    counts = value_counts(melt(df, features, keys), [*keys, "feature"])
    return quantiles_of_counts(add_feature_bucket(counts, feature_cuts(counts)), [*keys, "feature"], probs)


def melt(df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Long form (keys, feature, value) without NULL and NaN."""
    wide = df.select(*keys, *[clean(f).alias(f) for f in features])
    return wide.unpivot(list(keys), list(features), "feature", "value").filter(F.col("value").isNotNull())


def _atoms(column: pa.Array) -> list[pa.Array] | None:
    """The columns that tell the values of a key apart, those inside a struct included; None for lists and maps."""
    if not pa.types.is_struct(column.type):
        return None if pa.types.is_nested(column.type) else [column]
    inner = [_atoms(c) for c in column.flatten()]
    return None if None in inner else [column.is_valid(), *[c for part in inner for c in part]]


def _counted(wide: pa.Table, keys: Sequence[str], feature: str) -> pa.Table:
    """Distinct values of one column per key with their counts; uncounted where a key cannot be grouped."""
    t = wide.filter(wide[feature].is_valid())
    parts = [_atoms(t[k].combine_chunks()) for k in keys]
    if None not in parts:
        columns = [c for part in parts for c in part] + [t[feature]]
        names = [f"c{i}" for i in range(len(columns))]
        rows = pa.table([*columns, pa.array(np.arange(t.num_rows))], [*names, "row"])
        found = pa.TableGroupBy(rows, names, use_threads=False).aggregate([("row", "min"), ("row", "count")])
        t, n = t.take(found["row_min"]), found["row_count"].cast(pa.int64())
    else:
        n = pa.array(np.ones(t.num_rows, dtype=np.int64))
    return pa.table([*[t[k] for k in keys], pa.repeat(feature, t.num_rows), t[feature], n], [*keys, "feature", "value", "n"])


def melted_counts(
    df: DataFrame, features: Sequence[str], keys: Sequence[str], sums: dict[str, Column] | None = None, apart: Sequence[str] = ()
) -> DataFrame:
    """``value_counts`` of the long form of several columns, in tasks of bounded memory, staged.

    ``sums`` over the counts n may tell rows ``apart`` by further columns.

    A scanning task counts at most HELD rows at a time, so columns of few values are collapsed where they are read.
    What is left is counted behind the shuffle, in PLAIN parts at most.
    """
    group, keys, features = list(keys), [*keys, *apart], list(features)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            wide = pa.Table.from_batches(held)
            for f in features:
                yield from _counted(wide, keys, f).combine_chunks().to_batches(max_chunksize=1 << 16)

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= HELD:
                yield from counted()
                held, size = [], 0
        if held:
            yield from counted()

    wide = df.select(*keys, *[(clean(f) + 0.0).alias(f) for f in features])  # -0.0 and 0.0 are one value
    shape = wide.select(*keys).schema.add("feature", "string").add("value", "double").add("n", "long")
    n = min(PLAIN, bucket_count(df.sparkSession))
    rows = wide.mapInArrow(collapse, shape).withColumn("_place", F.xxhash64("feature", "value")).repartition(n, "_place")
    sums = sums or {"n": F.col("n")}
    counts = rows.groupBy("_place", *group, "feature", "value").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    return stage(counts.drop("_place"), "counts")
