"""Reproducible train / validation / test splits and dataset unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.operators.ordered import BUCKET, bucket_count, bucketed_counts, order_statistics, rank_values, row_numbers
from driftloom.sources.stage import stage


def stratified_split(df: DataFrame, *, key: Sequence[str], strata: str, test_share: float = 0.20, seed: int = 42) -> DataFrame:
    """Mark ``split``: the exact test share of every class, chosen by the hash of the key."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    n = bucket_count(df.sparkSession)
    head = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    rows = df.withColumn("_hash", digest).withColumn(BUCKET, F.floor(head / float(2**32) * n).cast("int"))
    rows = row_numbers(rows, [strata], ["_hash", *key], out="_rank", totals="_size")
    test = F.col("_rank") <= F.floor(F.col("_size") * F.lit(test_share))
    return rows.withColumn("split", F.when(test, "test").otherwise("train")).drop("_hash", "_rank", "_size")


def split_by_cycle(df: DataFrame, cycle: str, *, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Mark ``split`` by ordered distinct cycles, so that no cycle is in two parts.

    Only the two cycles where a part begins are needed; they reach the rows as
    a scalar, not through a join.
    """
    distinct = bucketed_counts(df.select(cycle).distinct(), [], cycle)
    cut = order_statistics(
        distinct,
        [],
        {
            "val_from": lambda n: F.floor(n * F.lit(train)),
            "test_from": lambda n: F.floor(n * F.lit(train)) + F.floor(n * F.lit(val)),
        },
    )
    cut = cut.select(F.struct("val_from", "test_from")).scalar()
    c = F.col(cycle)
    part = F.when(c < F.col("_cut.val_from"), "train").when(c < F.col("_cut.test_from"), "val").otherwise("test")
    return df.withColumn("_cut", cut).withColumn("split", part).drop("_cut")


def split_by_position(
    df: DataFrame, *, order: Sequence[str], shares: dict[str, float], rest: str
) -> DataFrame:
    """Mark ``split`` by row order: each part takes int(n * share) rows, ``rest`` the others.

    Parts with a positive share are cut from the start in the given order.
    """
    rows = rank_values(df, [], list(order), out="_rank", totals="_size")
    label, start = F.lit(rest), F.lit(0)
    spans = []
    for name, share in shares.items():
        stop = start + F.floor(F.col("_size") * F.lit(share))
        spans.append((name, start, stop))
        start = stop
    for name, lo, hi in spans:
        label = F.when((F.col("_rank") > lo) & (F.col("_rank") <= hi), name).otherwise(label)
    return rows.withColumn("split", label).drop("_rank", "_size")


def hold_out_last(df: DataFrame, *, order: Sequence[str], share: float = 0.15) -> DataFrame:
    """Mark ``split``: the last int(n * share) rows are validation, the others train."""
    rows = rank_values(df, [], list(order), out="_rank", totals="_size")
    late = F.col("_rank") > F.col("_size") - F.floor(F.col("_size") * F.lit(share))
    return rows.withColumn("split", F.when(late, "val").otherwise("train")).drop("_rank", "_size")


def split_by_value(df: DataFrame, column: str, *, test: Sequence, train: Sequence | None = None) -> DataFrame:
    """Mark ``split`` by membership; with ``train`` given, values in neither part are left out."""
    c = F.col(column)
    part = F.when(c.isin(list(test)), "test")
    part = part.when(c.isin(list(train)), "train") if train is not None else part.otherwise("train")
    return df.withColumn("split", part).filter(F.col("split").isNotNull())


def members_of(df: DataFrame, assignment: DataFrame, key: str, part: str) -> DataFrame:
    """Rows whose key the (key, split) table assigns to ``part``.

    The table has one row per key; staged, its true size decides on a broadcast.
    """
    members = stage(assignment.filter(F.col("split") == part).select(key), "members")
    return df.join(members, key, "left_semi")


def union_all(*tables: DataFrame) -> DataFrame:
    """UNION ALL by name; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def recent_batches(df: DataFrame, *, at: str = "batch_id", trigger: Column | int, keep: int = 8) -> DataFrame:
    """Rows of the last ``keep`` batches up to the trigger, the reference counting as the first.

    Batches are ranked through their distinct ids, never by sorting rows.
    """
    trigger = trigger if isinstance(trigger, Column) else F.lit(trigger)
    ids = df.filter(F.col(at) <= trigger).groupBy(at).agg(F.lit(1).alias("_one"))
    # row_number <= keep lets Spark keep only the leading rows per partition
    newest = ids.withColumn("_r", F.row_number().over(Window.partitionBy("_one").orderBy(F.desc(at))))
    first = newest.filter(F.col("_r") <= keep).agg(F.min(at)).scalar()
    return df.filter((F.col(at) >= first) & (F.col(at) <= trigger))


def augment(
    df: DataFrame, *, numeric: Sequence[str], keep: Sequence[str], n: int, key: Sequence[str], noise: float = 0.02, seed: int = 42
) -> DataFrame:
    """Append ``n`` noisy copies of rows chosen by hash; keys and labels stay as they are.

    When n exceeds the table, every row is copied equally often and a hash-chosen
    remainder once more.
    """
    stds = df.agg(F.struct(*[F.stddev_samp(c).alias(c) for c in numeric])).scalar()
    size = df.agg(F.count(F.lit(1))).scalar()
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    n_buckets = bucket_count(df.sparkSession)
    head = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    ranked = df.withColumn("_hash", digest).withColumn(BUCKET, F.floor(head / float(2**32) * n_buckets).cast("int"))
    ranked = row_numbers(ranked, [], ["_hash", *key], out="_rank").withColumn("_size", size)
    copies = F.floor(F.lit(n) / F.col("_size")) + F.when(F.col("_rank") <= F.lit(n) % F.col("_size"), 1).otherwise(0)
    chosen = ranked.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies.cast("int")))).filter(F.col("_copy") > 0)
    chosen = chosen.withColumn("_std", stds)

    def noisy(i: int, c: str) -> Column:
        # Box-Muller on the row's own hash: the same row gets the same noise in a rerun
        h = F.xxhash64("_hash", F.col("_copy"), F.lit(i))
        u1 = (F.pmod(h, F.lit(2**31 - 1)) + 1) / float(2**31)
        u2 = F.pmod(F.xxhash64("_hash", F.col("_copy"), F.lit(-i - 1)), F.lit(2**31 - 1)) / float(2**31)
        return F.col(c) + F.sqrt(-2 * F.ln(u1)) * F.cos(u2 * (2 * 3.141592653589793)) * F.col(f"_std.{c}") * noise

    moved = {c: noisy(i, c) for i, c in enumerate(numeric) if c not in keep}
    extra = chosen.withColumns(moved).select(*df.columns, F.lit(True).alias("is_augmented"))
    return df.withColumn("is_augmented", F.lit(False)).unionByName(extra)
