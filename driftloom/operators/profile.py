"""Profiles and summaries of tables, batches, alerts and fleets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions import thresholds as T
from driftloom.functions.statistics import ratio
from driftloom.operators.drift import melt_text, top_category
from driftloom.operators.ordered import (
    add_feature_bucket,
    bucketed_counts,
    clean,
    exact_quantiles,
    feature_cuts,
    melt,
    order_statistics,
    quantiles_of_counts,
    value_counts,
)

QUARTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75}


def _moments(rows: DataFrame, features: Sequence[str], group: Sequence[str]) -> DataFrame:
    return (
        rows.groupBy(*group)
        .agg(
            *[
                F.struct(
                    F.count(clean(f)).alias("n"),
                    F.avg(clean(f)).alias("mean"),
                    F.stddev_samp(clean(f)).alias("std"),
                    F.min(clean(f)).alias("min"),
                    F.max(clean(f)).alias("max"),
                ).alias(f)
                for f in features
            ]
        )
        .unpivot(list(group), list(features), "feature", "_m")
        .select(*group, "feature", "_m.*")
    )


def feature_stats(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample std, min, max and exact quartiles per (keys, feature)."""
    group = list(keys) or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(1))
    quartiles = exact_quantiles(rows, features, group, QUARTILES).drop("n_values")
    out = _moments(rows, features, group).join(quartiles, [*group, "feature"], "left")
    return out if keys else out.drop("_all")


def category_frequencies(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Share of each category among the non-null values of its feature."""
    counts = melt_text(df, features, keys).groupBy(*keys, "feature", "category").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(*keys, "feature").agg(F.sum("n").alias("_size"))
    return counts.join(sizes, [*keys, "feature"]).select(
        *keys, "feature", "category", "n", ratio(F.col("n"), F.col("_size")).alias("share")
    )


def score_summary(df: DataFrame, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean score and percentage of high-risk scores."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(score).alias("mean_score"),
        (F.avg((F.col(score) >= T.RISK_HIGH).cast("double")) * 100).alias("high_risk_pct"),
    )


def _numeric_profile(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    counts = value_counts(melt(df, numeric, []), ["feature"])
    distinct = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("unique_count"))
    quartiles = quantiles_of_counts(add_feature_bucket(counts, feature_cuts(counts)), ["feature"], QUARTILES).drop("n_values")
    moments = _moments(df.withColumn("_all", F.lit(1)), numeric, ["_all"]).drop("n", "_all")
    return moments.join(distinct, "feature", "left").join(quartiles, "feature", "left")


def _text_profile(df: DataFrame, text: Sequence[str], top: int) -> DataFrame:
    words = melt_text(df, text, []).groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("feature").orderBy(F.desc("n"), "category")
    leading = words.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= top)
    ordered = F.array_sort(F.collect_list(F.struct("_r", "category")))
    tops = leading.groupBy("feature").agg(F.transform(ordered, lambda s: s["category"]).alias("top_values"))
    return words.groupBy("feature").agg(F.count(F.lit(1)).alias("unique_count")).join(tops, "feature")


def column_profile(df: DataFrame, numeric: Sequence[str], text: Sequence[str], top: int = 5) -> DataFrame:
    """One row per column: type, moments, quartiles, nulls, distinct values, top values of text."""
    types = dict(df.dtypes)
    columns = [*numeric, *text]
    missing = {c: (clean(c) if c in numeric else F.col(c)).isNull() for c in columns}
    nulls = df.agg(*[F.count_if(m).alias(c) for c, m in missing.items()]).unpivot([], columns, "column_name", "null_count")
    parts = []
    if numeric:
        parts.append(_numeric_profile(df, numeric))
    if text:
        parts.append(_text_profile(df, text, top))
    detail = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumnRenamed("feature", "column_name")
    kinds = F.create_map(*[F.lit(x) for c in columns for x in (c, types[c])])
    return (
        nulls.join(detail, "column_name", "left")
        .withColumn("dtype", kinds[F.col("column_name")])
        .withColumn("unique_count", F.coalesce("unique_count", F.lit(0).cast("long")))
    )


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of missing values per column."""
    missing = {c: (clean(c) if t in ("double", "float") else F.col(c)).isNull() for c, t in df.dtypes if c in columns}
    return df.agg(*[F.avg(m.cast("double")).alias(c) for c, m in missing.items()]).unpivot(
        [], list(missing), "column_name", "null_rate"
    )


def class_balance(df: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Relative frequency of each target value, nulls excluded."""
    return category_frequencies(df, [target], keys).select(
        *keys, F.col("category").alias(target), F.col("n"), "share"
    )


def dataset_summary(df: DataFrame, *, temperature: str, protocol: str, soc: str, source: str) -> DataFrame:
    """Rows, SoC range and distinct files per temperature and per protocol, in one pass."""
    return (
        df.groupingSets([[F.col(temperature)], [F.col(protocol)]], temperature, protocol)
        .agg(
            F.grouping(temperature).alias("_by_protocol"),
            F.count(F.lit(1)).alias("n_rows"),
            F.min(soc).alias("soc_min"),
            F.max(soc).alias("soc_max"),
            F.countDistinct(source).alias("n_files"),
        )
        .withColumn("level", F.when(F.col("_by_protocol") == 1, protocol).otherwise(temperature))
        .drop("_by_protocol")
    )


def grouped_rate(df: DataFrame, by: str, target: str) -> DataFrame:
    """Mean of the target per group, highest first."""
    return df.groupBy(by).agg(F.avg(target).alias("rate"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("rate"), by)


def top_categories(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent category (first alphabetically on a tie) and number of categories."""
    counts = melt_text(df, features, keys).groupBy(*keys, "feature", "category").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys, "feature").agg(
        top_category("n").alias("top_category"), F.count(F.lit(1)).alias("n_categories")
    )


def drift_heatmap(details: DataFrame, batches: Sequence, batch: str = "batch_id") -> DataFrame:
    """Features x batches with the mean score, 0 where there is none."""
    return details.groupBy("feature").pivot(batch, list(batches)).agg(F.avg("score")).na.fill(0.0)


def count_by_value(df: DataFrame, column: str, values: Sequence[str], keys: Sequence[str] = (), total: str = "total") -> DataFrame:
    """Total and one conditional count per listed value (alert severities, fleet states)."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(total),
        *[F.count_if(F.col(column) == v).alias(f"n_{v.lower()}") for v in values],
    )


def impact_totals(df: DataFrame, keys: Sequence[str], batch: str = "batch_id") -> DataFrame:
    """Total and worst loss, the earliest worst batch, missed cases and the last annual figure."""
    loss = F.col("total_monthly_loss")
    return df.groupBy(*keys).agg(
        F.sum(loss).alias("total_loss"),
        F.max(loss).alias("worst_loss"),
        F.min_by(batch, F.struct(-loss, F.col(batch))).alias("worst_batch"),
        F.sum("missed_churners").alias("total_missed"),
        F.max_by("total_annual_loss", batch).alias("projected_annual_loss"),
    )


def run_summary(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Number of batches, metric ranges and number of drifted batches."""
    ranges = [x for m in metrics for x in (F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"))]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_batches"), *ranges, F.count_if(F.col("drift_severity") != "none").alias("n_drifted")
    )


def base_rates(df: DataFrame, keys: Sequence[str], soh: str = "soh", fault: str = "fault_label") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(soh).alias("soh_mean"), F.avg(fault).alias("fault_rate"))


def score_shift(df: DataFrame, score: str, *, batch: str = "batch_id", reference: str = "is_reference") -> DataFrame:
    """Mean and std of the scores per batch beside the reference, and the mean difference."""
    per = df.groupBy(batch, reference).agg(
        F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"), F.sum(score).alias("_s"),
        F.count(score).alias("_n"),
    )
    ref = (
        df.filter(F.col(reference)).agg(F.struct(F.avg(score).alias("m"), F.stddev_pop(score).alias("s"))).scalar()
    )
    return (
        per.filter(~F.col(reference))
        .withColumn("_ref", ref)
        .select(
            batch, "mean_score", "std_score", F.col("_ref.m").alias("ref_mean"), F.col("_ref.s").alias("ref_std"),
            (F.col("mean_score") - F.col("_ref.m")).alias("mean_shift"),
        )
    )


def latency_summary(df: DataFrame, latency: str, ts: str, keys: Sequence[str]) -> DataFrame:
    """Latency report per key: median, p95 / p99 as the sorted element at int(n*p), rates."""
    counts = bucketed_counts(df, keys, latency)
    at = order_statistics(
        counts,
        keys,
        {
            "p95": lambda n: F.floor(n * F.lit(0.95)),
            "p99": lambda n: F.floor(n * F.lit(0.99)),
            "upper_median": lambda n: F.floor(n / F.lit(2)),
            "_lo": lambda n: F.floor((n - 1) / F.lit(2)),
        },
    )
    seconds = (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / 1e6
    wide = df.groupBy(*keys).agg(
        F.avg(latency).alias("mean"), F.min(latency).alias("min"), F.max(latency).alias("max"),
        F.count(latency).alias("n_requests"), ratio(F.count(latency), seconds).alias("requests_per_sec"),
    )
    return (
        wide.join(at.drop("n_values"), list(keys))
        .withColumn("median", (F.col("_lo") + F.col("upper_median")) / 2)
        .withColumn("throughput_per_sec", 1000 / F.greatest("upper_median", F.lit(0.001)))
        .drop("_lo")
    )


