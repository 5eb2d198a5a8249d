"""Queries over the model registry and the dataset catalogue.

All tables are append-only; a row's current state is the newest of its events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions import thresholds as T
from driftloom.operators.ordered import BUCKET, bucket_count, row_numbers


def latest_batch(metrics: DataFrame, key: str = "model_id") -> DataFrame:
    """The newest batch row of every model (highest id on a tie), by aggregation."""
    newest = F.max_by(F.struct(*[c for c in metrics.columns if c != key]), F.struct("batch_id", "id"))
    return metrics.groupBy(key).agg(newest.alias("_b")).select(key, "_b.*")


def fleet_health(models: DataFrame, metrics: DataFrame, retrains: DataFrame) -> DataFrame:
    """One row per registered model with its latest batch and its counts.

    Models without batches stay, with NULL ``n_batches`` and 0 ``n_retrains``.
    """
    newest = F.max_by(
        F.struct("auc_roc", "f1_score", "drift_severity", "batch_id", "recorded_at", "roi_monthly_loss", "roi_missed_churners"),
        F.struct("batch_id", "id"),
    )
    per_model = metrics.groupBy("model_id").agg(newest.alias("b"), F.count(F.lit(1)).alias("n_batches"))
    retrained = retrains.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_retrains"))
    return (
        models.join(per_model, "model_id", "left")
        .join(retrained, "model_id", "left")
        .select(
            "model_id", "name", "version", "status", "description",
            F.col("b.auc_roc").alias("latest_auc"),
            F.col("b.f1_score").alias("latest_f1"),
            F.col("b.drift_severity").alias("drift_severity"),
            F.col("b.batch_id").alias("last_batch_id"),
            F.col("b.recorded_at").alias("last_updated"),
            F.col("b.roi_monthly_loss").alias("roi_monthly_loss"),
            F.col("b.roi_missed_churners").alias("roi_missed_churners"),
            "n_batches",
            F.coalesce("n_retrains", F.lit(0).cast("long")).alias("n_retrains"),
        )
        .orderBy("model_id")
    )


def last_rows(df: DataFrame, n: int, *, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last ``n`` rows of every key; the limit also runs before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n).drop("_r")


def model_history(metrics: DataFrame, last_n: int | None = None, model_id: int | None = None) -> DataFrame:
    """Batch rows in ascending order, optionally the last N of each model or one model."""
    rows = metrics if model_id is None else metrics.filter(F.col("model_id") == model_id)
    if last_n:
        rows = last_rows(rows, last_n, keys=["model_id"], order=["batch_id", "id"])
    return rows.orderBy("model_id", "batch_id", "id")


def drift_history(details: DataFrame, model_id: int | None = None, batch_id: int | None = None) -> DataFrame:
    rows = details
    if model_id is not None:
        rows = rows.filter(F.col("model_id") == model_id)
    if batch_id is not None:
        rows = rows.filter(F.col("batch_id") == batch_id)
    return rows.orderBy("batch_id", "feature")


def latest_drift(details: DataFrame, keys: Sequence[str] = (), batch: str = "batch_id") -> DataFrame:
    """Drift rows of the newest batch per key, lowest score first."""
    if keys:
        newest = details.groupBy(*keys).agg(F.max(batch).alias(batch))
        rows = details.join(newest, [*keys, batch], "left_semi")
    else:
        rows = details.filter(F.col(batch) == details.agg(F.max(batch)).scalar())
    return rows.orderBy(*keys, "score", "feature")


def retrain_history(log: DataFrame, model_id: int | None = None) -> DataFrame:
    rows = log if model_id is None else log.filter(F.col("model_id") == model_id)
    return rows.orderBy("triggered_at", "model_id")


def thresholds_map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])


def merged_thresholds(custom: Column) -> Column:
    """Defaults overridden key by key."""
    defaults = thresholds_map(T.DEFAULT_MODEL_THRESHOLDS)
    empty = F.create_map().cast("map<string,double>")
    custom = F.coalesce(custom, empty)
    kept = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(custom, k))
    return F.map_concat(kept, custom)


def model_status(auc: Column, severity: Column, thresholds: Column) -> Column:
    """critical / warning / healthy from AUC and drift; a NULL AUC judges by drift alone."""
    low = F.coalesce(F.element_at(thresholds, "auc_critical"), F.lit(T.AUC_CRITICAL))
    mid = F.coalesce(F.element_at(thresholds, "auc_warning"), F.lit(T.AUC_WARNING))
    return (
        F.when((auc < low) | (severity == "critical"), "critical")
        .when((auc < mid) | (severity == "warning"), "warning")
        .otherwise("healthy")
    )


def regression_status(mae: Column, severity: Column, thresholds: Column) -> Column:
    """The same for regression models, judged by MAE."""
    defaults = T.TASK_THRESHOLDS["regression"]
    high = F.coalesce(F.element_at(thresholds, "mae_critical"), F.lit(defaults["mae_critical"]))
    mid = F.coalesce(F.element_at(thresholds, "mae_warning"), F.lit(defaults["mae_warning"]))
    return (
        F.when((mae > high) | (severity == "critical"), "critical")
        .when((mae > mid) | (severity == "warning"), "warning")
        .otherwise("healthy")
    )


def with_new_ids(rows: DataFrame, existing: DataFrame, *, id_column: str, key: Sequence[str]) -> DataFrame:
    """Ids after the highest existing one, in the order of the key's hash.

    Hash order spreads the numbering evenly over buckets.
    """
    top = F.coalesce(existing.agg(F.max(id_column)).scalar(), F.lit(0))
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    n = bucket_count(rows.sparkSession)
    head = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("double")
    rows = rows.withColumn("_hash", digest).withColumn(BUCKET, F.floor(head / float(2**32) * n).cast("int"))
    rows = row_numbers(rows, [], ["_hash", *key], out="_r")
    return rows.withColumn(id_column, (top + F.col("_r")).cast("long")).drop("_r", "_hash")


def new_registrations(existing: DataFrame, incoming: DataFrame, *, id_column: str = "model_id", key: Sequence[str] = ("name", "version")) -> DataFrame:
    """Incoming rows whose key is not registered yet, with new ids."""
    key = list(key)
    fresh = incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti")
    return with_new_ids(fresh, existing, id_column=id_column, key=key)


def current_state(events: DataFrame, *, keys: Sequence[str], at: str, tie: str, state: str = "status", gone: str = "deleted") -> DataFrame:
    """Newest state of every key; keys whose newest state is a deletion are left out."""
    newest = F.max_by(F.struct(*[c for c in events.columns if c not in keys]), F.struct(at, tie))
    rows = events.groupBy(*keys).agg(newest.alias("_e")).select(*keys, "_e.*")
    return rows.filter(F.col(state) != gone)


def latest_version(catalogue: DataFrame, value: str = "file_path") -> DataFrame:
    """The most recently registered version of every dataset name."""
    return catalogue.groupBy("name").agg(
        F.max_by(F.struct("version", value), F.struct("registered_at", "dataset_id")).alias("_v")
    ).select("name", "_v.*")


def list_datasets(catalogue: DataFrame, *, domain: str | None = None, status: str | None = "active", tags: dict[str, str] | None = None) -> DataFrame:
    rows = catalogue
    if domain:
        rows = rows.filter(F.col("domain") == domain)
    if status:
        rows = rows.filter(F.col("status") == status)
    for k, v in (tags or {}).items():
        rows = rows.filter(F.element_at("tags", F.lit(k)) == v)
    return rows.orderBy(F.desc("registered_at"), "dataset_id")


def compatible_datasets(catalogue: DataFrame, required: Sequence[str]) -> DataFrame:
    """Datasets that hold all required columns."""
    wanted = F.array(*[F.lit(c) for c in required])
    return catalogue.filter(F.size(F.array_except(wanted, F.col("columns"))) == 0)


def with_column_stats(catalogue: DataFrame, stats: DataFrame) -> DataFrame:
    """Catalogue rows with their column statistics as a nested list; one entry per column."""
    fields = [c for c in stats.columns if c != "dataset_id"]
    nested = stats.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("column_stats"))
    return catalogue.join(nested, "dataset_id", "left")


def parse_tags(text: Column) -> Column:
    """``k=v,k=v`` to a map; the pieces are trimmed and pieces without ``=`` are left out."""
    pairs = F.filter(F.split(text, ","), lambda p: p.contains("="))
    entry = F.transform(
        pairs,
        lambda p: F.struct(
            F.trim(F.substring_index(p, "=", 1)).alias("k"),
            F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("v"),
        ),
    )
    return F.map_from_entries(entry)
