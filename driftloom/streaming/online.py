"""Online scoring and monitoring with Structured Streaming.

Work per micro-batch uses the batch operators.  Tables written from
``foreachBatch`` have one folder per epoch and are overwritten when an epoch is
replayed, so a restart gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftloom import schemas
from driftloom.functions import thresholds as T
from driftloom.functions.statistics import ratio
from driftloom.operators import drift as D
from driftloom.operators import impact as B
from driftloom.operators.clean import Rule, validate
from driftloom.operators.ordered import clean, rank_values
from driftloom.operators.quality import estimated_auc
from driftloom.operators.registry import last_rows
from driftloom.sources.stage import new_path, stage


def score_stream(
    requests: DataFrame, rules: Sequence[Rule], score: Callable[[DataFrame], DataFrame], *, column: str = "prediction_score",
    threshold: float = T.DEFAULT_THRESHOLD,
) -> DataFrame:
    """Validate and score records; invalid ones keep their violations and get no score."""
    checked = score(validate(requests, rules))
    valid = F.col("is_valid")
    s = F.when(valid, F.col(column))
    return checked.withColumns(
        {
            column: s,
            "predicted": F.when(valid, (F.col(column) >= threshold).cast("int")),
            "risk": F.when(valid, B.risk_band(F.col(column))),
        }
    )


def start_log(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Append the scored records to a Parquet log."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


# Count-bounded windows ---------------------------------------------------------------


def _matched(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on one key, of which null is a value like any other."""
    return rows.join(table.withColumnRenamed(key, "_of"), F.col(key).eqNullSafe(F.col("_of")), how).drop("_of")


def count_windows(
    numbered: DataFrame, *, position: str, served: str, size: int = T.WINDOW_SIZE, every: int = T.CHECK_EVERY,
    after: Column | None = None, out: str = "window_id",
) -> DataFrame:
    """Rows of every window that ends at a multiple of ``every`` and holds the last ``size`` rows.

    Each row belongs to at most size/every windows, so rows grow by that fixed
    factor.  ``served`` is the key's row count; with ``after`` only windows that
    end behind that count are formed.
    """
    first = F.ceil(F.col(position) / every)
    last = F.floor((F.col(position) + size - 1) / every)
    done = F.floor(F.col(served) / every)
    start = first if after is None else F.greatest(first, F.floor(after / every) + 1)
    stop = F.least(last, done)
    ids = F.when(start <= stop, F.sequence(start, stop))
    return numbered.withColumn(out, F.explode(ids))


@dataclass
class WindowMonitor:
    """Drift checks over the last 1000 records of every model, at every 500th record.

    ``order`` is the event order within a micro-batch; its first column must be
    numeric or a timestamp.  Under ``root``: log (all records with their
    position), tail (the last 1000 per model), served (records so far) and
    drift_log (one row per check).
    """

    spark: SparkSession
    root: str
    reference: DataFrame
    numeric: list[str]
    categorical: list[str]
    order: list[str]
    model: str = "model_id"
    score: str = "prediction_score"
    baseline: float = T.BASELINE_AUC
    size: int = T.WINDOW_SIZE
    every: int = T.CHECK_EVERY
    extra: list[str] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys([self.model, *self.order, *self.numeric, *self.categorical, self.score, *self.extra]))

    def _epoch(self, table: str, epoch: int) -> str:
        return f"{self.root}/{table}/epoch={epoch}"

    def _read(self, table: str, epoch: int, schema) -> DataFrame:
        """State after an epoch; before the first it is empty, later a missing folder raises."""
        if epoch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._epoch(table, epoch))

    def process(self, rows: DataFrame, epoch: int) -> None:
        """One micro-batch; to be passed to ``foreachBatch``."""
        rows = rows.select(*self.columns)
        types = dict(rows.dtypes)
        served_ddl = f"`{self.model}` {types[self.model]}, served bigint"
        before = self._read("served", epoch - 1, served_ddl)

        numbered = rank_values(rows, [self.model], self.order, out="_n")
        numbered = _matched(numbered, before, self.model, "left").select(
            *self.columns, (F.col("_n") + F.coalesce("served", F.lit(0))).cast("bigint").alias("position")
        )
        numbered.write.mode("overwrite").parquet(self._epoch("log", epoch))
        log = self.spark.read.schema(numbered.schema).parquet(self._epoch("log", epoch))

        fresh = log.groupBy(self.model).agg(F.max("position").alias("served"))
        served = _matched(before, fresh.drop("served"), self.model, "left_anti").unionByName(fresh)
        served.write.mode("overwrite").parquet(self._epoch("served", epoch))
        served = self.spark.read.schema(served_ddl).parquet(self._epoch("served", epoch))

        recent = self._read("tail", epoch - 1, numbered.schema).unionByName(log)
        counts = _matched(served, before.withColumnRenamed("served", "_before"), self.model, "left")
        counts = counts.withColumn("_before", F.coalesce("_before", F.lit(0).cast("bigint")))
        windows = count_windows(
            _matched(recent, counts, self.model), position="position", served="served", size=self.size, every=self.every, after=F.col("_before")
        )
        windows = stage(windows.drop("_before", "served"), "windows")
        if not windows.isEmpty():
            self.check(windows).write.mode("overwrite").parquet(self._epoch("drift_log", epoch))

        tail = last_rows(recent, self.size, keys=[self.model], order=["position"])
        tail.write.mode("overwrite").parquet(self._epoch("tail", epoch))

    def check(self, windows: DataFrame) -> DataFrame:
        """Drift, estimated AUC and cost of every window with enough rows."""
        return window_report(
            self.reference, windows, numeric=self.numeric, categorical=self.categorical, model=self.model, score=self.score,
            baseline=self.baseline, every=self.every,
        )

    def drift_log(self, keep: int | None = T.DRIFT_LOG_KEEP) -> DataFrame:
        """The newest entries per model."""
        kind = dict(self.spark.read.parquet(f"{self.root}/log").dtypes)[self.model]
        schema = f"`{self.model}` {kind}, {schemas.DRIFT_LOG}"
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/drift_log/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], schema)  # no window was complete yet
        return rows if keep is None else last_rows(rows, keep, keys=[self.model], order=["window_id"])

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def window_report(
    reference: DataFrame, windows: DataFrame, *, numeric: Sequence[str], categorical: Sequence[str], model: str, score: str,
    baseline: float = T.BASELINE_AUC, every: int = T.CHECK_EVERY,
) -> DataFrame:
    """One drift-log row per (model, window) with at least 100 rows; the reference is shared by all models."""
    sizes = windows.groupBy(model, "window_id").agg(F.count(F.lit(1)).alias("window_size"))
    sizes = sizes.filter(F.col("window_size") >= T.MIN_SAMPLES)
    name = F.concat_ws("#", F.col(model).cast("string"), F.col("window_id").cast("string"))
    columns = [*numeric, *categorical, score]
    rows = (
        windows.select(name.alias("batch_id"), *columns, F.lit(False).alias(D.REF))
        .unionByName(reference.select(F.lit("").alias("batch_id"), *columns, F.lit(True).alias(D.REF)))
    )
    num = D.numeric_drift(rows, numeric, with_stats=False) if numeric else None
    cat = D.categorical_drift(rows, categorical) if categorical else None
    report = D.batch_report(D.drift_details(num, cat))
    psi = D.psi(rows.withColumnRenamed(score, "prediction_score"), ["prediction_score"]).select(
        "batch_id", F.col("psi").alias("prediction_psi")
    )
    out = sizes.withColumn("batch_id", name).join(report, "batch_id").join(psi, "batch_id", "left")
    out = out.withColumn("estimated_auc", estimated_auc(F.coalesce("prediction_psi", F.lit(0.0)), baseline))
    out = B.monthly_loss(out, "estimated_auc", baseline=baseline)
    return out.select(
        model, "window_id", (F.col("window_id") * every).alias("predictions_at_check"), "window_size",
        F.col("overall_severity").alias("drift_severity"), F.col("overall_drift_score").alias("drift_score"),
        "n_drifted_features", "drifted_features", "prediction_psi", "estimated_auc",
        F.col("total_monthly_loss").alias("roi_monthly_loss"), "roi_status", "roi_headline",
    )


# Event-time windows ---------------------------------------------------------------


@dataclass(frozen=True)
class FrozenBins:
    """Inner edges and reference shares of every feature, fixed before the stream starts."""

    edges: dict[str, list[float]]
    shares: dict[str, list[float]]


def freeze(reference: DataFrame, features: Sequence[str], n_bins: int = T.PSI_BINS) -> FrozenBins:
    """Equal-width inner edges over the reference range; the outer bins are open.

    Collects n_bins numbers per feature.
    """
    limits = reference.agg(*[x for f in features for x in (F.min(clean(f)).alias(f"lo_{f}"), F.max(clean(f)).alias(f"hi_{f}"))]).first()
    edges = {
        f: [i * ((limits[f"hi_{f}"] - limits[f"lo_{f}"]) / n_bins) + limits[f"lo_{f}"] for i in range(1, n_bins)] for f in features
    }
    counts = reference.agg(
        *[F.count_if(clean(f).isNotNull() & (open_bin(clean(f), edges[f]) == i)).alias(f"{f}#{i}") for f in features for i in range(n_bins)]
    ).first()
    shares = {}
    for f in features:
        total = sum(counts[f"{f}#{i}"] for i in range(n_bins)) or 1
        shares[f] = [counts[f"{f}#{i}"] / total for i in range(n_bins)]
    return FrozenBins(edges, shares)


def open_bin(x: Column, edges: Sequence[float]) -> Column:
    """Number of edges <= x."""
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(x < edges[i], F.lit(i)).otherwise(out)
    return out


def event_time_psi(
    stream: DataFrame, bins: FrozenBins, *, time: str = "ts", width: str = "1 day", late: str = "1 hour", keys: Sequence[str] = (),
) -> DataFrame:
    """PSI per time window and feature against frozen edges; works on streams and on tables.

    One aggregation per window with a counter per bin, so late rows update
    counters and a hot window is combined before the shuffle.
    """
    features = list(bins.edges)
    n = len(bins.edges[features[0]]) + 1
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    values = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.when(clean(f).isNotNull(), open_bin(clean(f), bins.edges[f])).alias("bin")) for f in features
    ]))
    binned = rows.select(*keys, time, values.alias("_b")).select(*keys, time, "_b.*").filter(F.col("bin").isNotNull())
    counts = binned.groupBy(F.window(time, width), *keys, "feature").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("bin") == i).alias(f"_{i}") for i in range(n)]
    )
    share = F.create_map(*[x for f in features for x in (F.lit(f), F.array(*[F.lit(v) for v in bins.shares[f]]))])
    terms = F.lit(0.0)
    for i in range(n):
        r = F.element_at(share, F.col("feature"))[i] + T.SMOOTHING
        p = ratio(F.col(f"_{i}"), F.col("n")) + T.SMOOTHING
        terms = terms + (p - r) * F.ln(p / r)
    out = counts.select(F.col("window.start").alias("window_start"), *keys, "feature", "n", terms.alias("psi"))
    return out.withColumn("severity", D.psi_severity(F.col("psi")))


# Ordered state ------------------------------------------------------------------------


def trigger_stream(metrics: DataFrame, *, model: str = "model_id") -> DataFrame:
    """Retraining trigger as a stream of batch metrics, one state per model.

    The state is the cooldown left and the last three AUCs.  Input is one row
    per model and batch (model_id bigint, batch_id bigint, auc_roc double,
    drift_severity string), arriving in batch order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, past = state.get if state.exists else (0, [])
        past = list(past)
        rows = pd.concat(list(frames)).sort_values("batch_id")
        fired = []
        for auc, severity in zip(rows["auc_roc"], rows["drift_severity"], strict=True):
            known = auc is not None and auc == auc
            low = known and auc < T.AUC_WARNING
            fall = len(past) == T.TREND_LAG and past[0] == past[0] and low and past[0] - auc > T.TREND_DROP
            raised = known and (auc < T.AUC_CRITICAL or (low and severity in ("warning", "critical")) or fall)
            fires = left == 0 and bool(raised)
            left = left - 1 if left > 0 else T.TRIGGER_COOLDOWN if fires else 0
            past = [*past, float(auc) if known else float("nan")][-T.TREND_LAG :]
            fired.append(fires)
        state.update((left, past))
        yield pd.DataFrame({model: key[0], "batch_id": rows["batch_id"], "retrain_triggered": fired})

    return metrics.groupBy(model).applyInPandasWithState(
        step, f"{model} bigint, batch_id bigint, retrain_triggered boolean", "left int, past array<double>", "append",
        GroupStateTimeout.NoTimeout,
    )


def alert_stream(alerts: DataFrame, *, minutes: int = T.ALERT_COOLDOWN_MINUTES) -> DataFrame:
    """Alert cooldown as a stream; the state is the time of the last fired alert of each kind.

    Input: category string, severity string, ts timestamp, alert_id string.
    Alerts older than the last fired one of their kind are suppressed.
    """
    wait = pd.Timedelta(minutes=minutes).value // 1000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (None,)
        rows = pd.concat(list(frames)).sort_values(["t", "alert_id"])
        fired = []
        for t in rows["t"]:
            fires = key[1] == "CRITICAL" or last is None or t - last >= wait
            last = int(t) if fires else last
            fired.append(fires)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"category": key[0], "severity": key[1], "alert_id": rows["alert_id"], "fired": fired})

    rows = alerts.select("category", "severity", "alert_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return rows.groupBy("category", "severity").applyInPandasWithState(
        step, "category string, severity string, alert_id string, fired boolean", "last bigint", "append", GroupStateTimeout.NoTimeout
    )


def write_in_turn(rows: DataFrame, path: str, order: Column, parts: int) -> None:
    """Write rows as ``parts`` files, one after another by equal ranges of ``order``, for a stream of several micro-batches.

    A stream with ``maxFilesPerTrigger`` 1 then sees them in that order; rows of equal order are in one file.
    """
    ends = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    lo, hi = float(ends["lo"] or 0), float(ends["hi"] or 0)
    width = (hi - lo) / parts or 1.0
    part = F.least(F.floor((order.cast("double") - lo) / width), F.lit(parts - 1))
    for i in range(parts):
        rows.filter(F.coalesce(part, F.lit(0)) == i).coalesce(1).write.mode("append").parquet(path)


def run_to_table(stream: DataFrame, spark: SparkSession, label: str) -> DataFrame:
    """Drive a stream over the available input into a Parquet table and read that table."""
    path, checkpoint = new_path(spark, label), new_path(spark, f"{label}-checkpoint")
    query = start_log(stream, path, checkpoint)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
