"""Ordered operators over batches, alerts and telemetry.

Nothing here sorts a whole key in one task: rows are numbered through buckets
and worked on in fixed chunks, and ordered state crosses chunks as a small
summary per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions import thresholds as T
from driftloom.functions.statistics import clip
from driftloom.operators.ordered import BUCKET, KEY, add_order_bucket, chunked, keyed, rank_values, running_sums
from driftloom.sources.stage import stage

CHUNK = 256


def _numbered(df: DataFrame, keys: Sequence[str], order: str, out: str = "_r") -> DataFrame:
    return rank_values(df, keys, [order], out=out)


# Batch history ---------------------------------------------------------------


def rolling_mean(df: DataFrame, value: str, *, keys: Sequence[str], order: str = "batch_id", size: int = T.ROLLING_WINDOW, out: str | None = None) -> DataFrame:
    """Mean over the last ``size`` rows, NULL until there are that many values."""
    out = out or f"rolling_{value}"
    rows = chunked(_numbered(df, keys, order), "_r", max(CHUNK, size), size - 1)
    w = Window.partitionBy(*keys, "_chunk").orderBy("_r").rowsBetween(-(size - 1), 0)
    mean = F.when(F.count(value).over(w) == size, F.avg(value).over(w))
    return rows.withColumn(out, mean).filter("_own").drop("_r", "_chunk", "_own")


def cumulative(df: DataFrame, value: str, *, keys: Sequence[str], order: str = "batch_id", out: str | None = None) -> DataFrame:
    """Running sum in order."""
    out = out or f"cumulative_{value}"
    rows = running_sums(add_order_bucket(df, [order]), keys, [order], [value], by_row=True)
    return rows.withColumnRenamed(f"{value}_cum", out).drop(BUCKET)


def raw_triggers(df: DataFrame, *, keys: Sequence[str], order: str = "batch_id", auc: str = "auc_roc", severity: str = "drift_severity") -> DataFrame:
    """Which retraining rule each batch meets, before any cooldown; the first match names it.

    Adds ``rule`` (NULL if none) and ``_r``, the batch's position in its history.
    """
    rows = chunked(_numbered(df, keys, order), "_r", CHUNK, T.TREND_LAG)
    w = Window.partitionBy(*keys, "_chunk").orderBy("_r")
    earlier = F.lag(auc, T.TREND_LAG).over(w)
    a = F.col(auc)
    rule = (
        F.when(a < T.AUC_CRITICAL, "auc_floor")
        .when(F.col(severity).isin("warning", "critical") & (a < T.AUC_WARNING), "drift_and_auc")
        .when((earlier - a > T.TREND_DROP) & (a < T.AUC_WARNING), "auc_trend")
    )
    return rows.withColumns({"auc_before": earlier, "rule": rule}).filter("_own").drop("_chunk", "_own")


def _advance(state: Column, raised: Column, cooldown: int) -> Column:
    """Cooldown left after one batch."""
    return F.when(state > 0, state - 1).when(raised, F.lit(cooldown)).otherwise(F.lit(0))


def apply_cooldown(df: DataFrame, raised: str, *, keys: Sequence[str], position: str = "_r", cooldown: int = T.TRIGGER_COOLDOWN) -> DataFrame:
    """Fire raised rows unless one of the ``cooldown`` rows before them fired.

    The cooldown counter has cooldown+1 states.  Each chunk of rows becomes a
    table from the state before it to the state after it; tables compose, first
    over chunks of chunks, so every array stays short.  Then each chunk is
    replayed from its true start state.
    """
    states = list(range(cooldown + 1))
    start = F.array(*[F.lit(s) for s in states])
    rows = keyed(df, keys).withColumn("_c1", F.floor((F.col(position) - 1) / CHUNK)).withColumn("_c2", F.floor(F.col("_c1") / CHUNK))

    packed = rows.groupBy(KEY, "_c2", "_c1").agg(
        F.array_sort(F.collect_list(F.struct(F.col(position).alias("r"), F.col(raised).alias("raised")))).alias("_rows")
    )
    packed = packed.withColumn(
        "_map",
        F.aggregate("_rows", start, lambda acc, x: F.transform(acc, lambda s: _advance(s, x["raised"], cooldown))),
    )

    def compose(maps: Column) -> Column:
        return F.aggregate(maps, start, lambda acc, m: F.transform(acc, lambda s: F.get(m, s)))

    def entries(items: Column, first: Column) -> Column:
        """Start state of each (id, map) item, as an array of (id, state)."""
        seed = F.struct(first.alias("state"), F.array().cast("array<struct<id:bigint,state:int>>").alias("seen"))

        def step(acc, item):
            seen = F.concat(acc["seen"], F.array(F.struct(item["id"].alias("id"), acc["state"].alias("state"))))
            return F.struct(F.get(item["map"], acc["state"]).alias("state"), seen.alias("seen"))

        return F.aggregate(items, seed, step)["seen"]

    groups = packed.groupBy(KEY, "_c2").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_c1").alias("id"), F.col("_map").alias("map")))).alias("_chunks")
    ).withColumn("_map2", compose(F.transform("_chunks", lambda c: c["map"])))
    tops = groups.groupBy(KEY).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_c2").alias("id"), F.col("_map2").alias("map")))).alias("_groups")
    )
    tops = tops.select(KEY, F.inline(entries(F.col("_groups"), F.lit(0)))).withColumnsRenamed({"id": "_c2", "state": "_s2"})
    starts = (
        groups.join(tops, [KEY, "_c2"])
        .select(KEY, "_c2", F.inline(entries(F.col("_chunks"), F.col("_s2"))))
        .withColumnsRenamed({"id": "_c1", "state": "_s1"})
    )
    seed = F.struct(F.col("_s1").alias("state"), F.array().cast("array<bigint>").alias("fired"))

    def replay(acc, x):
        fires = (acc["state"] == 0) & x["raised"]
        fired = F.when(fires, F.concat(acc["fired"], F.array(x["r"].cast("long")))).otherwise(acc["fired"])
        return F.struct(_advance(acc["state"], x["raised"], cooldown).alias("state"), fired.alias("fired"))

    fired = (
        packed.join(starts, [KEY, "_c2", "_c1"])
        .select(KEY, F.explode(F.aggregate("_rows", seed, replay)["fired"]).alias(position), F.lit(True).alias("fired"))
    )
    out = rows.drop("_c1", "_c2").join(fired, [KEY, position], "left")
    return out.withColumn("fired", F.coalesce("fired", F.lit(False))).drop(KEY)


def retrain_triggers(df: DataFrame, *, keys: Sequence[str], order: str = "batch_id", auc: str = "auc_roc", severity: str = "drift_severity") -> DataFrame:
    """Retraining decisions: rules, then the cooldown of three batches."""
    rows = raw_triggers(df, keys=keys, order=order, auc=auc, severity=severity)
    # one row per batch of a model, read by the cooldown and by the result
    rows = stage(rows.withColumn("_raised", F.col("rule").isNotNull()), "triggers")
    out = apply_cooldown(rows, "_raised", keys=keys)
    reason = (
        F.when(
            F.col("rule") == "auc_floor",
            F.format_string(f"AUC %.4f below critical threshold {T.AUC_CRITICAL}", F.col(auc)),
        )
        .when(
            F.col("rule") == "drift_and_auc",
            F.format_string("AUC %.4f below warning threshold with %s drift detected", F.col(auc), F.col(severity)),
        )
        .when(
            F.col("rule") == "auc_trend",
            F.format_string(
                "Rolling AUC drop: %.4f→%.4f (%.3f over 3 batches)",
                F.col("auc_before"), F.col(auc), F.col("auc_before") - F.col(auc),
            ),
        )
    )
    return out.withColumns(
        {"retrain_triggered": F.col("fired"), "retrain_reason": F.when(F.col("fired"), reason).otherwise("")}
    ).drop("_r", "_raised", "fired", "auc_before")


# Alert cooldown ----------------------------------------------------------------


def _reach(times: np.ndarray, cooldown: int) -> np.ndarray:
    """Last alert fired in the chunk when each alert in turn is the first to fire."""
    nxt = np.searchsorted(times, times + cooldown)
    reach = np.where(nxt < len(times), nxt, np.arange(len(times)))
    while True:  # each round doubles the length of the paths
        further = reach[reach]
        if np.array_equal(further, reach):
            return times[reach]
        reach = further


def alert_cooldown(
    alerts: DataFrame, *, category: str = "category", severity: str = "severity", time: str = "ts", tie: str = "alert_id",
    minutes: int = T.ALERT_COOLDOWN_MINUTES,
) -> DataFrame:
    """Mark which alerts fire: CRITICAL always, others 30 minutes after the last fired of their kind.

    Null is a kind like any other.  Of equal instants only the alert with the
    smallest id (null first) can fire, and of repeated rows one, so kinds
    collapse to distinct instants first.  Each kind is cut into chunks of 48 cooldowns.  A chunk is
    summed up as a step function "earliest allowed time -> last fired time";
    few steps remain because paths from different starts soon meet.  The steps
    are chained per kind, then the chunks are replayed in parallel.
    """
    cooldown = minutes * 60 * 1_000_000
    span = cooldown * 48
    always = F.col(severity).eqNullSafe("CRITICAL")
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    # the kind as one text without nulls; the id as a struct, which is equal to itself also where it is null
    name = F.to_json(F.struct(F.col(category).alias("c"), F.col(severity).alias("s")))
    rows = alerts.withColumns({"_t": micros, "_kind": name, "_tie": F.struct(tie)})
    firsts = rows.filter(~always & F.col("_t").isNotNull()).groupBy("_kind", "_t").agg(F.min("_tie").alias("_tie"))
    instants = firsts.select("_kind", "_t", F.floor(F.col("_t") / span).alias("_chunk"))

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_t"].to_numpy())
        reach = _reach(times, cooldown)
        # an earlier chunk can hold the first alert back by one cooldown at most
        head = min(len(times), int(np.searchsorted(times, pdf["_chunk"].iloc[0] * span + cooldown)) + 1)
        times, reach = times[:head], reach[:head]
        keep = np.append(reach[1:] != reach[:-1], True)
        return pd.DataFrame([{"_kind": pdf["_kind"].iloc[0], "_chunk": pdf["_chunk"].iloc[0], "upto": times[keep].tolist(), "last": reach[keep].tolist()}])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        allowed, starts = np.iinfo(np.int64).min, []
        for upto, last in zip(pdf["upto"], pdf["last"], strict=True):
            starts.append(allowed)
            i = int(np.searchsorted(np.asarray(upto), allowed))
            if i < len(upto):
                allowed = int(last[i]) + cooldown
        return pdf[["_kind", "_chunk"]].assign(_allowed=starts)

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_t"].to_numpy())
        allowed, fired = pdf["_allowed"].iloc[0], []
        i = int(np.searchsorted(times, allowed))
        while i < len(times):
            fired.append(times[i])
            i = int(np.searchsorted(times, times[i] + cooldown))
        return pd.DataFrame({"_kind": pdf["_kind"].iloc[0], "_t": np.asarray(fired, dtype="int64")})

    steps = instants.groupBy("_kind", "_chunk").applyInPandas(
        summarise, "_kind string, _chunk bigint, upto array<bigint>, last array<bigint>"
    )
    starts = steps.groupBy("_kind").applyInPandas(chain, "_kind string, _chunk bigint, _allowed bigint")
    fired = (
        instants.join(starts, ["_kind", "_chunk"])
        .groupBy("_kind", "_chunk")
        .applyInPandas(replay, "_kind string, _t bigint")
        .join(firsts, ["_kind", "_t"])
        .select("_kind", "_t", "_tie", F.lit(True).alias("_fired"))
    )
    alert = ["_kind", "_t", "_tie"]
    copy = F.row_number().over(Window.partitionBy(*alert).orderBy(F.xxhash64(*[c for c, t in alerts.dtypes if "map<" not in t])))
    out = rows.join(fired, alert, "left").withColumn("_copy", copy)
    fires = always | (F.coalesce("_fired", F.lit(False)) & (F.col("_copy") == 1))
    return out.withColumn("fired", fires).drop("_fired", "_copy", *alert)


# Telemetry -----------------------------------------------------------------------


def coulomb_fixed_step(
    df: DataFrame, *, cell: str, time: str, order: Sequence[str], current: str, capacity_ah: float = T.NOMINAL_CAPACITY_AH,
    initial: float = 1.0, dt: float = 1.0, out: str = "soc",
) -> DataFrame:
    """State of charge from summed current with a fixed time step; clipped after the sum."""
    rows = add_order_bucket(df, order).withColumn("_q", F.col(current) * dt)
    rows = running_sums(rows, [cell], list(order), ["_q"], by_row=True)
    soc = initial + F.col("_q_cum") / (capacity_ah * 3600.0)
    return rows.withColumn(out, clip(soc, 0.0, 1.0)).drop("_q", "_q_cum", BUCKET)


def _seconds(df: DataFrame, time: str) -> Column:
    """The time column as double seconds."""
    if dict(df.dtypes)[time].startswith("timestamp"):
        return F.unix_micros(F.col(time).cast("timestamp")) / F.lit(1e6)
    return F.col(time).cast("double")


def coulomb_variable_step(
    df: DataFrame, *, cell: str, time: str, order: Sequence[str], current: str, capacity_ah: float = T.CYCLER_CAPACITY_AH,
    initial: Column | float = 1.0, out: str = "soc", charge: str = "cc_capacity_ah",
) -> DataFrame:
    """State of charge with the time step taken from the data; the first step is 0.

    The time before a bucket's first row comes from the bucket before it.
    The rows are staged, as they are read several times.
    """
    df = stage(df, "charge-rows")
    initial = initial if isinstance(initial, Column) else F.lit(initial)
    rows = keyed(add_order_bucket(df.withColumn("_sec", _seconds(df, time)), order), [cell])
    group = [KEY, BUCKET]
    ends = rows.groupBy(*group).agg(F.max("_sec").alias("_end"))
    ends = ends.select(*group, F.lag("_end").over(Window.partitionBy(KEY).orderBy(BUCKET)).alias("_carry"))
    w = Window.partitionBy(*group).orderBy(*order)
    before = F.coalesce(F.lag("_sec").over(w), F.col("_carry"))
    dt = F.coalesce(F.greatest(F.lit(0.0), F.col("_sec") - before), F.lit(0.0))
    rows = rows.join(ends, group).withColumn("_q", F.col(current) * dt / 3600.0).drop("_carry", KEY)
    rows = running_sums(rows, [cell], list(order), ["_q"], by_row=True)
    return (
        rows.withColumn(charge, F.col("_q_cum"))
        .withColumn(out, clip(initial + F.col("_q_cum") / capacity_ah, 0.0, 1.0))
        .drop("_q", "_q_cum", "_sec", BUCKET)
    )


def min_max_scaled(df: DataFrame, features: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Scale to [0, 1] with the training rows' min and max; a constant column has span 1."""
    train = df if train is None else train
    limits = train.agg(
        F.struct(*[x for f in features for x in (F.min(f).alias(f"lo_{f}"), F.max(f).alias(f"hi_{f}"))])
    ).scalar()

    def scaled(f: str) -> Column:
        lo, hi = F.col(f"_limits.lo_{f}"), F.col(f"_limits.hi_{f}")
        return (F.col(f) - lo) / F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)

    return df.withColumn("_limits", limits).withColumns({f"{f}_scaled": scaled(f) for f in features}).drop("_limits")


def sequences(
    df: DataFrame, *, cell: str, time: str, order: Sequence[str], features: Sequence[str], target: str, length: int = 10, step: int = 1,
) -> DataFrame:
    """Windows of ``length`` consecutive rows per cell with the target at their end.

    Rows are numbered, cut into chunks and preceded by length-1 copied rows.
    """
    rows = rank_values(df, [cell], list(order), out="_r")
    rows = chunked(rows, "_r", max(4096, length), length - 1)
    w = Window.partitionBy(cell, "_chunk").orderBy("_r").rowsBetween(-(length - 1), 0)
    window = F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(w)
    return (
        rows.withColumn("window", window)
        .filter(F.col("_own") & (F.size("window") == length) & ((F.col("_r") - length) % step == 0))
        .select(cell, *order, F.col("_r").alias("position"), "window", F.col(target).alias("target"))
    )


def latest_sequence(windows: DataFrame, *, cell: str, order: Sequence[str]) -> DataFrame:
    """The most recent window of every cell."""
    value = F.struct(*[c for c in windows.columns if c != cell])
    return windows.groupBy(cell).agg(F.max_by(value, F.struct(*order)).alias("_w")).select(cell, "_w.*")
