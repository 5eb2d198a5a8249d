"""Registered whole-run, modelling and streaming queries and their SQL twins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from driftloom.operators import clean as P
from driftloom.operators import impact as B
from driftloom.operators import models as L
from driftloom.operators import registry as R
from driftloom.operators import splits
from driftloom.operators import windows as W
from driftloom.operators.ordered import rank_values
from driftloom.plans import fixtures as X
from driftloom.plans.drift_queries import CAT_LONG, CAT_VERDICT, NUMERIC_PARTS, PAIRS, SEVERITY, _with
from driftloom.plans.fixtures import rounded, table
from driftloom.plans.history_queries import SEQ, _windows, telemetry
from driftloom.plans.monitor import battery_monitor, monitor
from driftloom.plans.replay import RETRAINS, Replay, record, replay
from driftloom.plans.quality_queries import METRIC_CTE, METRICS_SQL, _alert_stream, batch_metrics
from driftloom.sources.stage import new_path, stage
from driftloom.sources.stores import ModelRegistry
from driftloom.streaming import online as O

FEATURES = ["l_quantity", "l_discount", "l_tax"]


# Whole runs ------------------------------------------------------------------------


def _scored_shift(s, d):
    """Shifted shipments with labels and a score that loses its meaning over the years."""
    age = F.col("batch_id") - X.REFERENCE_YEAR
    return X.shifted(s, d).withColumns(
        {
            "y": (F.col("l_extendedprice") / (1 + 0.1 * age) > 40000).cast("int"),
            "score": F.least(F.lit(1.0), (F.col("l_extendedprice") / (1 + 0.1 * age) * (1 - 0.15 * age) + F.col("l_tax") * 90000 * age) / 105000),
        }
    )


def _run(s, d):
    return monitor(_scored_shift(s, d), numeric=X.NUMERIC, categorical=X.CATEGORICAL, label="y", score="score")


def _summary(s, d):
    return rounded(
        _run(s, d).summary.select(
            "batch_id", "n_samples", "auc_roc", "f1_score", "precision_val", "recall_val", "brier_score", "overall_drift_score",
            "overall_severity", "n_drifted_features", "retrain_triggered", "baseline_auc", "auc_drop",
            "missed_churners", "total_monthly_loss", "total_annual_loss", "roi_status",
        )
    )


def _numeric_summary(s, d):
    run = monitor(_scored_shift(s, d), numeric=X.NUMERIC, categorical=[], label="y", score="score", baseline=0.95)
    return rounded(
        run.summary.select(
            "batch_id", "n_samples", "auc_roc", "f1_score", "overall_drift_score", "overall_severity", "n_drifted_features",
            "rule", "retrain_triggered", "auc_drop", "missed_churners", "total_monthly_loss", "roi_status",
        )
    )


def _recorded(s, d):
    """The run as the registry tells it: batch rows read back from the written tables, with the model's status."""
    run, registry = _run(s, d), ModelRegistry(s, new_path(s, "registry"))
    whole = Replay(run.details, run.prediction, run.summary, s.createDataFrame([], RETRAINS), None, 0.0)
    record(whole, registry, name="shipments", at=dt.datetime(2024, 1, 1), thresholds={"auc_critical": 0.75})
    rows = registry.model_history().join(registry.models().select("model_id", "name", "status"), "model_id")
    verdicts = registry.drift_history().groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_verdicts"))
    return rounded(rows.join(verdicts, "batch_id").select(
        "name", "status", "batch_id", "auc_roc", "f1_score", "precision_val", "recall_val", "brier_score", "drift_score", "drift_severity",
        "n_drifted_feats", "n_samples", "retrain_triggered", "roi_monthly_loss", "roi_missed_churners", "n_verdicts",
    ))


def _replayed(s, d):
    """All shipment years in order, with a ridge score that is fitted again and promoted where that helps."""

    def fit(rows):
        return L.degradation_trend(rows.withColumn("_target", F.col("y") * 100.0), "_target", X.NUMERIC)

    def score(model, rows):
        return rows.withColumn("score", model.predict() / 100)

    first = L.Trend(X.NUMERIC, [25.0, 38000.0, 0.05, 0.04], [14.0, 23000.0, 0.03, 0.03], [25.0, -5.0, 0.0, 10.0], 50.0)
    key = ["l_orderkey", "l_linenumber"]
    run = replay(
        _scored_shift(s, d).select(*key, *X.NUMERIC, "y", "batch_id", "is_reference"), numeric=X.NUMERIC, categorical=[], label="y", key=key, fit=fit, score=score, model=first
    )
    promoted = run.retrains.select("batch_id", F.col("promoted"), "old_auc", "new_auc")
    return rounded(run.summary.join(promoted, "batch_id", "left").select(
        "batch_id", "epoch", "n_samples", "auc_roc", "f1_score", "overall_severity", "rule", "retrain_triggered", "promoted", "old_auc", "new_auc",
        "baseline_auc", "total_monthly_loss", "roi_status",
    ))


def _alerts(s, d):
    run = _run(s, d)
    when = F.make_timestamp(F.col("batch_id"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("ts")
    model = F.lit(1).alias("model_id")
    summary = run.summary
    drift = summary.select(model, "batch_id", when, "overall_severity", "drifted_features", "overall_drift_score")
    quality = summary.select(model, "batch_id", when, "auc_roc", "f1_score")
    retrained = L.promotion(
        summary.filter("retrain_triggered").select(
            model, "batch_id", when, F.col("auc_roc").alias("old_auc"), (F.col("auc_roc") + 0.06).alias("new_auc")
        )
    )
    fired = W.alert_cooldown(B.monitoring_alerts(drift, quality, retrained))
    return fired.select("batch_id", "severity", "category", "title", "message", "fired")


def _battery(s, d):
    rows = X.shipments(s, d).withColumns(
        {
            "soh": 1 - F.col("l_quantity") / 100, "soh_predicted": 1 - F.col("l_quantity") / 100 + F.col("l_tax") / 10,
            "fault": (F.col("l_quantity") > 40).cast("int"), "risk": F.least(F.lit(1.0), F.col("l_quantity") / 50 * (0.9 + F.col("l_discount"))),
        }
    )
    out = battery_monitor(rows, features=FEATURES, soh="soh", soh_predicted="soh_predicted", label="fault", score="risk")
    return rounded(out.select("batch_id", "soh_mean", "fault_rate", "soh_mae", "auc_roc", "f1_score", "overall_drift_score",
                              "n_drifted_features", "total_monthly_loss_usd", "annualized_risk_usd"))


# Models --------------------------------------------------------------------------------


def _split(s, d):
    rows = table(s, d, "orders").select(
        "o_orderkey", "o_totalprice", F.dayofyear("o_orderdate").alias("day"), "o_custkey", "o_orderpriority",
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        (F.col("o_totalprice") / 500000 + (F.col("o_orderpriority") == "1-URGENT").cast("double") * 0.3 > 0.55).cast("int").alias("late"),
    )
    return splits.stratified_split(rows, key=["o_orderkey"], strata="late")


_NUM, _CAT = ["o_totalprice", "day", "o_custkey"], ["o_orderpriority"]


def _churn(s, d):
    rows = stage(_split(s, d), "split")
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    model = L.churn_classifier(train, "late", _NUM, _CAT, trees=10, depth=4, rate=0.3)
    return model, train, test


def _churn_quality(s, d):
    from driftloom.operators.quality import binary_metrics

    model, _, test = _churn(s, d)
    return rounded(binary_metrics(L.score_table(model, test), "late", "score"))


def _importance(s, d):
    model, train, _ = _churn(s, d)
    return rounded(L.feature_importances(model, model.transform(train)))


def _scored_orders(s, d):
    model, _, test = _churn(s, d)
    return L.score_table(model, test).groupBy("predicted", "late").agg(F.count(F.lit(1)).alias("n"))


def _battery_rows(s, d):
    return stage(
        telemetry(s, d).withColumns(
            {
                "soh": 1 - F.col("cycle_count") * 0.004 - F.col("temperature_c") * 0.001,
                "fault_label": ((F.col("temperature_c") > 90) | (F.col("voltage_v") > 4.2)).cast("int"),
                "fade": F.col("cycle_count") * 0.4 + F.col("temperature_c") * 0.1,
            }
        ),
        "battery",
    )


_BAT = ["cycle_count", "voltage_v", "current_a", "temperature_c"]


def _health(s, d):
    from driftloom.operators.quality import regression_metrics

    rows = stage(splits.split_by_cycle(_battery_rows(s, d), "cycle_count"), "battery-by-cycle")
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    model = L.health_regressor(train, "soh", _BAT, trees=10, depth=4, rate=0.3)
    return rounded(regression_metrics(L.clipped_prediction(model.transform(test), 0.0, 1.0, test.columns), "soh", "prediction"))


def _faults(s, d):
    from driftloom.operators.quality import binary_metrics

    rows = stage(splits.stratified_split(_battery_rows(s, d), key=["event_id"], strata="fault_label"), "battery-by-fault")
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    out = None
    for forest in (False, True):
        model = L.fault_classifier(train, "fault_label", _BAT, trees=10, forest=forest)
        scored = L.score_table(model, test, threshold=0.40)
        part = binary_metrics(scored, "fault_label", "score", threshold=0.40).withColumn("forest", F.lit(forest))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


def _trend(s, d):
    rows = _battery_rows(s, d)
    fit = L.degradation_trend(rows, "fade", _BAT)
    return rounded(rows.select("event_id", fit.predict().alias("fade_predicted")))


def _sequence_model(s, d):
    from driftloom.operators.quality import regression_metrics

    windows = stage(splits.split_by_cycle(_windows(s, d, 5), "position"), "windows")
    train, test = windows.filter("split = 'train'"), windows.filter("split = 'test'")
    _, score = L.charge_from_sequences(train, length=10, width=len(SEQ), trees=5, depth=3)
    return rounded(regression_metrics(score(test), "target", "prediction"))


def _spread(s, d):
    rows = stage(splits.split_by_cycle(_battery_rows(s, d), "cycle_count"), "battery-by-cycle")
    out = L.prediction_spread(rows.filter("split = 'test'"), rows.filter("split = 'train'"), "soh", _BAT, key=["event_id"], models=3, trees=3, depth=3)
    return rounded(out.agg(F.count(F.lit(1)).alias("n"), F.avg("mean_prediction").alias("mean"), F.avg("std_prediction").alias("spread")))


def _retrained(s, d):
    rows = stage(_split(s, d), "split")
    holdout = rows.filter("split = 'test'")

    def fit(part):
        return L.churn_classifier(part, "late", _NUM, _CAT, trees=5, depth=3, rate=0.3)

    first = rows.filter("day < 100 and split = 'train'")
    _, decision = L.retrain(rows, holdout, "late", fit, fit(first), key=["o_orderkey"])
    return rounded(decision.select("old_auc", "new_auc", "promoted"))


def _search(s, d):
    rows = stage(_split(s, d), "split").filter("split = 'train'")
    model = L.search_parameters(rows, "late", _NUM, _CAT, key=["o_orderkey"], grid={"maxDepth": [2, 4]}, folds=5, trees=3)
    return rounded(L.best_trials(model, rows))


def _fused(s, d):
    rows = X.shipments(s, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate",
        F.when(F.col("l_discount") != 0.05, 1 - F.col("l_discount") * 4).alias("soh"),
        F.when(F.col("l_tax") != 0.02, F.col("l_tax") * 500).alias("fade"),
        F.when(F.col("l_quantity") > 5, F.col("l_quantity") / 50).alias("soc"),
        F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") / 250000).alias("fault"),
        F.when(F.col("l_returnflag") == "R", F.col("l_discount")).alias("thermal"),
    )
    out = L.fuse_predictions(rows, soh="soh", fade="fade", soc="soc", fault="fault", thermal="thermal")
    return rounded(out.groupBy("degradation_severity", "fault_flag", "recommended_action").agg(
        F.count(F.lit(1)).alias("n"), F.sum("soh_estimate").alias("soh_sum"), F.min("soh_estimate").alias("soh_min"),
        F.sum("fault_probability").alias("fault_sum"), F.sum("capacity_fade_estimate").alias("fade_sum"),
    ))


# Streams ---------------------------------------------------------------------------------


def _events_stream(s, d):
    schema = table(s, d, "events").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


_REQUEST_RULES = [P.Rule("value", 0, 400), P.Rule("event_type", allowed=("click", "view", "purchase", "signup"))]


def _online_scores(s, d):
    def score(rows):
        return rows.withColumn("prediction_score", F.col("value") / 500)

    scored = O.score_stream(_events_stream(s, d), _REQUEST_RULES, score)
    out = O.run_to_table(scored.select("event_id", "is_valid", "prediction_score", "predicted", "risk"), s, "scores")
    return rounded(out)


def _numbered_predictions(s, d):
    rows = X.scored(s, d).withColumn("l_shipdate", F.unix_micros(F.col("l_shipdate").cast("timestamp")))
    return rank_values(
        rows, ["l_linestatus"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag"],
        out="position", totals="served",
    )


def _count_windows(s, d):
    rows = O.count_windows(_numbered_predictions(s, d), position="position", served="served")
    return rounded(rows.groupBy("l_linestatus", "window_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("first"), F.max("position").alias("last"), F.sum("score_b").alias("score_sum")
    ))


def _predictions(s, d):
    """Events as a prediction log per event type."""
    return table(s, d, "events").select(
        F.col("event_type").alias("model_id"), "ts", "event_id", (F.col("value") / 500).alias("prediction_score"), "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def _window_monitor(s, d):
    reference = _predictions(s, d).filter("ts < timestamp_ntz '2024-01-08'")
    path = new_path(s, "predictions")
    O.write_in_turn(_predictions(s, d), path, F.unix_micros(F.col("ts").cast("timestamp")), 3)
    stream = s.readStream.schema(_predictions(s, d).schema).option("maxFilesPerTrigger", 1).parquet(path)
    watch = O.WindowMonitor(s, new_path(s, "watch"), reference, ["value", "k"], [], ["ts", "event_id"])
    watch.start(stream, new_path(s, "watch-checkpoint")).awaitTermination()
    return rounded(watch.drift_log().select(
        "model_id", "window_id", "predictions_at_check", "window_size", "drift_severity", "drift_score", "n_drifted_features", "estimated_auc", "roi_monthly_loss"
    ))


def _event_time(s, d):
    bins = O.freeze(_predictions(s, d).filter("ts < timestamp_ntz '2024-01-08'"), ["value", "k"])
    return rounded(O.event_time_psi(_predictions(s, d), bins).withColumn("window_start", F.col("window_start").cast("string")))


def _event_time_stream(s, d):
    """The same through a stream; windows the watermark has not closed stay open."""
    bins = O.freeze(_predictions(s, d).filter("ts < timestamp_ntz '2024-01-08'"), ["value", "k"])
    rows = _events_stream(s, d).select(
        F.col("ts").cast("timestamp").alias("ts"), "value", F.get_json_object("props", "$.k").cast("double").alias("k")
    )
    return rounded(O.run_to_table(O.event_time_psi(rows, bins), s, "event-time").withColumn("window_start", F.col("window_start").cast("string")))


def _trigger_stream(s, d):
    rows = batch_metrics(s, d).select("model_id", F.col("batch_id").cast("long").alias("batch_id"), "auc_roc", "drift_severity")
    path = new_path(s, "metrics")
    O.write_in_turn(rows, path, F.col("batch_id"), 3)
    return O.run_to_table(O.trigger_stream(s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)), s, "triggers")


def _alert_cooldown_stream(s, d):
    rows = _alert_stream(s, d).withColumns({"alert_id": F.lpad(F.col("alert_id").cast("string"), 12, "0"), "ts": F.col("ts").cast("timestamp")})
    path = new_path(s, "alerts")
    O.write_in_turn(rows, path, F.unix_micros("ts"), 3)
    out = O.run_to_table(O.alert_stream(s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)), s, "fired")
    return out.select(F.col("alert_id").cast("long").alias("alert_id"), "category", "severity", "fired")


QUERIES = {
    "B5_batch_summary": _summary,
    "B5_numeric_summary": _numeric_summary,
    "B5_recorded_run": _recorded,
    "L12_replayed_run": _replayed,
    "B8_alerts": _alerts,
    "B4_battery_run": _battery,
    "L2_churn_classifier": _churn_quality,
    "L3_health_regressor": _health,
    "L4_fault_classifier": _faults,
    "L5_degradation_trend": _trend,
    "L6_charge_from_sequences": _sequence_model,
    "L7_fused_predictions": _fused,
    "L8_prediction_spread": _spread,
    "L12_retrain": _retrained,
    "L12_promotion": lambda s, d: rounded(
        L.promotion(batch_metrics(s, d).withColumnsRenamed({"auc_roc": "old_auc"}).withColumn("new_auc", 0.6 + F.col("f1_score") / 4)).select(
            "id", "old_auc", "new_auc", "promoted"
        )
    ),
    "L13_parameter_search": _search,
    "L14_feature_importance": _importance,
    "L16_scored_table": _scored_orders,
    "R1_online_scores": _online_scores,
    "R2_count_windows": _count_windows,
    "R2_R3_window_monitor": _window_monitor,
    "R4_trigger_stream": _trigger_stream,
    "R4_alert_stream": _alert_cooldown_stream,
    "R5_event_time_psi": _event_time,
    "R5_event_time_stream": _event_time_stream,
}

from driftloom.plans.history_queries import COOLDOWN_SQL, FIRED_SQL, TRIGGER_SQL  # noqa: E402

_SS = """ss as (select *, (l_extendedprice / (1 + 0.1::double * (batch_id - 1995)) > 40000)::int as y,
  least(1.0::double, (l_extendedprice / (1 + 0.1::double * (batch_id - 1995)) * (1 - 0.15::double * (batch_id - 1995)) + l_tax * 90000 * (batch_id - 1995)) / 105000) as score
  from f1s), prod as (select * from ss where not is_reference)"""

_WIN = "window w as (partition by model_id order by ts, event_id)"

SUMMARY_SQL = """, j as (select 1 as model_id, *, coalesce(2 * precision_val * recall_val / nullif(precision_val + recall_val, 0), 0) as f1_score,
      case when nc > 0 or nd > nf * 0.3 then 'critical' when nd > 0 then 'warning' else 'none' end as drift_severity from met join rep using (batch_id)),
    bm as (select * from j), """ + TRIGGER_SQL + ", raw as (select *, rule is not null as raised from rule), " + COOLDOWN_SQL

ORACLE = {
    "B5_batch_summary": _with("f1s", ("f1", "f1s"), *NUMERIC_PARTS, CAT_LONG.format(src="f1s", cols="l_returnflag, l_linestatus"), CAT_VERDICT, _SS,
                              METRIC_CTE.format(k="batch_id", s="score", src="prod", t=0.5)).replace("with ", "with recursive ", 1)
    + """, b0 as (select score, sum(y)::double as pos, sum(1 - y)::double as neg from ss where is_reference group by all),
    b1 as (select *, sum(neg) over (order by score) - neg as below, sum(pos) over () as pp, sum(neg) over () as nn from b0),
    base as (select sum(pos * (below + neg / 2)) / (max(pp) * max(nn)) as b from b1),
    dd as (select batch_id, score, severity from verdict union all select batch_id, chi2, severity from cv),
    rep as (select batch_id, avg(score) as overall_drift_score, count(*) filter (severity <> 'none') as nd, count(*) filter (severity = 'critical') as nc, count(*) as nf
      from dd group by all)""" + SUMMARY_SQL + """,
    o as (select *, greatest(0::double, b - auc_roc) as auc_drop from raw join (select model_id, r, fired from st) using (model_id, r), base),
    q as (select *, floor(500 * least(auc_drop * 1.8::double, 0.8::double))::bigint as missed_churners from o),
    z as (select *, missed_churners * 0.3::double * 3600 + floor(500 * least(auc_drop * 1.5::double, 0.5::double) * 0.7::double) * 50 as loss from q)
    select batch_id, n_samples, round(auc_roc, 6) as auc_roc, round(f1_score, 6) as f1_score, round(precision_val, 6) as precision_val, round(recall_val, 6) as recall_val,
      round(brier_score, 6) as brier_score, round(overall_drift_score, 6) as overall_drift_score, drift_severity as overall_severity, nd as n_drifted_features,
      fired as retrain_triggered, round(b, 6) as baseline_auc, round(auc_drop, 6) as auc_drop, missed_churners, round(loss, 6) as total_monthly_loss,
      round(loss * 12, 6) as total_annual_loss, case when auc_drop = 0 then 'healthy' when auc_drop < 0.07 then 'warning' else 'critical' end as roi_status from z""",
    "B5_numeric_summary": _with("f1s", ("f1", "f1s"), *NUMERIC_PARTS, _SS, METRIC_CTE.format(k="batch_id", s="score", src="prod", t=0.5)).replace("with ", "with recursive ", 1)
    + """, rep as (select batch_id, avg(score) as overall_drift_score, count(*) filter (severity <> 'none') as nd, count(*) filter (severity = 'critical') as nc, count(*) as nf
      from verdict group by all)""" + SUMMARY_SQL + """,
    o as (select *, greatest(0::double, 0.95::double - auc_roc) as auc_drop from raw join (select model_id, r, fired from st) using (model_id, r)),
    q as (select *, floor(500 * least(auc_drop * 1.8::double, 0.8::double))::bigint as missed_churners from o)
    select batch_id, n_samples, round(auc_roc, 6) as auc_roc, round(f1_score, 6) as f1_score, round(overall_drift_score, 6) as overall_drift_score,
      drift_severity as overall_severity, nd as n_drifted_features, rule, fired as retrain_triggered, round(auc_drop, 6) as auc_drop, missed_churners,
      round(missed_churners * 0.3::double * 3600 + floor(500 * least(auc_drop * 1.5::double, 0.5::double) * 0.7::double) * 50, 6) as total_monthly_loss,
      case when auc_drop = 0 then 'healthy' when auc_drop < 0.07 then 'warning' else 'critical' end as roi_status from q""",
    "L7_fused_predictions": """with r as (select case when l_discount <> 0.05 then 1 - l_discount * 4 end as soh, case when l_tax <> 0.02 then l_tax * 500 end as fade,
        case when l_quantity > 5 then l_quantity / 50 end as soc, coalesce(case when l_linenumber <> 3 then l_extendedprice / 250000 end, 0) as fault,
        coalesce(case when l_returnflag = 'R' then l_discount end, 0) as thermal from lineitem),
      e as (select *, (case when soh is null then 0 else 0.5 end + case when fade is null then 0 else 0.25 end + case when soc is null then 0 else 0.25 end)::double as t,
        coalesce(0.5::double * soh, 0) + coalesce(0.25::double * greatest(0, 1 - fade / 100), 0) + coalesce(0.25::double * soc, 0) as m from r),
      f as (select *, greatest(0, least(1, case when t > 0 then m / t else 0.8 end)) as est, fault >= 0.35 or thermal >= 0.10 as flag from e),
      g as (select *, case when flag then 'critical' when est >= 0.8 then 'healthy' when est >= 0.7 then 'warning' else 'critical' end as sev from f)
      select sev as degradation_severity, flag as fault_flag, case when flag then '⚠️ FAULT DETECTED. Immediate inspection required. Consider shutdown.'
          when est >= 0.8 then 'Continue normal operation. Schedule routine check in 3 months.'
          when est >= 0.7 then 'SOH declining. Reduce fast-charging frequency. Schedule inspection.'
          else 'SOH below 70%. Battery replacement recommended within 30 days.' end as recommended_action, count(*) as n, round(sum(est), 6) as soh_sum,
        round(min(est), 6) as soh_min, round(sum(fault), 6) as fault_sum, round(sum(coalesce(fade, 0)), 6) as fade_sum from g group by all""",
    "L12_promotion": f"""with {METRICS_SQL} select id, round(auc_roc, 6) as old_auc, round(0.6::double + f1_score / 4, 6) as new_auc,
      0.6::double + f1_score / 4 - auc_roc >= 0.01 as promoted from bm""",
    "R1_online_scores": """with v as (select event_id, value / 500 as p, value between 0 and 400 and event_type in ('click', 'view', 'purchase', 'signup') as ok from events)
      select event_id, ok as is_valid, case when ok then round(p, 6) end as prediction_score, case when ok then (p >= 0.5)::int end as predicted,
        case when ok then case when p >= 0.7 then 'high' when p >= 0.4 then 'medium' else 'low' end end as risk from v""",
    "R2_count_windows": f"""with {X.ctes('f1', 'f3')}, r as (select l_linestatus, score_b, row_number() over (partition by l_linestatus order by l_shipdate, l_orderkey, l_linenumber,
        l_extendedprice, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag) as r, count(*) over (partition by l_linestatus) as n from f3),
      w as (select *, unnest(range(ceil(r / 500)::bigint, least((r + 999) // 500, n // 500) + 1)) as window_id from r)
      select l_linestatus, window_id, count(*) as n, min(r) as first, max(r) as last, round(sum(score_b), 6) as score_sum from w group by all""",
    "R2_R3_window_monitor": """with p as (select event_type as model_id, ts, event_id, value / 500 as s, value, (props->>'$.k')::double as k from events),
      r as (select *, row_number() over w as r, count(*) over (partition by model_id) as n from p """ + _WIN + """),
      x as (select *, unnest(range(ceil(r / 500)::bigint, least((r + 999) // 500, n // 500) + 1)) as window_id from r),
      """ + """long as (select batch_id, is_reference, feature, v as value from (unpivot (
          select model_id || '#' || window_id as batch_id, false as is_reference, value as f_value, k as f_k, s as f_score from x
          union all select '', true, value, k, s from p where ts < timestamp '2024-01-08') on f_value, f_k, f_score into name feature value v)),
      """ + PAIRS + ",\n" + ",\n".join(NUMERIC_PARTS) + """,
      rep as (select batch_id, avg(score) as drift_score, count(*) filter (severity <> 'none') as nd, count(*) filter (severity = 'critical') as nc
        from verdict where feature <> 'f_score' group by all),
      e as (select batch_id, greatest(0.87::double - least(psi * 0.4::double, 0.15::double), 0.5::double) as estimated_auc from scores where feature = 'f_score'),
      w as (select model_id, window_id, model_id || '#' || window_id as batch_id, count(*) as window_size from x group by all),
      q as (select *, 0.87::double - estimated_auc as dr from w join rep using (batch_id) join e using (batch_id))
      select model_id, window_id, window_id * 500 as predictions_at_check, window_size, case when nc > 0 or nd > 2 * 0.3 then 'critical' when nd > 0 then 'warning' else 'none' end as drift_severity,
        round(drift_score, 6) as drift_score, nd as n_drifted_features, round(estimated_auc, 6) as estimated_auc,
        round(floor(500 * least(dr * 1.8::double, 0.8::double)) * 0.3::double * 3600 + floor(500 * least(dr * 1.5::double, 0.5::double) * 0.7::double) * 50, 6) as roi_monthly_loss
      from q where window_size >= 100""",
    "R4_trigger_stream": f"""with recursive {METRICS_SQL}, {TRIGGER_SQL}, raw as (select *, rule is not null as raised from rule), {COOLDOWN_SQL}
      select model_id, batch_id, fired as retrain_triggered from raw join st using (model_id, r)""",
    "R4_alert_stream": f"with recursive {FIRED_SQL} select alert_id, category, severity, fired from af",
    "R5_event_time_psi": """with p as (select date_trunc('day', ts) as w, ts < timestamp '2024-01-08' as ref, value, (props->>'$.k')::double as k from events),
      l as (unpivot p on value, k into name feature value v),
      m as (select feature, min(v) as lo, max(v) as hi from l where ref group by all),
      b as (select feature, w, ref, len(list_filter(range(1, 10), lambda i: i * ((hi - lo) / 10) + lo <= v)) as bin from l join m using (feature)),
      rs as (select feature, bin, count(*) / (sum(count(*)) over (partition by feature))::double as r from b where ref group by feature, bin),
      c as (select feature, w, bin, count(*) as c from b group by all),
      g as (select feature, w, sum(c) as n from c group by all),
      f as (select g.feature, g.w, g.n, i.bin, coalesce(rs.r, 0) + 1e-10 as r, coalesce(c.c, 0) / g.n::double + 1e-10 as p from g, range(0, 10) i(bin)
        left join rs on rs.feature = g.feature and rs.bin = i.bin left join c on c.feature = g.feature and c.w = g.w and c.bin = i.bin),
      s as (select feature, w, n, sum((p - r) * ln(p / r)) as psi from f group by all)
      select strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, feature, n::bigint as n, round(psi, 6) as psi, """ + SEVERITY.format("psi") + " as severity from s",
}

ORACLE["B5_recorded_run"] = f"""with b as ({ORACLE['B5_batch_summary']})
  select 'shipments' as name, last_value(case when auc_roc < 0.75 or overall_severity = 'critical' then 'critical'
      when auc_roc < 0.8 or overall_severity = 'warning' then 'warning' else 'healthy' end)
      over (order by batch_id rows between unbounded preceding and unbounded following) as status,
    batch_id::bigint as batch_id, auc_roc, f1_score, precision_val, recall_val, brier_score, overall_drift_score as drift_score,
    overall_severity as drift_severity, n_drifted_features::bigint as n_drifted_feats, n_samples, retrain_triggered,
    total_monthly_loss as roi_monthly_loss, missed_churners as roi_missed_churners, 6::bigint as n_verdicts from b"""
