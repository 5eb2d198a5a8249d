"""Registered profile, quality and impact queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import drift as D
from driftloom.operators import impact as B
from driftloom.operators import profile as A
from driftloom.operators import quality as M
from driftloom.plans import fixtures as X
from driftloom.plans.drift_queries import LONG
from driftloom.plans.fixtures import rounded, table

STATS = """count(value)::bigint as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std,
  min(value) as min, max(value) as max, quantile_cont(value, 0.25) as p25, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.75) as p75"""
STATS_ROUNDED = STATS.replace("min(value) as min", "round(min(value), 6) as min").replace(
    "max(value) as max", "round(max(value), 6) as max"
).replace("quantile_cont(value, 0.25) as", "round(quantile_cont(value, 0.25), 6) as").replace(
    "quantile_cont(value, 0.5) as", "round(quantile_cont(value, 0.5), 6) as").replace(
    "quantile_cont(value, 0.75) as", "round(quantile_cont(value, 0.75), 6) as")


def _f3(s, d):
    return X.scored(s, d)


METRIC_CTE = """cnt as (select {k}, {s} as s, sum(y)::double as pos, sum(1 - y)::double as neg from {src} group by all),
run as (select *, sum(neg) over (partition by {k} order by s) - neg as neg_below, sum(pos) over (partition by {k}) as pp,
   sum(neg) over (partition by {k}) as nn, sum(pos) over (partition by {k} order by s desc) as tp,
   sum(neg) over (partition by {k} order by s desc) as fp from cnt),
met as (select {k}, (max(pp) + max(nn))::bigint as n_samples,
  case when max(pp) * max(nn) > 0 then sum(pos * (neg_below + neg / 2)) / (max(pp) * max(nn)) end as auc_roc,
  coalesce(sum(pos * tp / (tp + fp)) / nullif(max(pp), 0), 0) as avg_precision,
  coalesce(sum(pos) filter (s >= {t}) / nullif(sum(pos + neg) filter (s >= {t}), 0), 0) as precision_val,
  coalesce(coalesce(sum(pos) filter (s >= {t}), 0) / nullif(max(pp), 0), 0) as recall_val,
  sum(pos * pow(s - 1, 2) + neg * pow(s, 2)) / (max(pp) + max(nn)) as brier_score,
  max(pp) / (max(pp) + max(nn)) as rate_true,
  coalesce(sum(pos + neg) filter (s >= {t}), 0) / (max(pp) + max(nn)) as rate_pred from run group by all)"""

METRIC_OUT = """select {k}, n_samples, round(auc_roc, 6) as auc_roc, round(avg_precision, 6) as avg_precision,
  round(precision_val, 6) as precision_val, round(recall_val, 6) as recall_val,
  round(coalesce(2 * precision_val * recall_val / nullif(precision_val + recall_val, 0), 0), 6) as f1_score,
  round(brier_score, 6) as brier_score, round(rate_true, 6) as rate_true, round(rate_pred, 6) as rate_pred from met"""


def metric_sql(src: str, score: str, base: str, keys: str = "batch_id", t: float = 0.5) -> str:
    return f"with {base},\n" + METRIC_CTE.format(k=keys, s=score, src=src, t=t) + "\n" + METRIC_OUT.format(k=keys)


def _docs(s, d):
    """Labelled documents: y = toxic, score grows with length."""
    docs = table(s, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(s, d, "labels"), "doc_id").withColumns(
        {"score": F.least(F.lit(1.0), F.col("n_chars") / 20000), "y": F.col("toxic")}
    )


DOCS_SQL = "docs as (select *, least(1.0::double, n_chars / 20000::double) as score, toxic as y from documents join labels using (doc_id))"


def _f4(s, d):
    return X.shipments(s, d).withColumns({"truth": F.col("l_extendedprice") / 105000, "prediction": F.col("l_quantity") / 50})


def _reg_sql(keys: str) -> str:
    return f"""with f1 as (select *, year(l_shipdate)::int as batch_id, l_extendedprice / 105000 as y, l_quantity / 50 as p from lineitem)
select {keys}, count(*) as n_samples, round(avg(abs(y - p)), 6) as mae, round(sqrt(avg((y - p) * (y - p))), 6) as rmse,
  round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) as r2, round(avg(p), 6) as mean_pred, round(stddev_pop(p), 6) as std_pred
from f1 group by all"""


def _customer_profile(s, d):
    rows = table(s, d, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")))
    out = A.column_profile(rows, ["c_nationkey", "c_acctbal"], ["c_mktsegment"])
    return rounded(out.withColumn("top_values", F.array_join("top_values", "|")))


def _telemetry_rates(s, d):
    t = table(s, d, "events").withColumns(
        {"day": F.dayofmonth("ts"), "soh": 1 - F.col("value") / 1000, "fault_label": (F.col("value") > 400).cast("int")}
    )
    return rounded(A.base_rates(t, ["day"]))


def batch_metrics(s, d):
    """A small model fleet: one metrics row per supplier and ship year."""
    rows = X.shipments(s, d).groupBy(F.col("l_suppkey").alias("model_id"), "batch_id").agg(
        F.avg("l_discount").alias("_d"), F.avg("l_tax").alias("_t"), F.avg("l_quantity").alias("_q"),
        F.max("l_shipdate").alias("recorded_at"), F.count(F.lit(1)).alias("n_samples"),
    )
    return rows.select(
        (F.col("model_id") * 10000 + F.col("batch_id")).alias("id"),
        "model_id", "batch_id", "recorded_at", "n_samples",
        F.round(0.6 + F.col("_d") * 3.5, 9).alias("auc_roc"),
        F.round(0.5 + F.col("_t") * 5, 9).alias("f1_score"),
        F.round(F.abs(F.col("_q") - 25.5) / 20, 9).alias("drift_score"),
    ).withColumn(
        "drift_severity", F.when(F.col("drift_score") > 0.10, "critical").when(F.col("drift_score") > 0.05, "warning").otherwise("none")
    )


METRICS_SQL = """bm0 as (select l_suppkey as model_id, year(l_shipdate)::int as batch_id, avg(l_discount) as d, avg(l_tax) as t,
    avg(l_quantity) as q, max(l_shipdate) as recorded_at, count(*) as n_samples from lineitem group by all),
bm as (select *, case when drift_score > 0.10 then 'critical' when drift_score > 0.05 then 'warning' else 'none' end as drift_severity
  from (select model_id * 10000 + batch_id as id, model_id, batch_id, recorded_at, n_samples, round(0.6 + d * 3.5, 9) as auc_roc,
    round(0.5 + t * 5, 9) as f1_score, round(abs(q - 25.5) / 20, 9) as drift_score from bm0))"""

LOSS_SQL = """loss as (select *, revenue_at_risk + wasted_outreach as total_monthly_loss, (revenue_at_risk + wasted_outreach) * 12 as total_annual_loss,
    case when auc_drop = 0 then 'healthy' when auc_drop < 0.07 then 'warning' else 'critical' end as roi_status
  from (select *, missed_churners * 0.3::double * 3600::double as revenue_at_risk,
      floor(500 * least(auc_drop * 1.5::double, 0.5::double) * 0.7::double) * 50::double as wasted_outreach
    from (select *, floor(500 * least(auc_drop * 1.8::double, 0.8::double))::bigint as missed_churners
      from (select *, greatest(0::double, 0.87::double - {auc}) as auc_drop from {src}))))"""


def _loss(s, d):
    return B.monthly_loss(batch_metrics(s, d))


def _alert_stream(s, d):
    """Events as alerts: severity from bands of the value."""
    return table(s, d, "events").select(
        F.col("event_id").alias("alert_id"), F.col("event_type").alias("category"), "ts",
        F.when(F.col("value") > 200, "CRITICAL").when(F.col("value") > 50, "WARNING").otherwise("INFO").alias("severity"),
    )


ALERTS_SQL = """al as (select event_id as alert_id, event_type as category, ts,
    case when value > 200 then 'CRITICAL' when value > 50 then 'WARNING' else 'INFO' end as severity from events)"""

QUERIES = {
    "A1_feature_stats": lambda s, d: rounded(
        A.feature_stats(X.gappy(s, d), X.NUMERIC, ["batch_id"]).select("batch_id", "feature", "n", "mean", "std", "p25", "p50", "p75")
    ),
    "A2_reference_stats": lambda s, d: rounded(A.feature_stats(X.gappy(s, d).filter("is_reference"), X.NUMERIC)),
    "A3_window_frequencies": lambda s, d: rounded(A.category_frequencies(X.flags(s, d), X.CATEGORICAL, ["batch_id"])),
    "A3_window_scores": lambda s, d: rounded(A.score_summary(_f3(s, d), "score_b", ["batch_id"])),
    "A4_column_profile": _customer_profile,
    "A5_class_balance": lambda s, d: rounded(A.class_balance(X.shipments(s, d), "l_returnflag", ["batch_id"])),
    "A6_describe": lambda s, d: rounded(A.feature_stats(table(s, d, "orders"), ["o_totalprice", "o_custkey"])),
    "A7_dataset_summary": lambda s, d: rounded(
        A.dataset_summary(
            table(s, d, "events").withColumn("temperature_c", F.hour("ts")).withColumn("soc", F.col("value") / 500),
            temperature="temperature_c", protocol="event_type", soc="soc", source="user_id",
        )
    ),
    "A8_grouped_rate": lambda s, d: rounded(A.grouped_rate(_f3(s, d), "l_linestatus", "y")),
    "A9_top_categories": lambda s, d: A.top_categories(X.flags(s, d), [*X.CATEGORICAL, "l_linenumber"], ["batch_id"]),
    "A10_drift_heatmap": lambda s, d: rounded(
        A.drift_heatmap(D.psi(X.shifted(s, d), X.NUMERIC).withColumn("score", F.col("psi")), range(1996, 2002))
    ),
    "A11_alert_counts": lambda s, d: A.count_by_value(_alert_stream(s, d), "severity", ["CRITICAL", "WARNING", "INFO"], ["category"]),
    "A13_impact_totals": lambda s, d: rounded(A.impact_totals(_loss(s, d), ["model_id"])),
    "A14_run_summary": lambda s, d: rounded(A.run_summary(batch_metrics(s, d), ["auc_roc", "f1_score"], ["model_id"])),
    "A15_base_rates": _telemetry_rates,
    "A16_score_shift": lambda s, d: rounded(A.score_shift(_f3(s, d), "score_b")),
    "A17_latency_summary": lambda s, d: rounded(A.latency_summary(table(s, d, "events"), "value", "ts", ["event_type"])),
    "P16_null_rates": lambda s, d: rounded(A.null_rates(X.gappy(s, d), X.NUMERIC).withColumn("high", F.col("null_rate") > 0.05)),
    "M1_M5_quality_ties": lambda s, d: rounded(M.binary_metrics(_f3(s, d), "y", "score_a", keys=["batch_id"])),
    "M1_M5_quality": lambda s, d: rounded(M.binary_metrics(_f3(s, d), "y", "score_b", keys=["batch_id"])),
    "M1_M5_quality_fault_threshold": lambda s, d: rounded(
        M.binary_metrics(_f3(s, d), "y", "score_b", keys=["l_suppkey"], threshold=0.40)
    ),
    "M1_M5_documents_by_language": lambda s, d: rounded(M.binary_metrics(_docs(s, d), "y", "score", keys=["lang"])),
    "M6_regression": lambda s, d: rounded(M.regression_metrics(_f4(s, d), "truth", "prediction", keys=["batch_id"])),
    "M7_class_report": lambda s, d: rounded(
        M.class_report(_f3(s, d).withColumn("called", (F.col("score_b") >= 0.5).cast("int")), "y", "called", keys=["batch_id"])
    ),
    "M8_regression_slices": lambda s, d: rounded(
        M.regression_metrics(_f4(s, d), "truth", "prediction", keys=["l_linestatus", "l_returnflag"])
    ),
    "M9_baseline_auc": lambda s, d: rounded(M.baseline_auc(_f3(s, d), "y", "score_b", keys=["l_linestatus"])),
    "M10_estimated_auc": lambda s, d: rounded(
        D.psi(X.shifted(s, d), X.NUMERIC).select("batch_id", "feature", M.estimated_auc(F.col("psi")).alias("estimated_auc"))
    ),
    "P14_risk_bands": lambda s, d: _f3(s, d).groupBy("batch_id", B.risk_band(F.col("score_b")).alias("risk")).agg(F.count(F.lit(1)).alias("n")),
    "P15_threshold_classes": lambda s, d: _f3(s, d).groupBy("batch_id").agg(
        F.count_if(F.col("score_b") >= 0.5).alias("n_default"), F.count_if(F.col("score_b") >= 0.4).alias("n_fault")
    ),
    "B1_monthly_loss": lambda s, d: rounded(
        _loss(s, d).select("id", "auc_drop", "missed_churners", "revenue_at_risk", "wasted_outreach", "total_monthly_loss", "total_annual_loss")
    ),
    "B2_status": lambda s, d: _loss(s, d).select("id", "roi_status"),
    "B2_headlines": lambda s, d: _loss(s, d).select("id", "roi_headline"),
    "B3_retrain_value": lambda s, d: rounded(
        B.retrain_value(batch_metrics(s, d), cost=500.0).select(
            "id", "current_loss", "new_loss", "daily_savings", "gross_savings", "npv", "payback_days", "should_retrain"
        )
    ),
    "B4_battery_cost": lambda s, d: rounded(
        B.battery_cost(
            batch_metrics(s, d).select(
                "id", F.col("auc_roc").alias("recall_val"), F.col("f1_score").alias("precision_val"), F.col("drift_score").alias("soh_mae")
            )
        )
    ),
    "B6_loss_bands": lambda s, d: _loss(s, d).groupBy("model_id", B.loss_band(F.col("total_monthly_loss")).alias("band")).agg(
        F.count(F.lit(1)).alias("n")
    ),
}

_F1N = X.ctes("f1", "f1n")
_F3 = X.ctes("f1", "f3")
_L = LONG.format(src="f1n")

from driftloom.plans.drift_queries import psi_sql  # noqa: E402

ORACLE = {
    "A1_feature_stats": f"with {_F1N}, {_L} select * exclude (min, max) from (select batch_id, feature, {STATS_ROUNDED} from long group by all)",
    "A2_reference_stats": f"with {_F1N}, {_L} select feature, {STATS_ROUNDED} from long where is_reference group by all",
    "A3_window_frequencies": f"""with {X.ctes('f1', 'f2')}, c as (select batch_id, feature, category, count(*) as n from (
      unpivot (select batch_id, l_returnflag, l_linestatus from f2) on l_returnflag, l_linestatus into name feature value category) group by all)
      select *, round(n / (sum(n) over (partition by batch_id, feature))::double, 6) as share from c""",
    "A3_window_scores": f"""with {_F3} select batch_id, count(*) as n_rows, round(avg(score_b), 6) as mean_score,
      round(avg((score_b >= 0.7)::int) * 100, 6) as high_risk_pct from f3 group by all""",
    "A4_column_profile": """with c as (select * replace (case when c_acctbal >= 0 then c_acctbal end as c_acctbal) from customer),
      l as (select 'c_nationkey' as column_name, 'int' as dtype, c_nationkey::double as value from c
        union all select 'c_acctbal', 'double', c_acctbal from c),
      n as (select column_name, dtype, count(*) - count(value) as null_count, count(distinct value) as unique_count, round(avg(value), 6) as mean,
        round(stddev_samp(value), 6) as std, min(value) as min, max(value) as max, round(quantile_cont(value, 0.25), 6) as p25,
        round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.75), 6) as p75, null as top_values from l group by all),
      w as (select c_mktsegment, count(*) as k from c group by all)
      select * from n union all by name select 'c_mktsegment' as column_name, 'string' as dtype, 0 as null_count, count(*) as unique_count,
        (select string_agg(c_mktsegment, '|' order by k desc, c_mktsegment) from (select * from w order by k desc, c_mktsegment limit 5)) as top_values from w""",
    "A5_class_balance": f"""with {X.ctes('f1')}, c as (select batch_id, l_returnflag, count(*) as n from f1 group by all)
      select *, round(n / (sum(n) over (partition by batch_id))::double, 6) as share from c""",
    "A6_describe": f"""with long as (unpivot (select o_totalprice::double as o_totalprice, o_custkey::double as o_custkey from orders)
      on o_totalprice, o_custkey into name feature value value) select feature, {STATS_ROUNDED} from long group by all""",
    "A7_dataset_summary": """with t as (select *, hour(ts)::int as temperature_c, value / 500 as soc from events)
      select temperature_c, event_type, count(*) as n_rows, round(min(soc), 6) as soc_min, round(max(soc), 6) as soc_max,
        count(distinct user_id) as n_files, case when grouping(temperature_c) = 1 then 'event_type' else 'temperature_c' end as level
      from t group by grouping sets ((temperature_c), (event_type))""",
    "A8_grouped_rate": f"with {_F3} select l_linestatus, round(avg(y), 6) as rate, count(*) as n from f3 group by all",
    "A9_top_categories": f"""with {X.ctes('f1', 'f2')}, c as (select batch_id, feature, category, count(*) as n from (
      unpivot (select batch_id, l_returnflag, l_linestatus, l_linenumber::varchar as l_linenumber from f2)
      on l_returnflag, l_linestatus, l_linenumber into name feature value category) group by all)
      select batch_id, feature, arg_min(category, (-n, category)) as top_category, count(*) as n_categories from c group by all""",
    "A10_drift_heatmap": "with p as (" + psi_sql("f1s", ("f1", "f1s")) + ") select feature, "
    + ", ".join(f'round(coalesce(avg(psi) filter (batch_id = {y}), 0), 6) as "{y}"' for y in range(1996, 2002))
    + " from p group by all",
    "A11_alert_counts": f"""with {ALERTS_SQL} select category, count(*) as total, count(*) filter (severity = 'CRITICAL') as n_critical,
      count(*) filter (severity = 'WARNING') as n_warning, count(*) filter (severity = 'INFO') as n_info from al group by all""",
    "A13_impact_totals": f"""with {METRICS_SQL}, {LOSS_SQL.format(auc='auc_roc', src='bm')}
      select model_id, sum(total_monthly_loss) as total_loss, max(total_monthly_loss) as worst_loss,
        arg_min(batch_id, (-total_monthly_loss, batch_id)) as worst_batch, sum(missed_churners)::bigint as total_missed,
        arg_max(total_annual_loss, batch_id) as projected_annual_loss from loss group by all""",
    "A14_run_summary": f"""with {METRICS_SQL} select model_id, count(*) as n_batches, round(min(auc_roc), 6) as auc_roc_min,
      round(max(auc_roc), 6) as auc_roc_max, round(min(f1_score), 6) as f1_score_min, round(max(f1_score), 6) as f1_score_max,
      count(*) filter (drift_severity <> 'none') as n_drifted from bm group by all""",
    "A15_base_rates": """select day(ts)::int as day, round(avg(1 - value / 1000), 6) as soh_mean, round(avg((value > 400)::int), 6) as fault_rate
      from events group by all""",
    "A16_score_shift": f"""with {_F3}, r as (select avg(score_b) as m, stddev_pop(score_b) as s from f3 where is_reference)
      select batch_id, round(avg(score_b), 6) as mean_score, round(stddev_pop(score_b), 6) as std_score, round(max(m), 6) as ref_mean,
        round(max(s), 6) as ref_std, round(avg(score_b) - max(m), 6) as mean_shift from f3, r where not is_reference group by all""",
    "A17_latency_summary": """with l as (select event_type, list_sort(list(value)) as v, count(*) as n, avg(value) as mean,
        epoch_us(max(ts)) - epoch_us(min(ts)) as us from events group by all)
      select event_type, n as n_requests, round(mean, 6) as mean, v[1] as min, v[n] as max, round(median, 6) as median, p95, p99,
        upper_median, round(n / (us / 1e6::double), 6) as requests_per_sec, round(1000 / greatest(upper_median, 0.001), 6) as throughput_per_sec
      from (select *, (v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2 as median, v[floor(n * 0.95::double)::bigint + 1] as p95,
        v[floor(n * 0.99::double)::bigint + 1] as p99, v[n // 2 + 1] as upper_median from l)""",
    "P16_null_rates": f"""with {_F1N}, n as (select avg((l_quantity is null)::int) as l_quantity, avg((l_extendedprice is null)::int) as l_extendedprice,
      avg((l_discount is null)::int) as l_discount, avg((l_tax is null or isnan(l_tax))::int) as l_tax from f1n)
      select column_name, round(r, 6) as null_rate, r > 0.05 as high from (unpivot n on * into name column_name value r)""",
    "M1_M5_quality_ties": metric_sql("f3", "score_a", _F3),
    "M1_M5_quality": metric_sql("f3", "score_b", _F3),
    "M1_M5_quality_fault_threshold": metric_sql("f3", "score_b", _F3, "l_suppkey", 0.4),
    "M1_M5_documents_by_language": metric_sql("docs", "score", DOCS_SQL, "lang"),
    "M6_regression": _reg_sql("batch_id"),
    "M8_regression_slices": _reg_sql("l_linestatus, l_returnflag"),
    "M7_class_report": f"""with {_F3}, c as (select batch_id, y, (score_b >= 0.5)::int as p, count(*) as n from f3 group by all),
      k as (select distinct batch_id, unnest([y, p]) as class from c),
      s as (select k.batch_id, k.class, coalesce(sum(n) filter (y = class), 0)::bigint as support, coalesce(sum(n) filter (p = class), 0) as called,
        coalesce(sum(n) filter (y = class and p = class), 0) as tp from k join c using (batch_id) group by all)
      select batch_id, class, round(pr, 6) as precision, round(re, 6) as recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) as f1, support
      from (select *, coalesce(tp / nullif(called, 0)::double, 0) as pr, coalesce(tp / nullif(support, 0)::double, 0) as re from s)""",
    "M9_baseline_auc": f"with {_F3}, ref as (select * from f3 where is_reference),\n"
    + METRIC_CTE.format(k="l_linestatus", s="score_b", src="ref", t=0.5)
    + " select l_linestatus, round(coalesce(auc_roc, 0.87), 6) as baseline_auc from met",
    "M10_estimated_auc": "with q as (" + psi_sql("f1s", ("f1", "f1s")).replace("round(v, 6) as psi", "v as psi")
    + ") select batch_id, feature, round(greatest(0.87 - least(psi * 0.4, 0.15), 0.5), 6) as estimated_auc from q",
    "P14_risk_bands": f"""with {_F3} select batch_id, case when score_b >= 0.7 then 'high' when score_b >= 0.4 then 'medium' else 'low' end as risk,
      count(*) as n from f3 group by all""",
    "P15_threshold_classes": f"with {_F3} select batch_id, count(*) filter (score_b >= 0.5) as n_default, count(*) filter (score_b >= 0.4) as n_fault from f3 group by all",
    "B1_monthly_loss": f"""with {METRICS_SQL}, {LOSS_SQL.format(auc='auc_roc', src='bm')} select id, round(auc_drop, 6) as auc_drop, missed_churners,
      round(revenue_at_risk, 6) as revenue_at_risk, round(wasted_outreach, 6) as wasted_outreach, round(total_monthly_loss, 6) as total_monthly_loss,
      round(total_annual_loss, 6) as total_annual_loss from loss""",
    "B2_status": f"with {METRICS_SQL}, {LOSS_SQL.format(auc='auc_roc', src='bm')} select id, roi_status from loss",
    "B3_retrain_value": f"""with {METRICS_SQL}, {LOSS_SQL.format(auc='auc_roc', src='bm')},
      {LOSS_SQL.format(auc='least(auc_roc + 0.06::double, 0.87::double)', src='bm').replace('loss as', 'later as', 1)},
      v as (select id, loss.total_monthly_loss as current_loss, later.total_monthly_loss as new_loss,
        greatest((loss.total_monthly_loss - later.total_monthly_loss) / 30, 0) as daily from loss join later using (id))
      select id, round(current_loss, 6) as current_loss, round(new_loss, 6) as new_loss, round(daily, 6) as daily_savings,
        round(daily * 30, 6) as gross_savings, round(daily * 30 - 500, 6) as npv,
        case when daily > 0 then ceil(500 / daily)::bigint end as payback_days, daily * 30 - 500 > 0 as should_retrain from v""",
    "B4_battery_cost": f"""with {METRICS_SQL}, b as (select id, auc_roc as recall_val, f1_score as precision_val, drift_score as soh_mae,
        10000 as n, 10000 * 0.02::double / 12 as f from bm),
      c as (select *, f * recall_val / greatest(precision_val, 0.01) - f * recall_val as fp from b)
      select id, round(recall_val, 6) as recall_val, round(precision_val, 6) as precision_val, round(soh_mae, 6) as soh_mae, n as n_cells_monitored,
        round(f, 6) as true_faults_per_month, round(f * recall_val, 6) as faults_detected, round(f * (1 - recall_val), 6) as faults_missed,
        round(fp, 6) as false_positives, round(f * (1 - recall_val) * 7000, 6) as missed_warranty_cost, round(fp * 200, 6) as false_positive_cost,
        round(soh_mae / 0.1 * 50000 * 0.01, 6) as thermal_risk_cost,
        round(f * (1 - recall_val) * 7000 + fp * 200 + soh_mae / 0.1 * 500, 6) as total_monthly_loss_usd,
        round((f * (1 - recall_val) * 7000 + fp * 200 + soh_mae / 0.1 * 500) * 12, 6) as annualized_risk_usd from c""",
    "B6_loss_bands": f"""with {METRICS_SQL}, {LOSS_SQL.format(auc='auc_roc', src='bm')} select model_id,
      case when total_monthly_loss > 50000 then 'critical' when total_monthly_loss > 10000 then 'amber' else 'none' end as band, count(*) as n
      from loss group by all""",
}

# texts round half up from the shortest decimal form; printf would round from the binary value
_HALF_UP = "round(({0})::varchar::decimal(30, 17), {1})::decimal(30, {1})::varchar"
_MONEY = "case when {0} >= 100000 then '₹' || " + _HALF_UP.format("{0} / 100000", 1) + " || 'L' else '₹' || format('{{:,}}', {0}::bigint) end"
_DROP, _AUC = _HALF_UP.format("auc_drop", 4), _HALF_UP.format("auc_roc", 4)
ORACLE["B2_headlines"] = f"""with {METRICS_SQL}, {LOSS_SQL.format(auc='auc_roc', src='bm')},
  m as (select *, {_MONEY.format('total_monthly_loss')} as per_month, {_MONEY.format('total_annual_loss')} as per_year from loss)
  select id, case
    when auc_drop = 0 then 'Model performing at baseline (AUC ' || {_AUC} || '). No measurable revenue impact detected.'
    when auc_drop < 0.03 then 'Minor AUC drop of ' || {_DROP} || ' — est. ' || missed_churners || ' missed churners costing ~' || per_month || '/month. Monitor closely.'
    when auc_drop < 0.07 then 'Moderate AUC degradation (' || {_DROP} || ' drop). Est. ' || per_month
      || '/month in lost revenue + wasted outreach. Schedule retrain this week.'
    else 'CRITICAL: AUC dropped ' || {_DROP} || ' from baseline. Est. ' || per_month || '/month loss (' || per_year || '/year). Retrain immediately.'
    end as roi_headline from m"""
