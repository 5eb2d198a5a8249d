"""Registered drift queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import drift as D
from driftloom.plans import fixtures as X
from driftloom.plans.fixtures import rounded

LONG = """long as (
  select batch_id, is_reference, feature, value from (
    unpivot (select batch_id, is_reference, l_quantity::double as l_quantity, l_extendedprice::double as l_extendedprice,
             l_discount::double as l_discount, l_tax::double as l_tax from {src})
    on l_quantity, l_extendedprice, l_discount, l_tax into name feature value value)
  where value is not null and not isnan(value))"""

PAIRS = """pairs as (
  select b.batch_id, b.feature, false as is_reference, b.value from long b where not is_reference
  union all
  select k.batch_id, r.feature, true, r.value from long r
    join (select distinct batch_id, feature from long where not is_reference) k using (feature) where r.is_reference)"""

CELLS = """lim as (select batch_id, feature, min(value) as lo, max(value) as hi,
    count(*) filter (is_reference) as n_ref, count(*) filter (not is_reference) as n_prod from pairs group by all),
cells as (
  select batch_id, feature, n_bins, n_ref, n_prod,
    len(list_filter(range(1, n_bins), lambda i: i * ((hi - lo) / n_bins::double) + lo <= value)) as bin,
    count(*) filter (is_reference) as c_ref, count(*) filter (not is_reference) as c_prod
  from pairs join lim using (batch_id, feature), (select unnest({bins}) as n_bins)
  group by all)"""

PSI_SQL = """sum((c_prod / n_prod::double + 1e-10 - (c_ref / n_ref::double + 1e-10))
      * ln((c_prod / n_prod::double + 1e-10) / (c_ref / n_ref::double + 1e-10)))"""

JSD_SQL = """sqrt(greatest(0, sum((r * ln(r / ((r + p) / 2)) + p * ln(p / ((r + p) / 2))) / 2)))"""
JSD_CELLS = """shares as (select *, (c_ref / n_ref::double + 1e-10) / (1 + n_bins * 1e-10) as r,
    (c_prod / n_prod::double + 1e-10) / (1 + n_bins * 1e-10) as p from cells)"""

STEPS = """pts as (select batch_id, feature, value, count(*) filter (is_reference) as r, count(*) filter (not is_reference) as p
    from pairs group by all),
steps as (select batch_id, feature, value,
    sum(r) over w / (sum(r) over k)::double as f, sum(p) over w / (sum(p) over k)::double as g,
    (sum(r) over k)::double as n, (sum(p) over k)::double as m, lead(value) over w as nxt
  from pts window k as (partition by batch_id, feature), w as (partition by batch_id, feature order by value))"""

KS_P = """case when d * sqrt(n * m / (n + m)) < 0.2 then 1.0 else greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101),
    lambda k: (case when k % 2 = 1 then 1.0 else -1.0 end)::double * exp(-2.0::double * k * k * pow(d * sqrt(n * m / (n + m)), 2)))))) end"""

SEVERITY = "case when {0} > 0.20 then 'critical' when {0} > 0.10 then 'warning' else 'none' end"


def _with(src: str, base: tuple[str, ...], *parts: str) -> str:
    return "with " + ",\n".join([X.ctes(*base), LONG.format(src=src), PAIRS, *parts]) + "\n"


def psi_sql(src: str, base: tuple[str, ...], bins: str = "[10]") -> str:
    return (
        _with(src, base, CELLS.format(bins=bins),
              f"psi as (select batch_id, feature, n_bins::int as n_bins, {PSI_SQL} as v from cells group by all)")
        + f"select batch_id, feature, n_bins, round(v, 6) as psi, {SEVERITY.format('v')} as severity from psi"
    )


NUMERIC_PARTS = (
    CELLS.format(bins="[10, 20]"),
    JSD_CELLS,
    STEPS,
    f"psi as (select batch_id, feature, {PSI_SQL} as psi from cells where n_bins = 10 group by all)",
    f"jsd as (select batch_id, feature, {JSD_SQL} as jsd from shares where n_bins = 20 group by all)",
    "ks as (select batch_id, feature, max(abs(f - g)) as d, max(n) as n, max(m) as m from steps group by all)",
    "sd as (select feature, stddev_pop(value) as sd from long where is_reference group by all)",
    """wa as (select batch_id, feature, case when max(sd) < 1e-10 then 0.0 else
      coalesce(sum(abs(f - g) * (nxt - value)), 0) / max(sd) end as w from steps join sd using (feature) group by all)""",
    f"ksp as (select *, {KS_P} as ks_p from ks)",
    f"""scores as (select *, {SEVERITY.format('psi')} as by_psi from psi join jsd using (batch_id, feature)
      join ksp using (batch_id, feature) join wa using (batch_id, feature))""",
    """verdict as (select batch_id, feature, psi, d, ks_p, jsd, w, n::bigint as n_ref, m::bigint as n_prod,
      case when m < 100 then 'none' when by_psi = 'none' and ks_p < 0.05 and psi > 0.05 then 'warning' else by_psi end as severity,
      case when m < 100 then 0.0 else psi end as score, case when m >= 100 then ks_p end as p_value from scores)""",
)


def _verdict_columns(df):
    return rounded(
        df.select(
            "batch_id", "feature", "n_ref", "n_prod", "score", "p_value", F.col("ks").alias("ks"), "jsd", "wasserstein",
            "severity", "is_drifted",
        )
    )


def verdict_sql(src: str, base: tuple[str, ...]) -> str:
    return _with(src, base, *NUMERIC_PARTS) + """select batch_id, feature, n_ref, n_prod, round(score, 6) as score,
      round(p_value, 6) as p_value, round(d, 6) as ks, round(jsd, 6) as jsd, round(w, 6) as wasserstein, severity,
      severity <> 'none' as is_drifted from verdict"""


CAT_LONG = """cl as (select batch_id, is_reference, feature, category from (
    unpivot (select batch_id, is_reference, {cols} from {src}) on {cols} into name feature value category)),
kb as (select distinct batch_id, feature from cl where not is_reference),
cc as (select batch_id, feature, category, sum(r)::bigint as r, sum(p)::bigint as p from (
    select batch_id, feature, category, 0 as r, 1 as p from cl where not is_reference
    union all select kb.batch_id, cl.feature, cl.category, 1, 0 from cl join kb using (feature) where cl.is_reference)
  group by all),
filled as (select batch_id, feature, category, case when r = 0 then 1 else r end as r, case when p = 0 then 1 else p end as p from cc),
tot as (select batch_id, feature, sum(r)::double as rr, sum(p)::double as pp, count(*) as k from filled group by all),
cells2 as (select batch_id, feature, k, unnest([r, p])::double as o, unnest([rr * (r + p) / (rr + pp), pp * (r + p) / (rr + pp)]) as e
    from filled join tot using (batch_id, feature)),
chi as (select batch_id, feature, max(k) as k, case when max(k) = 1 then 0.0
      when max(k) = 2 then sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) else sum(pow(o - e, 2) / e) end as chi2
    from cells2 group by all),
ct as (select batch_id, feature, sum(r)::double as rr, sum(p)::double as pp from cc group by all),
merged as (select batch_id, feature, case when r = 0 then '__unseen__' else category::varchar end as cat, sum(r) / max(rr) as r, sum(p) / max(pp) as p
    from cc join ct using (batch_id, feature) group by all),
cj as (select batch_id, feature, sqrt(greatest(0, sum((case when r > 0 then r * ln(r / ((r + p) / 2)) else 0 end
      + case when p > 0 then p * ln(p / ((r + p) / 2)) else 0 end) / 2))) as jsd from merged group by all)"""


# 5 % points of the chi-square law; p < 0.05 exactly when the statistic exceeds them.
CRITICAL = """crit(dof, lim) as (values (1, 3.841458820694124::double), (2, 5.991464547107979::double), (3, 7.814727903251179::double),
    (4, 9.487729036781154::double), (5, 11.070497693516351::double))"""

CAT_VERDICT = f"""{CRITICAL}, cv as (select batch_id, feature, chi2, jsd, chi2 > lim as is_drifted,
    case when chi2 > lim and jsd > 0.10 then 'critical' when chi2 > lim then 'warning' else 'none' end as severity
  from chi join cj using (batch_id, feature) join crit on dof = k - 1)"""


def cat_sql(src: str, base: tuple[str, ...], cols: str) -> str:
    return f"with {X.ctes(*base)}, {CAT_LONG.format(src=src, cols=cols)}\n"


def _report(spark, sf):
    rows = X.shifted(spark, sf)
    return D.batch_report(D.drift_details(D.numeric_drift(rows, X.NUMERIC, with_stats=False), None))


def _full_report(spark, sf):
    rows = X.flags(spark, sf)
    details = D.drift_details(
        D.numeric_drift(rows, X.NUMERIC, with_stats=False), D.categorical_drift(rows, X.CATEGORICAL)
    )
    return rounded(
        D.batch_report(details).select(
            "batch_id", "overall_drift_score", "mean_psi", "n_features", "n_drifted_features", "overall_severity",
            F.array_join("drifted_features", ",").alias("drifted_features"),
        )
    )


def _scenarios(spark, sf):
    """Shipments after 1995 as three named scenarios side by side."""
    gone = F.col("l_returnflag")
    name = F.when(gone == "R", "sudden").when(gone == "A", "gradual").otherwise("none")
    scale = F.when(F.col("is_reference"), 0.0).when(gone == "R", 0.5).when(gone == "A", 0.1 * (F.col("batch_id") - 1995)).otherwise(0.0)
    rows = X.shipments(spark, sf).withColumn("l_extendedprice", F.col("l_extendedprice") * (1 + scale))
    return rows.withColumn("batch_id", F.when(F.col("is_reference"), "reference").otherwise(name))


QUERIES = {
    "D1_psi": lambda s, d: rounded(D.psi(X.shipments(s, d), X.NUMERIC)),
    "D2_psi_severity": lambda s, d: rounded(D.psi(X.shifted(s, d), X.NUMERIC)),
    "D1_psi_with_gaps": lambda s, d: rounded(D.psi(X.gappy(s, d), X.NUMERIC)),
    "D3_ks": lambda s, d: rounded(D.ks(X.shifted(s, d), X.NUMERIC)),
    "D4_jensen_shannon": lambda s, d: rounded(D.jensen_shannon(X.shifted(s, d), X.NUMERIC)),
    "D5_wasserstein": lambda s, d: rounded(D.wasserstein(X.shifted(s, d), X.NUMERIC)),
    "D6_chi_square": lambda s, d: rounded(
        D.categorical_scores(X.flags(s, d), X.CATEGORICAL).select("batch_id", "feature", "chi2", "dof")
    ),
    "D6_chi_square_orders": lambda s, d: rounded(
        D.categorical_scores(X.priorities(s, d), ["o_orderpriority", "o_orderstatus"]).select(
            "batch_id", "feature", "chi2", "dof"
        )
    ),
    "D7_categorical_jsd": lambda s, d: rounded(
        D.categorical_scores(X.flags(s, d), X.CATEGORICAL).select("batch_id", "feature", "jsd")
    ),
    "D7_wide_domain_jsd": lambda s, d: rounded(
        D.categorical_scores(X.shipments(s, d), ["l_suppkey", "l_partkey"]).select("batch_id", "feature", "chi2", "dof", "jsd")
    ),
    "D8_numeric_verdict": lambda s, d: _verdict_columns(
        D.numeric_drift(X.shifted(s, d), X.NUMERIC, with_stats=False)
    ),
    "D9_categorical_verdict": lambda s, d: rounded(
        D.categorical_drift(X.flags(s, d), X.CATEGORICAL).select(
            "batch_id", "feature", "score", "severity", "is_drifted", "n_ref", "n_prod",
            "ref_top_category", "prod_top_category", "ref_categories", "prod_categories",
        )
    ),
    "D10_prediction_drift": lambda s, d: rounded(
        D.prediction_drift(X.scored(s, d), "score_b").select("batch_id", "feature", "psi", "ks", "p_value", "jsd", "severity", "is_drifted")
    ),
    "D11_batch_report": _full_report,
    "D12_drift_details": lambda s, d: rounded(
        D.drift_details(D.numeric_drift(X.shifted(s, d), X.NUMERIC, with_stats=False), None).select(
            "batch_id", "feature", "method", "score", "p_value", "severity", "is_drifted"
        )
    ),
    "D13_psi_bin_sensitivity": lambda s, d: rounded(
        D.psi(X.shifted(s, d), X.NUMERIC, (5, 10, 15, 20, 30, 50))
    ),
    "D14_scenarios": lambda s, d: _verdict_columns(D.numeric_drift(_scenarios(s, d), X.NUMERIC, with_stats=False)),
    "D6_label_drift": lambda s, d: rounded(
        D.label_drift(X.scored(s, d), "y").select("batch_id", "feature", "score", "jsd", "severity", "is_drifted")
    ),
    "D15_messages": lambda s, d: D.numeric_drift(X.shifted(s, d), X.NUMERIC, with_stats=False).select(
        "batch_id", "feature", "message"
    ),
    "J3_aligned_categories": lambda s, d: D.aligned_categories(X.flags(s, d), X.CATEGORICAL),
    "D8_side_statistics": lambda s, d: rounded(D.side_statistics(X.gappy(s, d), X.NUMERIC)),
}

_COLS = "l_returnflag, l_linestatus"
_S = ("f1", "f1s")

ORACLE = {
    "D1_psi": psi_sql("f1", ("f1",)),
    "D2_psi_severity": psi_sql("f1s", _S),
    "D1_psi_with_gaps": psi_sql("f1n", ("f1", "f1n")),
    "D3_ks": _with("f1s", _S, STEPS,
                   "ks as (select batch_id, feature, max(abs(f - g)) as d, max(n) as n, max(m) as m from steps group by all)")
    + f"select batch_id, feature, round(d, 6) as ks, n::bigint as n_ref, m::bigint as n_prod, round({KS_P}, 6) as ks_p from ks",
    "D4_jensen_shannon": _with("f1s", _S, CELLS.format(bins="[20]"), JSD_CELLS)
    + f"select batch_id, feature, round({JSD_SQL}, 6) as jsd from shares group by all",
    "D5_wasserstein": _with("f1s", _S, *NUMERIC_PARTS) + "select batch_id, feature, round(w, 6) as wasserstein from wa",
    "D6_chi_square": cat_sql("f2", ("f1", "f2"), _COLS) + "select batch_id, feature, round(chi2, 6) as chi2, k - 1 as dof from chi",
    "D6_chi_square_orders": cat_sql("f2o", ("f2o",), "o_orderpriority, o_orderstatus")
    + "select batch_id, feature, round(chi2, 6) as chi2, k - 1 as dof from chi",
    "D7_categorical_jsd": cat_sql("f2", ("f1", "f2"), _COLS) + "select batch_id, feature, round(jsd, 6) as jsd from cj",
    "D7_wide_domain_jsd": cat_sql("f1", ("f1",), "l_suppkey, l_partkey")
    + "select batch_id, feature, round(chi2, 6) as chi2, k - 1 as dof, round(jsd, 6) as jsd from chi join cj using (batch_id, feature)",
    "D8_numeric_verdict": verdict_sql("f1s", _S),
    "D9_categorical_verdict": cat_sql("f2", ("f1", "f2"), _COLS).rstrip() + f""", {CAT_VERDICT},
      n as (select batch_id, feature, is_reference, category, count(*) as n from cl group by all),
      t as (select batch_id, feature, is_reference, sum(n)::bigint as n, arg_min(category, (-n, category)) as top, count(*) as k from n group by all)
      select cv.batch_id, feature, round(chi2, 6) as score, severity, is_drifted, r.n as n_ref, p.n as n_prod, r.top as ref_top_category,
        p.top as prod_top_category, r.k as ref_categories, p.k as prod_categories
      from cv join (select * from t where not is_reference) p using (batch_id, feature) join (select * exclude (batch_id) from t where is_reference) r using (feature)""",
    "D11_batch_report": _with("f2", ("f1", "f2"), *NUMERIC_PARTS) + ", " + CAT_LONG.format(src="f2", cols=_COLS) + f""", {CAT_VERDICT},
      d as (select batch_id, feature, score, severity, true as num from verdict union all select batch_id, feature, chi2, severity, false from cv)
      select batch_id, round(avg(score), 6) as overall_drift_score, round(avg(score) filter (num), 6) as mean_psi, count(*) as n_features,
        count(*) filter (severity <> 'none') as n_drifted_features, case when count(*) filter (severity = 'critical') > 0
          or count(*) filter (severity <> 'none') > count(*) * 0.3 then 'critical' when count(*) filter (severity <> 'none') > 0 then 'warning' else 'none' end as overall_severity,
        coalesce(string_agg(feature, ',' order by feature) filter (severity <> 'none'), '') as drifted_features from d group by all""",
    "D10_prediction_drift": "with " + ",\n".join([
        X.ctes("f1", "f3"),
        "long as (select batch_id, is_reference, 'prediction_score' as feature, score_b as value from f3)",
        PAIRS, *NUMERIC_PARTS]) + f"""
      select batch_id, feature, round(psi, 6) as psi, round(d, 6) as ks, round(ks_p, 6) as p_value, round(jsd, 6) as jsd,
        by_psi as severity, by_psi <> 'none' as is_drifted from scores""",
    "D12_drift_details": _with("f1s", _S, *NUMERIC_PARTS) + """select batch_id, feature,
      case when n_prod < 100 then 'PSI' else 'PSI+KS+JSD+Wasserstein' end as method, round(score, 6) as score,
      round(p_value, 6) as p_value, severity, severity <> 'none' as is_drifted from verdict""",
    "D14_scenarios": verdict_sql("sc", ("f1", "sc")),
    "D6_label_drift": cat_sql("f3", ("f1", "f3"), "y").rstrip() + f", {CAT_VERDICT}"
    + " select batch_id, feature, round(chi2, 6) as score, round(jsd, 6) as jsd, severity, is_drifted from cv",
    "D13_psi_bin_sensitivity": psi_sql("f1s", _S, "[5, 10, 15, 20, 30, 50]"),
    "J3_aligned_categories": cat_sql("f2", ("f1", "f2"), _COLS)
    + "select batch_id, feature, category, r as n_ref, p as n_prod from filled",
    "D8_side_statistics": f"with {X.ctes('f1', 'f1n')}, {LONG.format(src='f1n')}" + """
      , st as (select batch_id, feature, is_reference, avg(value) as mean, stddev_samp(value) as std, quantile_cont(value, 0.25) as p25,
        quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.75) as p75 from long group by all)
      select p.batch_id, feature, round(p.mean, 6) as prod_mean, round(p.std, 6) as prod_std, round(p.p25, 6) as prod_p25,
        round(p.p50, 6) as prod_p50, round(p.p75, 6) as prod_p75, round(r.mean, 6) as ref_mean, round(r.std, 6) as ref_std,
        round(r.p25, 6) as ref_p25, round(r.p50, 6) as ref_p50, round(r.p75, 6) as ref_p75
      from st p join st r using (feature) where r.is_reference and not p.is_reference""",
}

ORACLE["D15_messages"] = _with("f1s", ("f1", "f1s"), *NUMERIC_PARTS) + """
  select batch_id, feature, case when n_prod < 100 then printf('Insufficient samples (%d < 100)', n_prod)
    else printf('PSI=%.4f | KS_p=%.4f | JSD=%.4f | Wass=%.4f', psi, ks_p, jsd, w) end as message from verdict"""
