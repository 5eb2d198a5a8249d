"""Registered source, cleaning, split, join and registry queries and their SQL twins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from driftloom.functions import thresholds as T
from driftloom.operators import clean as P
from driftloom.operators import drift as D
from driftloom.operators import profile as A
from driftloom.operators import registry as R
from driftloom.operators import splits as L
from driftloom.operators import windows as W
from driftloom.plans import fixtures as X
from driftloom.plans.drift_queries import psi_sql
from driftloom.plans.fixtures import rounded, table
from driftloom.plans.history_queries import ORDER, TELEMETRY_SQL, telemetry
from driftloom.plans.quality_queries import DOCS_SQL, LOSS_SQL, METRICS_SQL, _docs, _loss, batch_metrics
from driftloom.sources import readers, sinks
from driftloom.sources.stage import new_path
from driftloom.sources.stores import DatasetCatalogue, ModelRegistry

AT = dt.datetime(2024, 1, 1)


# Sources and sinks: the given tables are written in a format and read back ---------


def _customer(s, d):
    return table(s, d, "customer")


def _round_trip_csv(s, d):
    path = new_path(s, "customer-csv")
    sinks.write_csv(_customer(s, d), path)
    return readers.read_csv(s, path, _customer(s, d).schema)


def _round_trip_tsv(s, d):
    path = new_path(s, "orders") + ".tsv"
    table(s, d, "orders").write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_table(s, path, table(s, d, "orders").schema)


def _round_trip_json(s, d):
    path = new_path(s, "events") + ".json"
    rows = table(s, d, "events").select("event_id", "user_id", "event_type", "value", "props")
    sinks.write_json(rows, path)
    return readers.read_json(s, path, rows.schema)


def _parquet_by_temperature(s, d):
    path = new_path(s, "by-temperature")
    rows = telemetry(s, d).select("event_id", "cell_id", F.col("temperature_c").cast("int").alias("temperature_c"))
    sinks.write_parquet(rows, path, ["temperature_c"])
    return readers.read_parquet(s, path)


def _tree(s, d, spoil=None):
    """Events written as folders of CSV files, scanned back as one tree; 'error' folders have a bad name.

    Currents of rows that meet ``spoil`` are written with a unit, which makes them no numbers.
    """
    path = new_path(s, "cycler")
    kind, hour = F.col("test_type"), F.hour("ts")
    rows = telemetry(s, d).select(
        F.col("voltage_v").alias("Voltage(V)"), F.col("current_a").alias("Current(A)"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200).alias("Test_Time(s)"),
        F.lit(0.0).alias("Charge_Capacity(Ah)"), F.col("event_id").cast("double").alias("Discharge_Capacity(Ah)"),
        F.concat(
            F.when(kind == "error", "BAD_").otherwise("SP2_"), F.when(hour < 8, "0").when(hour < 16, "25").otherwise("45"), F.lit("C_"), kind
        ).alias("run"),
        F.when(F.dayofmonth("ts") <= 15, "50SOC").otherwise("80SOC").alias("start"),
    )
    if spoil is not None:
        current = F.col("Current(A)").cast("string")
        rows = rows.withColumn("Current(A)", F.when(spoil, F.concat(current, F.lit(" A"))).otherwise(current))
    sinks.write_csv(rows.repartition("run"), path, ["run", "start"])
    return readers.read_cycler_tree(
        s, path, folder_pattern=r"/run=SP2_(\d+)C_([a-z]+)/", soc_pattern=r"/start=(\d+)SOC/"
    )


def _tree_rows(s, d):
    return rounded(
        _tree(s, d).rows.select(
            F.col("discharge_capacity_ah").cast("long").alias("event_id"), "voltage_v", "current_a", "temperature_c", "test_type", "initial_soc"
        )
    )


def _tree_rejects(s, d):
    return _tree(s, d).rejects.select(F.regexp_extract("reason", r"^([a-z ]+):", 1).alias("reason")).distinct()


def _rejected_files(s, d):
    """Every file of the tree that was skipped, by its folders."""
    folder = [F.regexp_extract("path", f"/{k}=([^/]+)/", 1).alias(k) for k in ("run", "start")]
    return _tree(s, d).rejects.select(*folder, F.regexp_extract("reason", r"^([a-z ]+):", 1).alias("reason"))


def _rejected_cells(s, d):
    """Every cell that is no number: here each current above 2 in size, in the files that are not skipped."""
    found = _tree(s, d, F.abs("Current(A)") > 2).bad_cells
    event = F.element_at(F.split("line", ","), -1).cast("double").cast("long").alias("event_id")
    return found.select(event, "column", F.round(F.regexp_extract("value", "^(.*) A$", 1).cast("double"), 6).alias("value"))


def _tree_charge(s, d):
    """Charge counted per run and start value over the scanned files."""
    rows = _tree(s, d).rows.withColumn("run", F.concat_ws("/", "temperature_c", "test_type", "initial_soc"))
    out = W.coulomb_variable_step(
        rows, cell="run", time="test_time_s", order=["test_time_s", "discharge_capacity_ah"], current="current_a", initial=F.col("initial_soc"), capacity_ah=500.0
    )
    out = P.cycler_features(out)
    return rounded(out.select(F.col("discharge_capacity_ah").cast("long").alias("event_id"), "soc", "cc_capacity_ah"))


def _metric_store(s, d):
    """Batch metrics logged to a registry and read back with the derived model status."""
    store = ModelRegistry(s, new_path(s, "registry"))
    store.register_models(table(s, d, "supplier").select(F.col("s_name").alias("name"), F.lit("1.0.0").alias("version")), AT)
    ids = store.table("models").select("model_id", "name")
    names = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    rows = batch_metrics(s, d).withColumnRenamed("model_id", "k").join(names, "k").join(ids, "name")
    store.log_batch_metrics(rows.drop("id", "k", "name", "recorded_at"), AT)
    return store.fleet_health().select("name", "status", "last_batch_id", "n_batches", "n_retrains", F.round("latest_auc", 6).alias("latest_auc"))


def _snapshot(s, d):
    """Register the customer table twice, augment nothing, and load the latest version."""
    store = DatasetCatalogue(s, new_path(s, "catalogue"))
    first = store.register(_customer(s, d), "customer", target="c_mktsegment", at=AT)
    again = store.register(_customer(s, d), "customer", at=AT + dt.timedelta(days=1))
    if first != again:
        raise AssertionError("a known dataset must keep its id")
    newer = _customer(s, d).withColumn("c_acctbal", F.col("c_acctbal") * 2)
    store.register(newer, "customer", "2.0.0", at=AT + dt.timedelta(days=2))
    return rounded(store.load_latest("customer"))


def _catalogue_stats(s, d):
    store = DatasetCatalogue(s, new_path(s, "catalogue"))
    store.register(table(s, d, "part"), "part", at=AT)
    return rounded(
        store.column_stats("part").select("column_name", "null_count", "unique_count", "mean", "min", "max", F.array_join("top_values", "|").alias("top_values"))
    )


# Cleaning ---------------------------------------------------------------------------


def _raw_battery(s, d):
    """Events under raw column names: current in mA, charge in percent."""
    return telemetry(s, d).select(
        "cell_id", "ts", "event_id",
        (F.col("current_a") * 1000).alias("Current_mA"),
        F.col("voltage_v").alias("Terminal_Voltage"),
        F.nullif("temperature_c", F.lit(10.0)).alias("Temp"),
        ((F.col("voltage_v") - 2.4) * 50).alias("SoC(%)"),
        F.col("cycle_count").alias("Cycle"),
    )


_NORM = ["event_id", "Voltage_V", "Current_A", "Temperature_C", "soc_true", "soh", "fault_label", "cycle_count",
         "capacity_fade_pct", "calendar_age_days", "internal_resistance_mohm", "charge_rate_c", "soc"]


def _normalised(s, d):
    out = P.normalise(_raw_battery(s, d), cell="cell_id", time="ts", order=ORDER)
    return rounded(out.df.select(*_NORM))


def _normalised_counted(s, d):
    """Without a charge column the state of charge is counted; without cycles the health comes from it."""
    raw = _raw_battery(s, d).drop("SoC(%)", "Cycle").withColumn("Current_mA", F.col("Current_mA") * 10)
    out = P.normalise(raw, cell="cell_id", time="ts", order=ORDER, nominal_capacity=0.05, impute=False)
    return rounded(out.df.select("event_id", "Current_A", "soc_true", "soh", "fault_label", "charge_rate_c"))


def _thermal(s, d):
    kind = F.col("test_type")
    chemistry = F.when(kind == "click", "NMC").when(kind == "view", "LFP").otherwise("NCA")
    rows = telemetry(s, d).withColumns(
        {"chemistry": chemistry, "c_rate": F.abs("current_a") * 1.5, "soh": 1 - F.col("temperature_c") / 250}
    )
    out = P.thermal_risk(rows, chemistry="chemistry", temperature="temperature_c", c_rate="c_rate", soh="soh", voltage="voltage_v")
    return rounded(out.select("event_id", "chemistry", "thermal_runaway_risk", "fault_label"))


_RULES = [
    P.Rule("c_acctbal", 0, 9000),
    P.Rule("c_mktsegment", allowed=("BUILDING", "MACHINERY", "HOUSEHOLD")),
    P.Rule("c_nationkey", 1),
]


def _validated(s, d):
    rows = _customer(s, d).withColumn("c_nationkey", F.nullif("c_nationkey", F.lit(3)))
    return P.validate(rows, _RULES).select("c_custkey", F.array_join("violations", "; ").alias("violations"), "is_valid")


# Registry ----------------------------------------------------------------------------


def models(s, d):
    """All suppliers as models, and one idle model per nation."""
    active = table(s, d, "supplier").select(F.col("s_suppkey").alias("model_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("_b"))
    idle = table(s, d, "nation").select((F.col("n_nationkey") + 10_000_000).cast("long").alias("model_id"), F.col("n_name").alias("name"), F.lit(None).cast("double").alias("_b"))
    status = F.when(F.col("_b") > 5000, "healthy").when(F.col("_b") > 0, "warning").when(F.col("_b").isNotNull(), "critical").otherwise("inactive")
    return active.unionByName(idle).select("model_id", "name", F.lit("1.0.0").alias("version"), status.alias("status"), F.lit("").alias("description"))


MODELS_SQL = """models as (select s_suppkey as model_id, s_name as name, s_acctbal as b from supplier
    union all select n_nationkey + 10000000, n_name, null from nation),
mo as (select model_id, name, '1.0.0' as version, case when b > 5000 then 'healthy' when b > 0 then 'warning' when b is not null then 'critical'
    else 'inactive' end as status, '' as description from models)"""


def retrains(s, d):
    return batch_metrics(s, d).filter(F.col("auc_roc") < 0.77).select(
        "model_id", F.col("batch_id").alias("trigger_batch"), F.col("recorded_at").alias("triggered_at"), F.col("auc_roc").alias("old_auc")
    )


def _fleet_metrics(s, d):
    return _loss(s, d).withColumnsRenamed({"total_monthly_loss": "roi_monthly_loss", "missed_churners": "roi_missed_churners"})


def _fleet(s, d):
    return R.fleet_health(models(s, d), _fleet_metrics(s, d), retrains(s, d))


FLEET_SQL = f"""{METRICS_SQL}, {LOSS_SQL.format(auc='auc_roc', src='bm')}, {MODELS_SQL},
last as (select * from loss qualify row_number() over (partition by model_id order by batch_id desc, id desc) = 1),
nb as (select model_id, count(*) as n_batches from loss group by all),
nr as (select model_id, count(*) as n_retrains from loss where auc_roc < 0.77 group by all),
fleet as (select mo.*, auc_roc as latest_auc, f1_score as latest_f1, drift_severity, batch_id as last_batch_id, recorded_at as last_updated,
    total_monthly_loss as roi_monthly_loss, missed_churners as roi_missed_churners, n_batches, coalesce(n_retrains, 0) as n_retrains
  from mo left join last using (model_id) left join nb using (model_id) left join nr using (model_id))"""


def _status_rows(s, d):
    rows = batch_metrics(s, d).withColumn(
        "custom",
        F.when(F.col("model_id") > 50, F.create_map(F.lit("auc_warning"), F.lit(0.78), F.lit("f1_floor"), F.lit(0.4))),
    )
    thresholds = R.merged_thresholds(F.col("custom"))
    return rounded(
        rows.select(
            "id", R.model_status(F.col("auc_roc"), F.col("drift_severity"), thresholds).alias("status"),
            F.element_at(thresholds, "auc_warning").alias("auc_warning"), F.size(thresholds).alias("n_thresholds"),
        )
    )


def _registrations(s, d):
    """Customers named like models, two versions each; segments already known are skipped."""
    rows = _customer(s, d).select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("version"))
    known = rows.filter(F.col("version") == "BUILDING").select(F.lit(7).cast("long").alias("model_id"), "name", "version")
    return R.new_registrations(known, rows)


def _order_states(s, d):
    """Customer state = state of the newest order, 'P' counting as deleted."""
    events = table(s, d, "orders").select(
        F.col("o_custkey").alias("dataset_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq")
    )
    return R.current_state(events, keys=["dataset_id"], at="at", tie="seq", gone="P")


def catalogue(s, d):
    """Suppliers as datasets: columns and tags follow from their rows."""
    return table(s, d, "supplier").select(
        F.col("s_suppkey").alias("dataset_id"), F.concat(F.lit("set_"), F.col("s_nationkey").cast("string")).alias("name"),
        F.col("s_name").alias("version"), F.when(F.col("s_acctbal") > 3000, "battery").otherwise("custom").alias("domain"),
        F.when(F.col("s_acctbal") > 0, "active").otherwise("archived").alias("status"), F.col("s_name").alias("file_path"),
        F.col("s_acctbal").alias("registered_at"),
        F.array_compact(F.array(F.lit("soc"), F.when(F.col("s_acctbal") > 2000, F.lit("soh")), F.when(F.col("s_acctbal") > 6000, F.lit("voltage")))).alias("columns"),
        R.parse_tags(F.concat(F.lit("team = ds , nation="), F.col("s_nationkey").cast("string"), F.lit(",junk"))).alias("tags"),
    )


CATALOGUE_SQL = """cat as (select s_suppkey as dataset_id, 'set_' || s_nationkey as name, s_name as version, s_nationkey,
    case when s_acctbal > 3000 then 'battery' else 'custom' end as domain, case when s_acctbal > 0 then 'active' else 'archived' end as status,
    s_acctbal as registered_at, s_acctbal from supplier)"""


def _stats_join(s, d):
    stats = A.feature_stats(X.shipments(s, d), X.NUMERIC, ["l_suppkey"]).select(
        F.col("l_suppkey").alias("dataset_id"), F.col("feature").alias("column_name"), "n", F.col("max")
    )
    out = R.with_column_stats(catalogue(s, d), stats)
    return rounded(out.select("dataset_id", "name", F.size("column_stats").alias("n_columns"),
                              F.aggregate("column_stats", F.lit(0.0), lambda a, x: a + x["max"]).alias("sum_max")))


QUERIES = {
    "S1_csv": _round_trip_csv,
    "S2_tsv": _round_trip_tsv,
    "S3_parquet": lambda s, d: readers.read_table(s, f"{d}/supplier.parquet"),
    "S4_S8_cycler_tree": _tree_rows,
    "S5_cycler_rejects": _tree_rejects,
    "S5_rejected_files": _rejected_files,
    "S5_rejected_cells": _rejected_cells,
    "S4_cycler_charge": _tree_charge,
    "S6_S7_json": _round_trip_json,
    "S9_S10_snapshots": _snapshot,
    "S9_catalogue_stats": _catalogue_stats,
    "S10_latest_version": lambda s, d: rounded(R.latest_version(catalogue(s, d), "registered_at")),
    "S11_metric_store": _metric_store,
    "S12_by_temperature": _parquet_by_temperature,
    "S13_registrations": _registrations,
    "S14_current_state": _order_states,
    "P1_P8_normalised": _normalised,
    "P3_P5_counted_charge": _normalised_counted,
    # one multiplication of equal operands: compared unrounded
    "P8_cycler_features": lambda s, d: P.cycler_features(telemetry(s, d)).select("event_id", "power_w", "temperature_degc"),
    "P9_thermal_risk": _thermal,
    "P10_validation": _validated,
    "P11_labelled": lambda s, d: P.labelled(
        table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels"), "doc_id", "left"), "toxic"
    ).select("doc_id", "lang", "toxic"),
    "P12_filters": lambda s, d: table(s, d, "part").filter(
        F.col("p_size").isin(5, 11, 28) & F.col("p_name").startswith("red") | F.col("p_type").contains("ECON")
    ).select("p_partkey", "p_name", "p_type", "p_size"),
    "P13_catalogue_list": lambda s, d: R.list_datasets(catalogue(s, d), domain="battery", tags={"team": "ds"}).select("dataset_id", "name", "domain", "status"),
    "P17_median_imputation": lambda s, d: rounded(
        P.impute_median(X.gappy(s, d), ["l_quantity", "l_tax"]).groupBy("batch_id").agg(F.sum("l_quantity").alias("quantity"), F.sum("l_tax").alias("tax"), F.count(F.lit(1)).alias("n"))
    ),
    "P18_feature_selection": lambda s, d: P.select_features(telemetry(s, d), ["event_id", "voltage_v", "absent", "cycle_count"]).select(
        "event_id", F.round("voltage_v", 6).alias("voltage_v"), "cycle_count"
    ),
    "P19_model_status": _status_rows,
    "P19_regression_status": lambda s, d: batch_metrics(s, d).select(
        "id", R.regression_status(F.col("drift_score"), F.lit("none"), R.thresholds_map(T.TASK_THRESHOLDS["regression"])).alias("status")
    ),
    "J1_latest_batch": lambda s, d: rounded(R.latest_batch(batch_metrics(s, d)).select("model_id", "batch_id", "id", "auc_roc")),
    "J2_fleet_counts": lambda s, d: _fleet(s, d).select("model_id", "n_batches", "n_retrains"),
    "J4_split_members": lambda s, d: L.members_of(
        telemetry(s, d), L.split_by_cycle(telemetry(s, d).select("cycle_count").distinct(), "cycle_count"), "cycle_count", "val"
    ).select("event_id", "cycle_count"),
    "J5_compatible_datasets": lambda s, d: R.compatible_datasets(catalogue(s, d), ["soh", "soc"]).select("dataset_id", "name"),
    "J7_catalogue_stats": _stats_join,
    "B7_T5_fleet_health": lambda s, d: rounded(_fleet(s, d)),
    "A12_fleet_status": lambda s, d: A.count_by_value(_fleet(s, d), "status", ["healthy", "warning", "critical", "inactive"]),
    "T2_model_history": lambda s, d: rounded(R.model_history(batch_metrics(s, d), 3).select("model_id", "batch_id", "auc_roc")),
    "T3_latest_drift": lambda s, d: rounded(
        R.latest_drift(D.psi(X.shifted(s, d), X.NUMERIC).withColumn("score", F.col("psi"))).select("batch_id", "feature", "score")
    ),
    "T4_retrain_history": lambda s, d: rounded(R.retrain_history(retrains(s, d)).select("model_id", "trigger_batch", "old_auc")),
    "T4_drift_history": lambda s, d: rounded(
        R.drift_history(D.psi(X.shifted(s, d), X.NUMERIC), batch_id=1999).select("batch_id", "feature", "psi", "severity")
    ),
    "T7_highest_risk": lambda s, d: rounded(
        X.scored(s, d).groupBy("batch_id").agg(
            F.max_by(F.struct("l_orderkey", "l_linenumber", "score_b"), F.struct("score_b", "l_orderkey", "l_linenumber")).alias("_m")
        ).select("batch_id", "_m.*")
    ),
    "U1_union": lambda s, d: rounded(
        L.union_all(
            _customer(s, d).select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), "c_mktsegment"),
            table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")),
        )
    ),
    "U2_recent_batches": lambda s, d: L.recent_batches(X.shipments(s, d), trigger=2000, keep=4).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")),
    "U3_category_domain": lambda s, d: D.aligned_categories(X.flags(s, d), X.CATEGORICAL).select("feature", "category").distinct(),
    "L9_stratified_split": lambda s, d: L.stratified_split(_docs(s, d), key=["doc_id"], strata="toxic").select("doc_id", "toxic", "split"),
    "L10_split_by_cycle": lambda s, d: L.split_by_cycle(telemetry(s, d), "cycle_count").select("event_id", "cycle_count", "split"),
    "L10_split_by_position": lambda s, d: L.split_by_position(
        telemetry(s, d), order=ORDER, shares={"train": 0.70, "val": 0.15}, rest="test"
    ).select("event_id", "split"),
    "L11_split_by_protocol": lambda s, d: L.split_by_value(telemetry(s, d), "test_type", test=["error"]).select("event_id", "test_type", "split"),
    "L11_split_by_temperature": lambda s, d: L.split_by_value(
        telemetry(s, d), "temperature_c", test=[0.0], train=[25.0, 45.0]
    ).select("event_id", "split"),
    "L11_hold_out_last": lambda s, d: L.hold_out_last(
        telemetry(s, d), order=ORDER
    ).select("event_id", "split"),
    "L15_augmented": lambda s, d: rounded(
        L.augment(_customer(s, d), numeric=["c_acctbal"], keep=["c_custkey"], n=500, key=["c_custkey"]).groupBy("is_augmented").agg(
            F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("mean"), F.stddev_samp("c_acctbal").alias("std")
        )
    ),
}

_NORM_SQL = f"""{TELEMETRY_SQL}, raw as (select *, current_a * 1000 as ma, (voltage_v - 2.4) * 50 as pct, nullif(temperature_c, 10) as heat from tel),
pk as (select max(abs(ma)) as pi, max(pct) as ps, max(cycle_count) as pc, quantile_cont(heat, 0.5) as mt from raw),
n0 as (select *, case when pi > 200 then ma / 1000 else ma end as amp,
    greatest(0.0, least(1.0, case when ps > 1.5 then pct / 100 else pct end)) as s from raw, pk),
n1 as (select *, greatest(0.5, least(1.0, 1.0 - 0.0002::double * cycle_count)) as h from n0)"""

ORACLE = {
    "S1_csv": "select * from customer",
    "S2_tsv": "select * from orders",
    "S3_parquet": "select * from supplier",
    "S4_S8_cycler_tree": f"""with {TELEMETRY_SQL} select event_id, round(voltage_v, 6) as voltage_v, round(current_a, 6) as current_a, case when hour(ts) < 8 then 0 when hour(ts) < 16 then 25 else 45 end as temperature_c,
      upper(test_type) as test_type, case when day(ts) <= 15 then 0.5 else 0.8 end::double as initial_soc from tel where test_type <> 'error'""",
    "S5_rejected_files": """select distinct concat('BAD_', case when hour(ts) < 8 then 0 when hour(ts) < 16 then 25 else 45 end, 'C_error') as run,
      case when day(ts) <= 15 then '50SOC' else '80SOC' end as start, 'folder name' as reason from events where event_type = 'error'""",
    "S5_rejected_cells": f"""with {TELEMETRY_SQL} select event_id, 'Current(A)' as column, round(current_a, 6) as value from tel where test_type <> 'error' and abs(current_a) > 2""",
    "S5_cycler_rejects": "select distinct 'folder name' as reason from events where event_type = 'error'",
    "S4_cycler_charge": f"""with {TELEMETRY_SQL}, t as (select *, case when hour(ts) < 8 then 0 when hour(ts) < 16 then 25 else 45 end as h, sec - 1704067200 as t,
        case when day(ts) <= 15 then 0.5 else 0.8 end::double as s0 from tel where test_type <> 'error'),
      dq as (select *, current_a * coalesce(greatest(0, t - lag(t) over w), 0) / 3600 as dq from t window w as (partition by h, test_type, s0 order by t, event_id)),
      q as (select *, sum(dq) over (partition by h, test_type, s0 order by t, event_id rows unbounded preceding) as q from dq)
      select event_id, round(greatest(0.0, least(1.0, s0 + q / 500)), 6) as soc, round(q, 6) as cc_capacity_ah from q""",
    "S6_S7_json": "select event_id, user_id, event_type, value, props from events",
    "S9_S10_snapshots": "select * replace (round(c_acctbal * 2, 6) as c_acctbal) from customer",
    "S9_catalogue_stats": """with n as (select column_name, 0 as null_count, count(distinct v) as unique_count, round(avg(v), 6) as mean, min(v) as min, max(v) as max, null as top_values from (
        unpivot (select p_partkey::double as p_partkey, p_size::double as p_size, p_retailprice::double as p_retailprice from part) on * into name column_name value v) group by all),
      t as (select column_name, v, count(*) as k from (unpivot (select p_name, p_brand, p_type from part) on * into name column_name value v) group by all),
      r as (select *, row_number() over (partition by column_name order by k desc, v) as r from t)
      select * from n union all by name select column_name, 0 as null_count, count(*) as unique_count,
        string_agg(v, '|' order by r) filter (r <= 5) as top_values from r group by all""",
    "S10_latest_version": f"""with {CATALOGUE_SQL} select name, version, round(registered_at, 6) as registered_at from cat
      qualify row_number() over (partition by name order by registered_at desc, dataset_id desc) = 1""",
    "S11_metric_store": f"""with {METRICS_SQL}, l as (select *, row_number() over (partition by model_id order by batch_id desc) as r,
        count(*) over (partition by model_id) as n from bm)
      select s_name as name, case when r is null then 'inactive' when auc_roc < 0.7 or drift_severity = 'critical' then 'critical'
        when auc_roc < 0.8 or drift_severity = 'warning' then 'warning' else 'healthy' end as status, batch_id as last_batch_id,
        n as n_batches, 0 as n_retrains, round(auc_roc, 6) as latest_auc from supplier left join (select * from l where r = 1) on s_suppkey = model_id""",
    "S12_by_temperature": "select event_id, user_id as cell_id, (props->>'$.k')::int as temperature_c from events",
    "S13_registrations": """with f as (select distinct c_name as name, c_mktsegment as version from customer where c_mktsegment <> 'BUILDING')
      select name, version, (case when (select count(*) from customer where c_mktsegment = 'BUILDING') > 0 then 7 else 0 end)
        + row_number() over (order by md5(name || '|' || version), name, version) as model_id from f""",
    "S14_current_state": """with e as (select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)
      select o_custkey as dataset_id, o_orderstatus as status, o_orderdate as at, o_orderkey as seq from e where o_orderstatus <> 'P'""",
    "P1_P8_normalised": f"""with {_NORM_SQL} select event_id, round(voltage_v, 6) as "Voltage_V", round(amp, 6) as "Current_A", round(coalesce(heat, mt), 6) as "Temperature_C",
      round(s, 6) as soc_true, round(h, 6) as soh, (coalesce(voltage_v < 2.5 or voltage_v > 4.2 or heat > 45 or h < 0.7, false))::int as fault_label,
      cycle_count::double as cycle_count, round((1 - h) * 100, 6) as capacity_fade_pct, floor(cycle_count * 1.5)::int as calendar_age_days,
      round(10.0 + cycle_count * 0.0003, 6) as internal_resistance_mohm, round(greatest(0.1, least(5.0, abs(amp) / 2.5)), 6) as charge_rate_c, round(s, 6) as soc from n1""",
    "P3_P5_counted_charge": f"""with {TELEMETRY_SQL}, r as (select *, max(abs(current_a * 10000)) over () as pk from tel),
      a as (select *, case when pk > 200 then current_a * 10000 / 1000 else current_a * 10000 end as amp from r),
      c as (select *, greatest(0.0, least(1.0, 1 + sum(amp) over (partition by cell_id order by ts, event_id rows unbounded preceding) / 180)) as s from a),
      h as (select *, greatest(0.5, least(1.0, 1 - (1 - s) * 0.1)) as h from c)
      select event_id, round(amp, 6) as "Current_A", round(s, 6) as soc_true, round(h, 6) as soh,
        (coalesce(voltage_v < 2.5 or voltage_v > 4.2 or nullif(temperature_c, 10) > 45 or h < 0.7, false))::int as fault_label,
        round(greatest(0.1, least(5.0, abs(amp) / 0.05)), 6) as charge_rate_c from h""",
    "P8_cycler_features": f"with {TELEMETRY_SQL} select event_id, voltage_v * current_a as power_w, temperature_c as temperature_degc from tel",
    "P9_thermal_risk": f"""with {TELEMETRY_SQL}, c as (select *, case test_type when 'click' then 'NMC' when 'view' then 'LFP' else 'NCA' end as chemistry,
        abs(current_a) * 1.5 as c_rate, 1 - temperature_c / 250 as soh from tel),
      l(chemistry, vmax, vmin, tmax) as (values ('NMC', 4.2, 2.8, 45.0), ('LFP', 3.65, 2.5, 55.0), ('NCA', 4.18, 2.7, 40.0)),
      r as (select *, greatest(0, least(1, greatest(0, (temperature_c - tmax) / 20) * 0.5 + greatest(0, c_rate - 2) / 3 * 0.3
        + greatest(0, 1 - soh - 0.3) * 0.2)) as risk from c join l using (chemistry))
      select event_id, chemistry, round(risk, 6) as thermal_runaway_risk,
        (risk > 0.1 or soh < 0.7 or voltage_v < vmin or voltage_v > vmax)::int as fault_label from r""",
    "P10_validation": """with c as (select * replace (nullif(c_nationkey, 3) as c_nationkey) from customer),
      v as (select c_custkey, list_filter([case when c_acctbal < 0 then 'c_acctbal: below 0' end, case when c_acctbal > 9000 then 'c_acctbal: above 9000' end,
        case when c_mktsegment not in ('BUILDING', 'MACHINERY', 'HOUSEHOLD') then 'c_mktsegment: not allowed' end,
        case when c_nationkey is null then 'c_nationkey: missing' end, case when c_nationkey < 1 then 'c_nationkey: below 1' end], lambda x: x is not null) as l from c)
      select c_custkey, array_to_string(l, '; ') as violations, len(l) = 0 as is_valid from v""",
    "P11_labelled": "select doc_id, lang, toxic from documents join labels using (doc_id) where toxic is not null",
    "P12_filters": "select p_partkey, p_name, p_type, p_size from part where p_size in (5, 11, 28) and starts_with(p_name, 'red') or contains(p_type, 'ECON')",
    "P13_catalogue_list": f"with {CATALOGUE_SQL} select dataset_id, name, domain, status from cat where domain = 'battery' and status = 'active'",
    "P17_median_imputation": f"""with {X.ctes('f1', 'f1n')}, m as (select quantile_cont(l_quantity, 0.5) as q, quantile_cont(case when not isnan(l_tax) then l_tax end, 0.5) as t from f1n)
      select batch_id, round(sum(coalesce(l_quantity, q)), 6) as quantity, round(sum(case when isnan(l_tax) then t else l_tax end), 6) as tax, count(*) as n from f1n, m group by all""",
    "P18_feature_selection": f"with {TELEMETRY_SQL} select event_id, round(voltage_v, 6) as voltage_v, cycle_count from tel",
    "P19_model_status": f"""with {METRICS_SQL}, t as (select *, case when model_id > 50 then 0.78 else 0.80 end::double as auc_warning from bm)
      select id, case when auc_roc < 0.7 or drift_severity = 'critical' then 'critical' when auc_roc < auc_warning or drift_severity = 'warning' then 'warning'
        else 'healthy' end as status, auc_warning, case when model_id > 50 then 6 else 5 end as n_thresholds from t""",
    "P19_regression_status": f"""with {METRICS_SQL} select id, case when drift_score > 0.10 then 'critical' when drift_score > 0.05 then 'warning' else 'healthy' end as status from bm""",
    "J1_latest_batch": f"""with {METRICS_SQL} select model_id, batch_id, id, round(auc_roc, 6) as auc_roc from bm
      qualify row_number() over (partition by model_id order by batch_id desc, id desc) = 1""",
    "J2_fleet_counts": f"with {FLEET_SQL} select model_id, n_batches, n_retrains from fleet",
    "J4_split_members": f"""with {TELEMETRY_SQL}, c as (select *, row_number() over (order by cycle_count) - 1 as i, count(*) over () as n from (select distinct cycle_count from tel))
      select event_id, cycle_count from tel where cycle_count in (select cycle_count from c where i >= floor(n * 0.7) and i < floor(n * 0.7) + floor(n * 0.15))""",
    "J5_compatible_datasets": f"with {CATALOGUE_SQL} select dataset_id, name from cat where s_acctbal > 2000",
    "J7_catalogue_stats": f"""with {CATALOGUE_SQL}, m as (select l_suppkey as dataset_id, max(l_quantity) + max(l_extendedprice) + max(l_discount) + max(l_tax) as v from lineitem group by all)
      select dataset_id, name, case when v is not null then 4 end as n_columns, round(v, 6) as sum_max from cat left join m using (dataset_id)""",
    "B7_T5_fleet_health": f"""with {FLEET_SQL} select * replace (round(latest_auc, 6) as latest_auc, round(latest_f1, 6) as latest_f1, round(roi_monthly_loss, 6) as roi_monthly_loss) from fleet""",
    "A12_fleet_status": f"""with {FLEET_SQL} select count(*) as total, count(*) filter (status = 'healthy') as n_healthy, count(*) filter (status = 'warning') as n_warning,
      count(*) filter (status = 'critical') as n_critical, count(*) filter (status = 'inactive') as n_inactive from fleet""",
    "T2_model_history": f"""with {METRICS_SQL} select model_id, batch_id, round(auc_roc, 6) as auc_roc from bm
      qualify row_number() over (partition by model_id order by batch_id desc, id desc) <= 3""",
    "T3_latest_drift": "with p as (" + psi_sql("f1s", ("f1", "f1s")) + ") select batch_id, feature, psi as score from p where batch_id = (select max(batch_id) from p)",
    "T4_retrain_history": f"with {METRICS_SQL} select model_id, batch_id as trigger_batch, round(auc_roc, 6) as old_auc from bm where auc_roc < 0.77",
    "T4_drift_history": "with p as (" + psi_sql("f1s", ("f1", "f1s")) + ") select batch_id, feature, psi, severity from p where batch_id = 1999",
    "T7_highest_risk": f"""with {X.ctes('f1', 'f3')} select batch_id, l_orderkey, l_linenumber, round(score_b, 6) as score_b from f3
      qualify row_number() over (partition by batch_id order by score_b desc, l_orderkey desc, l_linenumber desc) = 1""",
    "U1_union": """select c_custkey as key, c_acctbal as balance, c_mktsegment from customer union all by name select s_suppkey as key, s_acctbal as balance from supplier""",
    "U2_recent_batches": f"with {X.ctes('f1')} select batch_id, count(*) as n from f1 where batch_id between 1997 and 2000 group by all",
    "U3_category_domain": f"""with {X.ctes('f1', 'f2')} select distinct feature, category from (unpivot (select l_returnflag, l_linestatus from f2)
      on l_returnflag, l_linestatus into name feature value category)""",
    "L9_stratified_split": f"""with {DOCS_SQL}, r as (select doc_id, toxic, row_number() over (partition by toxic order by md5('42|' || doc_id), doc_id) as r,
        count(*) over (partition by toxic) as n from docs) select doc_id, toxic, case when r <= floor(n * 0.2::double) then 'test' else 'train' end as split from r""",
    "L10_split_by_cycle": f"""with {TELEMETRY_SQL}, c as (select *, row_number() over (order by cycle_count) - 1 as i, count(*) over () as n from (select distinct cycle_count from tel))
      select event_id, cycle_count, case when i < floor(n * 0.7::double) then 'train' when i < floor(n * 0.7::double) + floor(n * 0.15::double) then 'val' else 'test' end as split
      from tel join c using (cycle_count)""",
    "L10_split_by_position": """with r as (select event_id, row_number() over (order by ts, event_id) as r, count(*) over () as n from events)
      select event_id, case when r <= floor(n * 0.7::double) then 'train' when r <= floor(n * 0.7::double) + floor(n * 0.15::double) then 'val' else 'test' end as split from r""",
    "L11_split_by_protocol": f"with {TELEMETRY_SQL} select event_id, test_type, case when test_type = 'error' then 'test' else 'train' end as split from tel",
    "L11_split_by_temperature": f"with {TELEMETRY_SQL} select event_id, case when temperature_c = 0 then 'test' else 'train' end as split from tel where temperature_c in (0, 25, 45)",
    "L11_hold_out_last": """with r as (select event_id, row_number() over (order by ts, event_id) as r, count(*) over () as n from events)
      select event_id, case when r > n - floor(n * 0.15::double) then 'val' else 'train' end as split from r""",
}
