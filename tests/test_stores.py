"""Registry, catalogue and readers."""

import gzip
import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftloom.operators import clean as P
from driftloom.operators import registry as R
from driftloom.sources import readers, sinks
from driftloom.sources.stores import DatasetCatalogue, ModelRegistry

DAY = dt.datetime(2024, 3, 1)


def later(n):
    return DAY + dt.timedelta(days=n)


@pytest.fixture
def registry(spark, tmp_path):
    return ModelRegistry(spark, str(tmp_path / "registry"))


def metrics(spark, rows):
    return spark.createDataFrame(rows, "model_id bigint, batch_id bigint, auc_roc double, drift_severity string")


def test_registration_is_idempotent(registry):
    a = registry.register_model("churn", "1.0.0", thresholds={"auc_warning": 0.9}, tags={"team": "ds"}, at=DAY)
    assert registry.register_model("churn", "1.0.0", at=later(1)) == a
    b = registry.register_model("churn", "1.1.0", at=later(1))
    assert b == a + 1
    rows = registry.models().collect()
    assert [r["model_id"] for r in rows] == [a, b] and {r["status"] for r in rows} == {"inactive"}
    assert rows[0]["thresholds"] == {"auc_warning": 0.9, "auc_critical": 0.7, "f1_warning": 0.75, "psi_warning": 0.1, "psi_critical": 0.2}
    registry.update_status(a, "healthy", later(2))
    assert registry.models().filter(F.col("model_id") == a).first()["status"] == "healthy"


@pytest.mark.parametrize("auc,severity,status", [(0.78, "none", "warning"), (0.65, "none", "critical"), (0.88, "none", "healthy"),
                                                 (0.88, "warning", "warning"), (0.88, "critical", "critical"), (None, "none", "healthy")])
def test_status_follows_metrics(registry, spark, auc, severity, status):
    m = registry.register_model("m", at=DAY)
    registry.log_batch_metrics(metrics(spark, [(m, 1, auc, severity)]), later(1))
    assert registry.models().first()["status"] == status


def test_histories(registry, spark):
    m, idle = registry.register_model("m", at=DAY), registry.register_model("idle", at=DAY)
    aucs = [0.87, 0.84, 0.81, 0.73]
    for i, a in enumerate(aucs):
        registry.log_batch_metrics(metrics(spark, [(m, i, a, "none")]), later(i))
    assert [r["auc_roc"] for r in registry.model_history(m).collect()] == aucs
    assert [r["batch_id"] for r in registry.model_history(m, last_n=3).collect()] == [1, 2, 3]
    assert registry.table("batch_metrics").select("id").distinct().count() == 4
    registry.log_drift_details(spark.createDataFrame([(m, b, f, 0.1) for b in (1, 2) for f in "ab"], "model_id bigint, batch_id bigint, feature string, score double"))
    assert registry.drift_history(m, 2).count() == 2 and registry.drift_history(m).count() == 4
    registry.log_retrain_events(spark.createDataFrame([(m, 3, 0.73, 0.8, True)], "model_id bigint, trigger_batch bigint, old_auc double, new_auc double, promoted boolean"), later(4))
    assert registry.retrain_history(m).count() == 1
    fleet = {r["model_id"]: r for r in registry.fleet_health().collect()}
    assert (fleet[m]["latest_auc"], fleet[m]["n_batches"], fleet[m]["n_retrains"]) == (0.73, 4, 1)
    assert (fleet[idle]["latest_auc"], fleet[idle]["n_batches"], fleet[idle]["n_retrains"]) == (None, None, 0)


def test_fleet_export(registry, spark, tmp_path):
    registry.register_model("m", at=DAY)
    registry.export_fleet(str(tmp_path / "fleet"))
    assert readers.read_json(spark, str(tmp_path / "fleet")).first()["name"] == "m"


def test_catalogue_life_cycle(spark, tmp_path):
    store = DatasetCatalogue(spark, str(tmp_path / "catalogue"))
    rows = [(i, float(i) if i % 5 else None, "ab"[i % 2], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x double, kind string, y int").withColumn("Unnamed: 0", F.lit(1))
    first = store.register(df, "cells", domain="battery", tags={"lab": "a"}, target="y", at=DAY)
    assert store.register(df, "cells", at=later(1)) == first
    loaded = store.load("cells")
    assert "Unnamed: 0" not in loaded.columns and loaded.filter("x is null").count() == 0
    stats = {r["column_name"]: r for r in store.column_stats("cells").collect()}
    assert stats["kind"]["top_values"] == ["a", "b"] and stats["x"]["unique_count"] == 33 and stats["x"]["null_count"] == 0
    assert store.table("class_balance").count() == 2
    assert store.null_report(df, 0.1).first()["column_name"] == "x"

    second = store.register(df.filter("id < 10"), "cells", overwrite=True, at=later(2))
    assert second != first and store.load("cells").count() == 10 and store.datasets().count() == 1
    store.register(df, "cells", "2.0.0", domain="battery", tags={"lab": "b"}, at=later(3))
    assert store.load_latest("cells").count() == 40
    assert store.list("battery").count() == 1 and store.list(tags={"lab": "a"}).count() == 0 and store.list(tags={"lab": "b"}).count() == 1
    assert store.find_compatible(["x", "kind"]).count() == 2 and store.find_compatible(["nope"]).count() == 0
    assert all(len(r["column_stats"]) == 4 for r in store.info().collect())
    store.archive("cells", "2.0.0", later(4))
    assert store.list().count() == 1 and store.list(status="archived").count() == 1
    store.delete("cells", "1.0.0", later(5))
    with pytest.raises(KeyError):
        store.load("cells", "1.0.0")


def test_augmentation_keeps_keys_and_labels(spark, tmp_path):
    store = DatasetCatalogue(spark, str(tmp_path / "catalogue"))
    df = spark.range(20).select("id", (F.col("id") * 1.5).alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    store.register(df, "d", target="y", at=DAY)
    store.augment("d", n=50, key=["id"], at=later(1))
    rows = store.load("d", "1.0.0-aug")
    assert rows.count() == 70 and rows.select("id").distinct().count() == 20
    assert rows.filter(F.col("y") != F.col("id") % 2).count() == 0
    assert 20 < rows.select("x").distinct().count() <= 70


def write_run(root, folder, name, header, n, shift=0.0):
    d = root / folder
    d.mkdir(parents=True, exist_ok=True)
    values = {"Test_Time(s)": lambda i: i, "Current(A)": lambda i: -1.0 + shift, "Voltage(V)": lambda i: 3.7,
              "Charge_Capacity(Ah)": lambda i: 0.0, "Discharge_Capacity(Ah)": lambda i: 0.1 * i, "Extra": lambda i: "z"}
    lines = [",".join(header)] + [",".join(str(values[h](i)) for h in header) for i in range(n)]
    (d / name).write_text("\n".join(lines) + "\n")


def test_cycler_tree(spark, tmp_path):
    full = ["Test_Time(s)", "Current(A)", "Voltage(V)", "Charge_Capacity(Ah)", "Discharge_Capacity(Ah)"]
    write_run(tmp_path, "SP2_0C_DST", "run_0C_DST_50SOC.csv", full, 10)
    write_run(tmp_path, "deep/SP2_25C_fuds", "run_80SOC.csv", ["Extra", *reversed(full)], 20, 0.5)
    write_run(tmp_path, "other", "run_80SOC.csv", full, 5)
    write_run(tmp_path, "SP2_45C_DST", "run.csv", full, 5)
    write_run(tmp_path, "SP2_45C_DST", "run_50SOC.csv", full[:-1], 5)
    tree = readers.read_cycler_tree(spark, str(tmp_path))
    got = {(r["temperature_c"], r["test_type"], r["initial_soc"], r["source_file"]): r["n"] for r in
           tree.rows.groupBy("temperature_c", "test_type", "initial_soc", "source_file").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, "DST", 0.5, "run_0C_DST_50SOC.csv"): 10, (25, "FUDS", 0.8, "run_80SOC.csv"): 20}
    assert tree.rows.filter("temperature_c = 25").agg(F.max("test_time_s"), F.min("current_a")).first()[:] == (19.0, -0.5)
    reasons = sorted(r["reason"].split(":")[0] for r in tree.rejects.collect())
    assert reasons == ["file name", "folder name", "missing columns"]
    sinks.write_csv(tree.rows.drop("path"), str(tmp_path / "out"), ["source_file"])
    assert readers.read_csv(spark, str(tmp_path / "out")).count() == 30


def test_all_files_rejected(spark, tmp_path):
    write_run(tmp_path, "other", "run_80SOC.csv", ["Extra"], 5)
    with pytest.raises(RuntimeError):
        readers.read_cycler_tree(spark, str(tmp_path))


# Column names, validation, small functions ------------------------------------------------


def test_alias_resolution():
    found = P.resolve_columns(["Time", "Voltage(V)", "I", "Cell_Temp_1", "SOC(%)", "Cycle_Index", "unit"])
    assert found["Voltage_V"] == "Voltage(V)" and found["Current_A"] == "I" and found["Temperature_C"] == "Cell_Temp_1"
    assert found["soc_true"] == "SOC(%)" and found["cycle_count"] == "Cycle_Index" and found["soh"] is None
    # one-letter aliases must not match inside other names
    assert P.find_column(["unit", "active"], ["v", "t", "u"]) is None


def test_normalise_defaults(spark):
    df = spark.createDataFrame([(3.7, None), (4.5, 20.0), (2.0, 50.0)], "Volt double, Temp double")
    out = P.normalise(df)
    rows = out.df.orderBy("Voltage_V").collect()
    assert out.missing == ["Current_A", "soc_true", "soh", "cycle_count", "internal_resistance_mohm", "charge_rate_c"]
    assert [r["fault_label"] for r in rows] == [1, 0, 1]
    assert {(r["soc"], r["soh"], r["charge_rate_c"], r["internal_resistance_mohm"], r["cell_id"]) for r in rows} == {(0.5, 0.95, 0.5, 10.0, "cell_001")}
    assert rows[1]["Temperature_C"] == 35.0  # the median of the others


def test_churn_validation(spark):
    good = (12, 70.0, 840.0, 2, 1, 5.0, 3, 20.0, 1.0, 900.0, "One year", "Mailed check", "DSL", "Yes", "No", "Yes")
    names = [r.column for r in P.CHURN_RULES]
    bad = tuple(-1 if n == "tenure" else "never" if n == "contract_type" else v for n, v in zip(names, good))
    missing = tuple(None if n == "monthly_charges" else v for n, v in zip(names, good))
    types = ["int", "double", "double", "int", "int", "double", "int", "double", "double", "double"] + ["string"] * 6
    df = spark.createDataFrame([good, bad, missing], ", ".join(f"{n} {t}" for n, t in zip(names, types)))
    valid, rejected = P.split_valid(df, P.CHURN_RULES)
    assert valid.count() == 1
    assert sorted(map(tuple, (r["violations"] for r in rejected.collect()))) == [
        ("monthly_charges: missing",), ("tenure: below 0", "contract_type: not allowed")]


def test_tags_and_risk_bands(spark):
    from driftloom.operators.impact import money, risk_band

    df = spark.createDataFrame([("a=1, b = x=y ,junk", 0.39, 123456.0), ("", 0.40, 1234.5), (None, 0.69, 12.0), ("k=", 0.70, -2000.0)], "t string, s double, v double")
    rows = df.select(R.parse_tags(F.col("t")).alias("t"), risk_band(F.col("s")).alias("r"), money(F.col("v")).alias("m")).collect()
    assert rows[0]["t"] == {"a": "1", "b": "x=y"} and rows[1]["t"] == {} and rows[3]["t"] == {"k": ""}
    assert [r["r"] for r in rows] == ["low", "medium", "medium", "high"]
    assert [r["m"] for r in rows] == ["₹1.2L", "₹1,234", "₹12", "₹-2,000"]


def test_snapshots_keep_types(spark, tmp_path):
    cat = DatasetCatalogue(spark, str(tmp_path / "catalogue"))
    big = 2**53 + 1
    df = spark.createDataFrame([(big, 1.0, 1), (big + 1, None, None), (big + 2, float("nan"), 3)], "id bigint, x double, n int")
    cat.register(df, "ids", at=DAY)
    back = cat.load("ids")
    assert back.dtypes == df.dtypes
    assert sorted(tuple(r) for r in back.collect()) == [(big, 1.0, 1), (big + 1, 1.0, 2), (big + 2, 1.0, 3)]


def test_quoted_commas_in_cycler_files(spark, tmp_path):
    folder = tmp_path / "SP2_25C_FUDS"
    folder.mkdir()
    head = '"Note, long",Test_Time(s),Current(A),Voltage(V),Charge_Capacity(Ah),Discharge_Capacity(Ah)'
    (folder / "x_80SOC.csv").write_text(head + '\n"a, b ""c""",1,2,3,4,5\n,6,7,8,9,10\n')
    tree = readers.read_cycler_tree(spark, str(tmp_path))
    got = sorted(tuple(r) for r in tree.rows.select(*readers.REQUIRED.values()).collect())
    assert got == [(1.0, 2.0, 3.0, 4.0, 5.0), (6.0, 7.0, 8.0, 9.0, 10.0)] and tree.rejects.count() == 0


def test_every_rejected_file_and_cell_has_a_row(spark, tmp_path):
    folder = tmp_path / "SP2_25C_FUDS"
    folder.mkdir()
    head = "Test_Time(s),Current(A),Voltage(V),Charge_Capacity(Ah),Discharge_Capacity(Ah)"
    rows = [f"{i},{i % 7},{i * 13 % 101},4,5" for i in range(20_000)]
    body = "\n".join([head, *rows]).encode()
    packed = gzip.compress(body)
    (folder / "whole_80SOC.csv.gz").write_bytes(packed)
    (folder / "cut_80SOC.csv.gz").write_bytes(packed[: len(packed) // 2])
    (folder / "empty_80SOC.csv").write_text("\n")
    # repeated header, a line that only resembles one, cells without a number, blank cells, other line ends
    (folder / "cells_50SOC.csv").write_bytes(f"{head}\r\n1,n/a,3,4,5\r\n{head}\r\nCurrent(A),2,,4,\r\n6,7,8,9,x y\r\n".encode())
    tree = readers.read_cycler_tree(spark, str(tmp_path), "*.csv*")
    reasons = sorted((r.reason.split(":")[0], r.path.split("/")[-1]) for r in tree.rejects.collect())
    assert reasons == [("missing columns", "empty_80SOC.csv"), ("unreadable", "cut_80SOC.csv.gz")]
    counts = {r.source_file: r["count"] for r in tree.rows.groupBy("source_file").count().collect()}
    assert counts == {"whole_80SOC.csv.gz": 20_000, "cells_50SOC.csv": 3}
    bad = sorted((r.path.split("/")[-1], r.column, r.value) for r in tree.bad_cells.collect())
    assert bad == [("cells_50SOC.csv", c, v) for c, v in [("Current(A)", "n/a"), ("Discharge_Capacity(Ah)", "x y"), ("Test_Time(s)", "Current(A)")]]
