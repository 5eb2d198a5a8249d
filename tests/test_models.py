"""Models, fusion and streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from driftloom.operators import models as L
from driftloom.operators import splits
from driftloom.streaming import online as O


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3)) * [1, 10, 0.1] + [5, -3, 0]
    y = x @ [2.0, 0.5, 30.0] + 40 + rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(y=y))
    fit = L.degradation_trend(df, "y", list("abc"), alpha=7.0)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 7.0 * np.eye(3), z.T @ (y - y.mean()))
    assert fit.coefficients == pytest.approx(list(w), rel=1e-6) and fit.intercept == pytest.approx(y.mean())
    got = df.select("y", fit.predict().alias("p")).toPandas()["p"]
    assert np.allclose(got, np.clip(z @ w + y.mean(), 0, 100))


def test_fusion(spark):
    rows = [(0.9, 10.0, 0.5, 0.1, 0.0), (None, 40.0, None, 0.1, 0.0), (None, None, None, None, None), (0.75, None, None, 0.35, 0.0),
            (0.95, None, None, 0.0, 0.1), (0.6, 120.0, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "soh double, fade double, soc double, fault double, thermal double")
    out = L.fuse_predictions(df, soh="soh", fade="fade", soc="soc", fault="fault", thermal="thermal").collect()
    assert [r["soh_estimate"] for r in out] == pytest.approx([0.8, 0.6, 0.8, 0.75, 0.95, 0.4])
    assert [r["degradation_severity"] for r in out] == ["healthy", "critical", "healthy", "critical", "critical", "critical"]
    assert [r["fault_flag"] for r in out] == [False, False, False, True, True, False]


def test_unknown_category_is_all_zeros(spark):
    train = spark.createDataFrame([(float(i), "uvw"[i % 3], i % 2) for i in range(60)], "x double, c string, y int")
    model = L.churn_classifier(train, "y", ["x"], ["c"], trees=2, depth=2)
    new = spark.createDataFrame([(1.0, "unseen", 0)], "x double, c string, y int")
    assert list(model.transform(new).first()["features"].toArray()[1:]) == [0.0, 0.0, 0.0]
    scored = L.score_table(model, new)
    assert set(scored.columns) == {"x", "c", "y", "_weight", "score", "predicted"} - {"_weight"}


def test_promotion_needs_a_gain(spark):
    df = spark.createDataFrame([(0.80, 0.82), (0.80, 0.805), (None, 0.9)], "old_auc double, new_auc double")
    assert [r["promoted"] for r in L.promotion(df).collect()] == [True, False, False]


def test_folds_are_stratified(spark):
    df = spark.range(500).withColumn("y", (F.col("id") < 50).cast("int"))
    sizes = L.stratified_folds(df, "y", ["id"]).groupBy("fold", "y").count().collect()
    assert {r["count"] for r in sizes if r["y"] == 1} == {10} and {r["count"] for r in sizes if r["y"] == 0} == {90}


def test_recent_batches_and_union(spark):
    df = spark.range(100).select((F.col("id") / 10).cast("int").alias("batch_id"))
    assert splits.recent_batches(df, trigger=8, keep=8).agg(F.min("batch_id"), F.max("batch_id")).first()[:] == (1, 8)
    assert splits.recent_batches(df, trigger=3, keep=8).agg(F.min("batch_id")).first()[0] == 0


# Streams -------------------------------------------------------------------------------


def predictions(n=2600, seed=3):
    rng = np.random.default_rng(seed)
    model = np.where(rng.uniform(size=n) < 0.6, 1, 2)
    return pd.DataFrame({"model_id": model, "t": np.arange(n) * 10, "x": rng.normal(np.arange(n) / 1500, 1),
                         "c": rng.choice(["u", "v", "w"], n), "prediction_score": rng.uniform(0, 1, n)})


def test_window_monitor_does_not_depend_on_micro_batches(spark, tmp_path):
    pdf = predictions()
    rng = np.random.default_rng(0)
    reference = spark.createDataFrame(pd.DataFrame({"x": rng.normal(0, 1, 800), "c": rng.choice(["u", "v", "w"], 800), "prediction_score": rng.uniform(0, 1, 800)}))
    logs = []
    for name, cuts in (("one", [2600]), ("many", [130, 700, 1450, 1460, 2600])):
        watch = O.WindowMonitor(spark, str(tmp_path / name), reference, ["x"], ["c"], ["t"])
        start = 0
        for epoch, stop in enumerate(cuts):
            rows = spark.createDataFrame(pdf.iloc[start:stop].sample(frac=1, random_state=1))
            watch.process(rows, epoch)
            if epoch == 1:
                watch.process(rows, epoch)  # a replayed epoch changes nothing
            start = stop
        logs.append(watch.drift_log(None).orderBy("model_id", "window_id").toPandas())
        tail = spark.read.parquet(f"{tmp_path}/{name}/tail/epoch={len(cuts) - 1}")
        assert {r["count"] for r in tail.groupBy("model_id").count().collect()} == {1000}
    one, many = logs
    per_model = pdf["model_id"].value_counts()
    assert one.groupby("model_id").size().to_dict() == {m: per_model[m] // 500 for m in (1, 2)}
    assert one[["model_id", "window_id", "window_size", "drift_severity"]].equals(many[["model_id", "window_id", "window_size", "drift_severity"]])
    assert np.allclose(one["drift_score"], many["drift_score"]) and np.allclose(one["estimated_auc"], many["estimated_auc"])
    assert one["window_size"].tolist()[:2] == [500, 1000]


def test_window_monitor_counts_a_model_without_id(spark, tmp_path):
    pdf = predictions(90)
    rows = spark.createDataFrame(pdf).withColumn("model_id", F.lit(None).cast("bigint"))
    watch = O.WindowMonitor(spark, str(tmp_path / "w"), spark.createDataFrame(predictions(300)).drop("model_id"), ["x"], [], ["t"], size=40, every=20)
    watch.process(rows.filter(F.col("t") <= pdf["t"].iloc[40]), 0)
    watch.process(rows.filter(F.col("t") > pdf["t"].iloc[40]), 1)
    log = spark.read.parquet(f"{tmp_path}/w/log")
    assert sorted(r["position"] for r in log.collect()) == list(range(1, 91))
    assert spark.read.parquet(f"{tmp_path}/w/served/epoch=1").collect()[0][:] == (None, 90)


def test_lost_state_raises(spark, tmp_path):
    pdf = predictions(90)
    watch = O.WindowMonitor(spark, str(tmp_path / "w"), spark.createDataFrame(predictions(300)).drop("model_id"), ["x"], [], ["t"], size=40, every=20)
    watch.process(spark.createDataFrame(pdf[:40]), 0)
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        watch.process(spark.createDataFrame(pdf[40:]), 2)  # the state of epoch 1 is not there
    watch.process(spark.createDataFrame(pdf[40:]), 1)
    assert spark.read.parquet(f"{tmp_path}/w/served/epoch=1").agg(F.sum("served")).first()[0] == 90


def test_small_windows_are_skipped(spark, tmp_path):
    pdf = predictions(90)
    watch = O.WindowMonitor(spark, str(tmp_path / "w"), spark.createDataFrame(predictions(300)).drop("model_id"), ["x"], [], ["t"], size=40, every=20)
    watch.process(spark.createDataFrame(pdf), 0)
    assert watch.check(spark.read.parquet(f"{tmp_path}/w/log/epoch=0").withColumn("window_id", F.lit(1).cast("bigint"))).count() == 0


def test_trigger_stream_over_several_files(spark, tmp_path):
    flags = [1, 1, 0, 1, 1, 1, 1, 0, 1]
    schema = "model_id bigint, batch_id bigint, auc_roc double, drift_severity string"
    query = None
    for i, raised in enumerate(flags):
        row = [(1, i, 0.65 if raised else 0.9, "none")]
        spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = O.start_log(O.trigger_stream(stream), str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).filter("retrain_triggered").orderBy("batch_id").collect()
    assert [r["batch_id"] for r in out] == [0, 4, 8]


def test_event_time_stream_equals_the_table(spark, tmp_path):
    rng = np.random.default_rng(1)
    n = 2000
    pdf = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.uniform(0, 72, n)), unit="h"), "x": rng.normal(0, 1, n)})
    df = spark.createDataFrame(pdf)
    bins = O.freeze(df.limit(500), ["x"])
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = O.run_to_table(O.event_time_psi(stream, bins), spark, "et").orderBy("window_start").collect()
    want = O.event_time_psi(df, bins).orderBy("window_start").collect()
    assert len(want) == 3 and len(got) >= 2
    for a, b in zip(got, want):
        assert a["window_start"] == b["window_start"] and a["psi"] == pytest.approx(b["psi"], rel=1e-9)


def test_a_fold_is_prepared_once_for_all_trials(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import Imputer
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    data = pd.DataFrame(x, columns=["a", "b"]).assign(c=np.array(list("uvw"))[rng.integers(0, 3, 400)], id=range(400))
    data["y"] = (x[:, 0] + rng.normal(size=400) > 0).astype(int)
    data.loc[::17, "a"] = None
    df = spark.createDataFrame(data)
    gbt = GBTClassifier(labelCol="y", maxIter=2, seed=42)
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, [1, 3]).build()
    plain = CrossValidator(
        estimator=Pipeline(stages=[*L.preprocessing(["a", "b"], ["c"]), gbt]), estimatorParamMaps=grid,
        evaluator=BinaryClassificationEvaluator(labelCol="y"), numFolds=3, foldCol="fold", seed=42,
    ).fit(L.stratified_folds(df, "y", ["id"], 3, 42))
    fits = []
    fit = Imputer._fit
    monkeypatch.setattr(Imputer, "_fit", lambda self, rows: fits.append(1) or fit(self, rows))
    found = L.search_parameters(df, "y", ["a", "b"], ["c"], key=["id"], grid={"maxDepth": [1, 3]}, folds=3, trees=2)
    assert found.avgMetrics == pytest.approx(plain.avgMetrics, abs=1e-9) and found.stdMetrics == pytest.approx(plain.stdMetrics, abs=1e-9)
    assert found.bestModel.stages[-1].getMaxDepth() == plain.bestModel.stages[-1].getMaxDepth()
    assert [r["parameters"] for r in L.best_trials(found, df).collect()] == [r["parameters"] for r in L.best_trials(plain, df).collect()]
    assert len(fits) == 3 + 1  # the folds, and the best trial on all rows; before, one for every trial of a fold
