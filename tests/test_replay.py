"""The run with retraining against a plain sequential loop; what a run leaves in the registry."""

import datetime as dt
import json
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftloom.operators import drift as D
from driftloom.operators import impact as B
from driftloom.operators import models as L
from driftloom.operators.splits import stratified_split
from driftloom.plans import monitor as P
from driftloom.plans import replay as R
from driftloom.sources.stores import ModelRegistry

FEATURES = ["x1", "x2"]


def ridge(rows):
    return L.degradation_trend(rows.withColumn("_t", F.col("y") * 100.0), "_t", FEATURES)


def by_ridge(model, rows):
    return rows.withColumn("score", model.predict() / 100)


def table(batches=11, n=240, seed=5):
    rng = np.random.default_rng(seed)
    parts = []
    for b in range(batches + 1):
        x = rng.normal(size=(n if b else 4 * n, 2))
        y = (x.sum(axis=1) + rng.normal(size=len(x)) * 0.3 > 0).astype(int)
        if b == 1:
            x[:, 0] = 0.0  # the first retraining can learn from one feature only
        x[:, 1] += 0.8 * (b in (5, 6, 9))
        parts.append(pd.DataFrame(x, columns=FEATURES).assign(y=y, batch_id=b, is_reference=b == 0))
    return pd.concat(parts, ignore_index=True).reset_index(names="id")


def auc(y, s):
    r = pd.Series(s).rank().to_numpy()
    n1 = int((y == 1).sum())
    n0 = len(y) - n1
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def fit_plain(part):
    x, y = part[FEATURES].to_numpy(), part["y"].to_numpy() * 100.0
    m, s = x.mean(0), x.std(0)
    s[s == 0] = 1.0
    z = (x - m) / s
    return m, s, np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean())), y.mean()


def score_plain(model, part):
    m, s, w, c = model
    return np.clip((part[FEATURES].to_numpy() - m) / s @ w + c, 0, 100) / 100


def sequential(spark, pdf, severity, recent):
    """One batch after another: judge, trigger with cooldown, retrain, promote."""

    def split(part, key):
        df = stratified_split(spark.createDataFrame(part), key=key, strata="y")
        return {s: p.drop(columns="split") for s, p in df.toPandas().groupby("split")}

    ref = split(pdf[pdf.is_reference], ["id"])
    model, epoch, left, aucs, out, log = (np.zeros(2), np.ones(2), np.array([20.0, -60.0]), 50.0), 0, 0, [], [], []
    base = auc(pdf[pdf.is_reference].y.to_numpy(), score_plain(model, pdf[pdf.is_reference]))
    for b in sorted(pdf.batch_id[~pdf.is_reference].unique()):
        part = pdf[(pdf.batch_id == b) & ~pdf.is_reference]
        a = auc(part.y.to_numpy(), score_plain(model, part))
        low = a < 0.8
        fall = len(aucs) >= 3 and aucs[-3] - a > 0.05 and low
        raised = a < 0.7 or (low and severity[b] in ("warning", "critical")) or fall
        fires = left == 0 and raised
        left = left - 1 if left > 0 else 3 if fires else 0
        aucs.append(a)
        out.append((b, epoch, round(a, 9), fires))
        if fires:
            seen = pdf[(pdf.batch_id <= b) & ~pdf.is_reference]
            seen = seen[seen.batch_id.isin(sorted(seen.batch_id.unique())[-recent:])]
            pool = pd.concat([seen, ref["train"]]) if seen.batch_id.nunique() < recent else seen
            new = fit_plain(split(pool, ["id", "batch_id"])["train"])
            old_auc, new_auc = (auc(ref["test"].y.to_numpy(), score_plain(m, ref["test"])) for m in (model, new))
            log.append((b, epoch, round(old_auc, 9), round(new_auc, 9), new_auc - old_auc >= 0.01))
            if log[-1][-1]:
                model, epoch = new, epoch + 1
    return base, out, log


@pytest.mark.parametrize("recent,first_span", [(1, 4), (8, 100)])
def test_replay_equals_the_sequential_run(spark, recent, first_span):
    pdf = table()
    rows = spark.createDataFrame(pdf).repartition(5)
    weak = L.Trend(FEATURES, [0.0, 0.0], [1.0, 1.0], [20.0, -60.0], 50.0)
    run = R.replay(
        rows, numeric=FEATURES, categorical=[], label="y", key=["id"], fit=ridge, score=by_ridge, model=weak, recent=recent, first_span=first_span
    )
    severity = {r.batch_id: r.overall_severity for r in D.batch_report(run.details).collect()}
    base, want, log = sequential(spark, pdf, severity, recent)
    got = sorted((r.batch_id, r.epoch, round(r.auc_roc, 9), r.retrain_triggered) for r in run.summary.collect())
    assert got == want and run.baseline_auc == pytest.approx(base)
    events = sorted((r.batch_id, r.epoch, round(r.old_auc, 9), round(r.new_auc, 9), r.promoted) for r in run.retrains.collect())
    assert events == log
    assert recent != 1 or sum(e[-1] for e in log) >= 2  # promoted twice or more
    assert {r.batch_id: r.epoch for r in run.prediction.collect()} == {b: e for b, e, _, _ in want}


def test_score_drift_is_compared_once_for_all_epochs(spark, monkeypatch):
    rows = spark.createDataFrame(table(batches=4))
    calls, models = [], []
    drift = D.prediction_drift

    def fit(part):
        models.append(ridge(part))
        return models[-1]

    monkeypatch.setattr(D, "prediction_drift", lambda *args, **named: calls.append(1) or drift(*args, **named))
    weak = L.Trend(FEATURES, [0.0, 0.0], [1.0, 1.0], [20.0, -60.0], 50.0)
    run = R.replay(rows, numeric=FEATURES, categorical=[], label="y", key=["id"], fit=fit, score=by_ridge, model=weak, recent=1, first_span=1)
    assert len(calls) == 1  # before, one for every span
    promoted = [m for m, r in zip(models, sorted(run.retrains.collect(), key=lambda r: r.batch_id), strict=True) if r.promoted]
    assert promoted
    got = {r.batch_id: r for r in run.prediction.collect()}
    assert set(got) == {1, 2, 3, 4}
    for epoch, model in enumerate([weak, *promoted]):
        alone = {r.batch_id: r for r in drift(by_ridge(model, rows), "score").collect()}
        for b, r in got.items():
            if r.epoch == epoch:
                assert (r.severity, r.message) == (alone[b].severity, alone[b].message) and r.score == pytest.approx(alone[b].score)


def test_a_run_in_the_registry(spark, tmp_path):
    rows = spark.createDataFrame(table(batches=6))
    run = R.replay(rows, numeric=FEATURES, categorical=[], label="y", key=["id"], fit=ridge, score=by_ridge, model=L.Trend(FEATURES, [0.0] * 2, [1.0] * 2, [20.0, -60.0], 50.0))
    registry = ModelRegistry(spark, str(tmp_path / "registry"))
    at = dt.datetime(2024, 1, 1)
    artifacts = str(tmp_path / "artifacts")
    one = R.record(run, registry, name="churn", at=at, artifacts=artifacts, tags={"team": "a"})
    assert R.record(run, registry, name="churn", version="2", at=at) == one + 1
    history = registry.model_history(one).collect()
    summary = {r.batch_id: r for r in run.summary.collect()}
    assert [(r.batch_id, r.auc_roc, r.drift_severity, r.roi_monthly_loss) for r in history] == [
        (b, summary[b].auc_roc, summary[b].overall_severity, summary[b].total_monthly_loss) for b in sorted(summary)
    ]
    assert registry.drift_history(one).count() == run.details.count()
    logged = [(r.trigger_batch, r.promoted) for r in registry.retrain_history(one).collect()]
    assert sorted(logged) == sorted((r.batch_id, r.promoted) for r in run.retrains.collect()) and logged
    fleet = {r.model_id: r for r in registry.fleet_health().collect()}
    assert fleet[one].n_batches == 6 and fleet[one].n_retrains == len(logged)
    lines = [json.loads(x) for f in Path(artifacts, "monitoring_summary").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(x["batch_id"] for x in lines) == sorted(summary)
    when = spark.createDataFrame([(b, dt.datetime(2024, 1, b)) for b in range(1, 7)], "batch_id bigint, ts timestamp")
    alerts = R.alerts_of(run, when).collect()
    assert any("\nReason: AUC" in r.message for r in alerts if r.category == "performance")
    assert {r.batch_id for r in alerts if r.category == "retrain"} == {b for b, _ in logged}


def test_unlabelled_batches_stay(spark):
    pdf = table(batches=3)
    rows = spark.createDataFrame(pdf).withColumn("y", F.when(F.col("batch_id") != 2, F.col("y")))
    run = R.replay(rows, numeric=FEATURES, categorical=[], label="y", key=["id"], fit=ridge, score=by_ridge)
    got = {r.batch_id: (r.auc_roc is None, r.retrain_triggered) for r in run.summary.collect()}
    assert set(got) == {1, 2, 3} and got[2] == (True, False)


# Rows and columns that must not vanish ---------------------------------------------


def shifted(spark, ids):
    rng = np.random.default_rng(1)
    n = 150
    parts = [pd.DataFrame({"x": rng.normal(size=4 * n), "batch": None, "is_reference": True})]
    parts += [pd.DataFrame({"x": rng.normal(size=n) + 3 * k, "batch": b, "is_reference": False}) for k, b in enumerate(ids, 1)]
    pdf = pd.concat(parts, ignore_index=True)
    pdf["y"] = (rng.random(len(pdf)) < 0.5).astype(int)
    pdf["score"] = 1 / (1 + np.exp(-pdf.x))
    return spark.createDataFrame(pdf, "x double, batch string, is_reference boolean, y int, score double")


def test_a_null_batch_and_one_called_reference(spark):
    rows = shifted(spark, ["a", "reference", None])
    run = P.monitor(rows, numeric=["x"], categorical=[], label="y", score="score", batch="batch")
    got = {r.batch: r for r in run.summary.collect()}
    assert set(got) == {"a", "reference", None}
    assert all(r.auc_roc is not None and r.n_samples == 150 and r.overall_drift_score > 1 and r.overall_severity == "critical" for r in got.values())
    base = auc(*(rows.filter("is_reference").toPandas()[c].to_numpy() for c in ("y", "score")))
    assert all(r.baseline_auc == pytest.approx(base) for r in got.values())


def test_null_keys_in_every_drift_operator(spark):
    rows = shifted(spark, ["a", "b"]).withColumn("model", F.lit(None).cast("string"))
    named = rows.withColumn("model", F.lit("m"))
    for work, column in ((D.psi, "psi"), (D.ks, "ks"), (D.wasserstein, "wasserstein"), (D.numeric_drift, "score")):
        nameless, plain = ({r.batch: r[column] for r in work(t, ["x"], keys=["model"], batch="batch").collect()} for t in (rows, named))
        assert nameless == pytest.approx(plain) and len(plain) == 2
    words = rows.withColumn("c", F.when(F.col("x") > 1, "hi").otherwise("lo"))
    nameless, plain = ({r.batch: r.chi2 for r in D.categorical_drift(t, ["c"], keys=["model"], batch="batch").collect()} for t in (words, words.withColumn("model", F.lit("m"))))
    assert nameless == pytest.approx(plain) and len(plain) == 2
    assert D.aligned_categories(words, ["c"], keys=["model"], batch="batch").count() == 4
    run = P.monitor(rows, numeric=["x"], categorical=[], label="y", score="score", keys=["model"], batch="batch")
    assert {r.baseline_auc for r in run.summary.collect()} != {0.87} and run.summary.count() == 2


def test_a_missing_reference_is_named(spark):
    rows = shifted(spark, ["a"]).filter("not is_reference")
    got = D.numeric_drift(rows, ["x"], batch="batch").first()
    assert got.n_prod == 150 and got.n_ref == 0 and got.message == "No reference values to compare with"


def test_battery_run_keeps_every_batch(spark):
    n = 120
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"t": rng.normal(size=4 * n), "batch_id": np.repeat([0, 1, 2, 3], n)})
    pdf = pdf.assign(is_reference=pdf.batch_id == 0, soh=0.9, pred=0.88, risk=rng.random(4 * n), fault=(rng.random(4 * n) > 0.5).astype(float))
    df = spark.createDataFrame(pdf).withColumn("fault", F.when(F.col("batch_id") != 2, F.col("fault").cast("int")))
    df = df.withColumn("batch_id", F.when(F.col("batch_id") != 3, F.col("batch_id")))
    out = {r.batch_id: r for r in P.battery_monitor(df, features=["t"], soh="soh", soh_predicted="pred", label="fault", score="risk").collect()}
    assert set(out) == {1, 2, None} and out[2].auc_roc is None and out[None].auc_roc is not None


def test_user_columns_stay(spark):
    rows = spark.range(80).select(F.col("id").alias("cycle_index"), (F.col("id") % 7).cast("double").alias("a"), F.lit("u").alias("mine_onehot"), (F.col("id") / 80).alias("soh"))
    model = L.health_regressor(rows, "soh", ["a"], trees=2, depth=2)
    assert set(L.clipped_prediction(model.transform(rows), 0, 1, rows.columns).columns) == {*rows.columns, "prediction"}
    spread = L.prediction_spread(rows, rows, "soh", ["a"], key=["cycle_index"], models=2, trees=2, depth=2)
    assert set(spread.columns) == {*rows.columns, "mean_prediction", "std_prediction"}


def test_the_unknown_is_not_good(spark):
    row = spark.range(1).select(*[f(F.lit(v).cast("double")).alias(f"{f.__name__}{i}") for f in (B.risk_band, B.loss_band) for i, v in enumerate((None, float("nan"), 0.1))]).first()
    assert list(row) == [None, None, "low", None, None, "none"]
