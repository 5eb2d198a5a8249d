"""The whole monitoring run for all batches of all models in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions import thresholds as T
from driftloom.operators import drift as D
from driftloom.operators import impact as B
from driftloom.operators import quality as M
from driftloom.operators import windows as W
from driftloom.operators.ordered import clean
from driftloom.sources.stage import stage


@dataclass
class MonitoringRun:
    details: DataFrame
    prediction: DataFrame
    summary: DataFrame


def _beside(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "full") -> DataFrame:
    """Join on columns of which null is a value like any other; no row of either side is lost."""
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on]
    both = left.alias("a").join(right.alias("b"), same, how)
    rest = [F.col(f"a.{c}") for c in left.columns if c not in on] + [F.col(f"b.{c}") for c in right.columns if c not in on]
    return both.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in on], *rest)


def monitor(
    rows: DataFrame, *, numeric: Sequence[str], categorical: Sequence[str], label: str, score: str, keys: Sequence[str] = (),
    batch: str = "batch_id", baseline: float | None = None,
) -> MonitoringRun:
    """Drift, quality, retraining trigger and cost per (keys, batch).

    ``rows`` hold reference and batches.  The verdicts are one row per batch
    and feature, the summary one row per batch; both are staged for their readers.
    The baseline AUC defaults to the model's own AUC on the reference.
    """
    keys = list(keys)
    who = [*keys, batch]
    # the scores are one more column of the same counting scan
    rows = rows.withColumn("prediction_score", F.col(score))
    scores = stage(D.numeric_scores(rows, [*numeric, "prediction_score"], keys=keys, batch=batch), "drift-scores")
    of_scores = F.col("feature") == "prediction_score"
    num = D.numeric_verdict(scores.filter(~of_scores)) if numeric else None
    cat = D.categorical_drift(rows, categorical, keys=keys, batch=batch) if categorical else None
    details = stage(D.drift_details(num, cat, keys=keys, batch=batch), "drift-details")
    report = D.batch_report(details, keys=keys, batch=batch)
    prediction = D.prediction_verdict(scores.filter(of_scores))

    # the reference is one more group of the same metrics
    of_ref = F.coalesce(F.col(D.REF), F.lit(False))
    grouped = rows.withColumn("_group", F.struct(of_ref.alias("is_ref"), F.when(~of_ref, F.col(batch)).alias("batch")))
    metrics = stage(M.binary_metrics(grouped, label, score, keys=[*keys, "_group"]), "quality")
    is_ref = F.col("_group.is_ref")
    quality = metrics.filter(~is_ref).withColumn(batch, F.col("_group.batch")).drop("_group")

    # labels arrive late: a batch without them keeps its drift, and its quality is null
    joined = _beside(quality, report, who).withColumn("drift_severity", F.col("overall_severity"))
    if baseline is None:
        base = metrics.filter(is_ref).select(*keys, F.coalesce("auc_roc", F.lit(T.BASELINE_AUC)).alias("baseline_auc"))
        if keys:
            known = _beside(joined, base, keys, "left")
            joined = known.withColumn("baseline_auc", F.coalesce("baseline_auc", F.lit(T.BASELINE_AUC)))
        else:
            joined = joined.withColumn("baseline_auc", F.coalesce(base.select("baseline_auc").scalar(), F.lit(T.BASELINE_AUC)))
    else:
        joined = joined.withColumn("baseline_auc", F.lit(baseline))
    # one row per batch; the ordered rules read their input several times
    history = stage(joined if keys else joined.withColumn("_one", F.lit(1)), "history")
    decided = W.retrain_triggers(history, keys=keys or ["_one"], order=batch)
    summary = stage(B.monthly_loss(decided, baseline=F.col("baseline_auc")).drop("_one"), "summary")
    return MonitoringRun(details, prediction, summary)


def battery_monitor(
    rows: DataFrame, *, features: Sequence[str], soh: str, soh_predicted: str, label: str, score: str, batch: str = "batch_id",
) -> DataFrame:
    """Battery fleet run: base rates, model errors, drift and monthly cost per batch."""
    prod = rows.filter(~F.col(D.REF))
    base = prod.groupBy(batch).agg(
        F.avg(clean(soh)).alias("soh_mean"), F.avg(clean(label)).alias("fault_rate"),
        F.avg(F.abs(clean(soh) - clean(soh_predicted))).alias("soh_mae"),
    )
    quality = M.binary_metrics(prod, label, score, keys=[batch], threshold=T.FAULT_THRESHOLD)
    details = D.drift_details(D.numeric_drift(rows, features, batch=batch, with_stats=False), None, batch=batch)
    report = D.batch_report(details, batch=batch)
    return B.battery_cost(_beside(_beside(base, quality, [batch]), report, [batch]))
