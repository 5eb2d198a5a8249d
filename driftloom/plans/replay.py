"""The monitoring run that retrains: a replay of all batches in which a promoted model judges what comes after it.

Drift of the features does not depend on the model, so all batches are compared with the reference in one job.  Scores do:
the driver walks through retrain epochs.  In each, the current model scores a span of batches in one job, and the
retraining rules run over the whole history of accepted batches and that span, so cooldown and trend carry over from
one epoch to the next by construction.  At the first batch that fires, a model is fitted on the recent labelled batches
and compared on the holdout.  If it is promoted, the batches up to there are accepted and the rest of the span is scored
again; otherwise the walk goes on within the span.  Spans double while no model is promoted, so no more batches are
scored in vain than are kept.

No decision waits for the drift of the scores: the reference is scored once an epoch, and the accepted batches of all epochs
are compared with theirs in one job behind the walk.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions import thresholds as T
from driftloom.operators import drift as D
from driftloom.operators import impact as B
from driftloom.operators import quality as M
from driftloom.operators import windows as W
from driftloom.operators.models import promotion
from driftloom.operators.splits import stratified_split
from driftloom.sources.sinks import write_json
from driftloom.sources.stage import new_path, stage
from driftloom.sources.stores import ModelRegistry

#: Batches of the first span; batches that a retraining reads, the reference counting as the first.
FIRST_SPAN, RECENT = 4, 8

RETRAINS = (
    "batch_id bigint, epoch int, retrain_reason string, n_labelled bigint, old_auc double, new_auc double, "
    "promoted boolean, promotion_reason string, npv double, rationale string"
)


@dataclass
class Replay:
    """Tables of a run: verdicts per batch and feature, score drift, one summary row per batch, and retrainings.

    ``epoch`` in them counts promotions: the model that judged the batch.  ``model`` is the last one.
    """

    details: DataFrame
    prediction: DataFrame
    summary: DataFrame
    retrains: DataFrame
    model: Any
    baseline_auc: float


def replay(
    rows: DataFrame, *, numeric: Sequence[str], categorical: Sequence[str], label: str, key: Sequence[str], fit: Callable[[DataFrame], Any],
    score: Callable[[Any, DataFrame], DataFrame], model: Any = None, batch: str = "batch_id", column: str = "score", recent: int = RECENT,
    first_span: int = FIRST_SPAN, cost: float = 0.0,
) -> Replay:
    """Replay all batches in order with retraining and promotion.

    ``rows`` hold reference and batches; ``fit`` makes a model from labelled rows, ``score`` adds ``column`` to rows.
    Without a ``model`` the first one is fitted on four fifths of the reference.  The other fifth is the holdout on
    which models are compared, and never trained on.  Batches without labels keep their drift and trigger nothing.
    Rows without a batch id have no place in the order: they get verdicts but no summary row.
    """
    spark = rows.sparkSession
    reference = rows.filter(F.col(D.REF))
    held = stage(stratified_split(reference.dropna(subset=[label]), key=key, strata=label), "replay-reference")
    holdout, kept = held.filter("split = 'test'").drop("split"), held.filter("split = 'train'").drop("split")
    model = fit(kept) if model is None else model

    num = D.numeric_drift(rows, numeric, batch=batch, with_stats=False) if numeric else None
    cat = D.categorical_drift(rows, categorical, batch=batch) if categorical else None
    details = stage(D.drift_details(num, cat, batch=batch), "replay-details")
    report = stage(D.batch_report(details, batch=batch).withColumn("drift_severity", F.col("overall_severity")), "replay-report")
    placed = report.filter(F.col(batch).isNotNull())

    def scores(of: Any, part: DataFrame, *kept: str) -> DataFrame:
        return score(of, part).select(*kept, label, F.col(column).alias("prediction_score"))

    def aucs(**models: Any) -> dict[str, float | None]:
        """AUC of each model on the holdout, all in one job."""
        every = reduce(DataFrame.unionAll, [scores(of, holdout).withColumn("_model", F.lit(name)) for name, of in models.items()])
        found = M.binary_metrics(every, label, "prediction_score", keys=["_model"]).collect()
        return dict.fromkeys(models) | {r["_model"]: r["auc_roc"] for r in found}

    def score_reference() -> DataFrame:
        part = stage(scores(model, reference, D.REF, batch), "replay-reference-scores")
        scored.append(part.withColumn("epoch", F.lit(epoch)))
        return part

    root, epoch, span, after, retrained, scored = new_path(spark, "replay"), 0, first_span, None, [], []
    found = M.binary_metrics(score_reference(), label, "prediction_score").first()
    baseline = found["auc_roc"] if found else None
    baseline = T.BASELINE_AUC if baseline is None else baseline
    old_auc = None

    def behind(table: DataFrame) -> DataFrame:
        return table if after is None else table.filter(F.col(batch) > after)

    def accept(name: str, table: DataFrame, upto: Any) -> None:
        part = behind(table).filter(F.col(batch) <= upto).withColumn("epoch", F.lit(epoch))
        part.write.mode("append").parquet(f"{root}/{name}")

    accepted, after_promotion, compared = None, False, False
    while True:
        last = behind(placed).select(batch).orderBy(batch).limit(span).agg(F.max(batch)).first()[0]
        if last is None:
            break
        if after_promotion:
            score_reference()
        inside = behind(rows.filter(~F.col(D.REF) & (F.col(batch) <= last)))
        inside = stage(scores(model, inside, D.REF, batch), "replay-scores")
        quality = M.binary_metrics(inside, label, "prediction_score", keys=[batch])
        here = stage(behind(placed).filter(F.col(batch) <= last).join(quality, batch, "left"), "replay-span")
        history = here if accepted is None else spark.read.schema(accepted).parquet(f"{root}/quality").drop("epoch").unionByName(here)
        decided = stage(W.retrain_triggers(history.withColumn("_one", F.lit(1)), keys=["_one"], order=batch).drop("_one"), "replay-decided")
        upto, promoted = last, False
        fires = behind(decided.filter("retrain_triggered"))
        while not promoted and (hit := fires.orderBy(batch).first()) is not None:
            at = hit[batch]
            # the batches a retraining reads; the reference stands before the first of them
            seen = placed.filter(F.col(batch) <= at).orderBy(F.desc(batch)).limit(recent).agg(F.min(batch), F.count("*")).first()
            part = rows.filter(~F.col(D.REF) & F.col(batch).between(seen[0], at))
            part = part.unionByName(kept) if seen[1] < recent else part
            labelled = part.dropna(subset=[label]).join(holdout.select(*key).distinct(), list(key), "left_anti")
            labelled = stage(stratified_split(labelled, key=[*key, batch], strata=label), "replay-labelled")
            new = fit(labelled.filter("split = 'train'").drop("split"))
            known = aucs(new=new) if compared else aucs(old=model, new=new)
            old_auc, compared = known.get("old", old_auc), True
            decision = promotion(spark.createDataFrame([(old_auc, known["new"])], "old_auc double, new_auc double")).first()
            now = decided.filter(F.col(batch) == at).select(batch, "auc_roc")
            value = B.retrain_value(now, baseline=baseline, cost=cost).first()
            retrained.append(
                (at, epoch, hit["retrain_reason"], labelled.count(), decision["old_auc"], decision["new_auc"], decision["promoted"],
                 decision["promotion_reason"], value["npv"], value["rationale"])
            )
            promoted = decision["promoted"]
            if promoted:
                upto, model, old_auc = at, new, known["new"]
            fires = fires.filter(F.col(batch) > at)
        accept("quality", here, upto)
        accept("decided", decided, upto)
        scored.append(inside.filter(F.col(batch) <= upto).withColumn("epoch", F.lit(epoch)))
        accepted = here.withColumn("epoch", F.lit(epoch)).schema
        shape = decided.withColumn("epoch", F.lit(epoch)).schema
        epoch, span, after, after_promotion = (epoch + 1, first_span, upto, True) if promoted else (epoch, span * 2, upto, False)

    if accepted is None:
        raise ValueError("no batch to replay")
    drifted = D.prediction_drift(reduce(DataFrame.unionAll, scored), "prediction_score", keys=["epoch"], batch=batch)
    predicted = stage(drifted.select(batch, *D.DETAIL, "epoch"), "replay-prediction")
    decided = spark.read.schema(shape).parquet(f"{root}/decided")
    summary = stage(B.monthly_loss(decided.withColumn("baseline_auc", F.lit(baseline)), baseline=baseline), "replay-summary")
    events = spark.createDataFrame(retrained, RETRAINS).withColumnRenamed("batch_id", batch)
    return Replay(details, predicted, summary, events, model, baseline)


def record(
    run: Replay, registry: ModelRegistry, *, name: str, version: str = "1.0.0", batch: str = "batch_id", description: str = "",
    pipeline_path: str = "", thresholds: dict[str, float] | None = None, tags: dict[str, str] | None = None,
    at: dt.datetime | None = None, artifacts: str | None = None,
) -> int:
    """Append a run to the registry: the model, its batches, verdicts and retrainings; returns the model's id.

    With ``artifacts``, a folder, summary, verdicts, retrainings and fleet health are also written as JSON records.
    Summary columns the run does not have (a run without retraining) are left null.
    """
    model_id = registry.register_model(
        name, version, description=description, pipeline_path=pipeline_path, thresholds=thresholds, tags=tags, at=at
    )
    of_model = F.lit(model_id).cast("long").alias("model_id")
    renamed = {
        batch: "batch_id", "overall_drift_score": "drift_score", "overall_severity": "drift_severity", "n_drifted_features": "n_drifted_feats",
        "total_monthly_loss": "roi_monthly_loss", "missed_churners": "roi_missed_churners",
    }
    kept = ["n_samples", "auc_roc", "f1_score", "precision_val", "recall_val", "brier_score", "retrain_triggered"]
    registry.log_batch_metrics(run.summary.select(of_model, *[F.col(c).alias(n) for c, n in renamed.items()], *kept), at)
    registry.log_drift_details(run.details.select(of_model, F.col(batch).alias("batch_id"), *[c for c in D.DETAIL if c != "message"]))
    registry.log_retrain_events(
        run.retrains.select(
            of_model, F.col(batch).alias("trigger_batch"), F.col("retrain_reason").alias("trigger_reason"), "old_auc", "new_auc", "promoted", "promotion_reason"
        ),
        at,
    )
    if artifacts is not None:
        for table, label in ((run.summary, "monitoring_summary"), (run.details, "drift_details"), (run.retrains, "retrain_log")):
            write_json(table, f"{artifacts}/{label}")
        registry.export_fleet(f"{artifacts}/fleet_health")
    return model_id


def alerts_of(run: Replay, when: DataFrame, *, model_id: int = 1, batch: str = "batch_id") -> DataFrame:
    """All alerts of a run with their cooldown; ``when`` has the instant (ts) of every batch."""
    of_model = F.lit(model_id).cast("long").alias("model_id")
    named = run.summary.join(when.select(batch, "ts"), batch).withColumnRenamed(batch, "batch_id")
    drift = named.select(of_model, "batch_id", "ts", "overall_severity", "drifted_features", "overall_drift_score")
    performance = named.select(of_model, "batch_id", "ts", "auc_roc", "f1_score", F.col("retrain_reason").alias("reason"))
    retrained = run.retrains.join(when.select(batch, "ts"), batch).withColumnRenamed(batch, "batch_id")
    retrained = retrained.select(of_model, "batch_id", "ts", "old_auc", "new_auc", "promoted", "promotion_reason")
    return W.alert_cooldown(B.monitoring_alerts(drift, performance, retrained))
