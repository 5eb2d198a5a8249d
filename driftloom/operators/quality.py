"""Model-quality metrics per key (model, batch, slice), all keys in one job.

Scores are collapsed to (key, score) counts before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import thresholds as T
from driftloom.functions.statistics import ratio
from driftloom.operators.ordered import add_bucket, bounds_of, bucket_count, clean, melted_counts, running_sums


def _score_counts(df: DataFrame, label: str, score: str, keys: Sequence[str]) -> DataFrame:
    rows = df.select(*keys, F.col(score).alias("_s"), F.col(label).cast("int").alias("_y")).dropna(subset=["_y"])
    hit, n = F.col("_y") == 1, F.col("n")
    sides = {"pos": F.when(hit, n).otherwise(0), "neg": F.when(hit, 0).otherwise(n)}
    counts = melted_counts(rows, ["_s"], keys, sides, apart=["_y"]).select(*keys, F.col("value").alias("_s"), *sides)
    n = bucket_count(df.sparkSession)
    return add_bucket(counts, F.col("_s"), bounds_of(counts, F.col("_s"), n), n)


def _f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(ratio(2 * precision * recall, precision + recall), F.lit(0.0))


def binary_metrics(
    df: DataFrame, label: str, score: str, *, keys: Sequence[str] = (), threshold: float = T.DEFAULT_THRESHOLD
) -> DataFrame:
    """AUC (mid-rank ties), average precision, precision, recall, F1, Brier and base rates.

    AUC is NULL when a key has one class only; zero divisions give 0.
    """
    group = list(keys)
    s, pos, neg = F.col("_s"), F.col("pos"), F.col("neg")
    ranked = running_sums(_score_counts(df, label, score, group), group, ["_s"], ["pos", "neg"], totals=True)
    neg_below = F.col("neg_cum") - neg
    tp, fp = F.col("pos_all") - F.col("pos_cum") + pos, F.col("neg_all") - neg_below
    chosen = s >= threshold
    sums = ranked.groupBy(*group).agg(
        F.max("pos_all").alias("_p"),
        F.max("neg_all").alias("_n"),
        F.sum(pos * (neg_below + neg / 2)).alias("_pairs"),
        F.sum(pos * ratio(tp, tp + fp)).alias("_ap"),
        F.sum(F.when(chosen, pos).otherwise(0)).alias("_tp"),
        F.sum(F.when(chosen, neg).otherwise(0)).alias("_fp"),
        F.sum(pos * (s - 1) * (s - 1) + neg * s * s).alias("_sq"),
    )
    p, n = F.col("_p"), F.col("_n")
    zero = F.lit(0.0)
    precision = F.coalesce(ratio(F.col("_tp"), F.col("_tp") + F.col("_fp")), zero)
    recall = F.coalesce(ratio(F.col("_tp"), p), zero)
    return sums.select(
        *group,
        (p + n).alias("n_samples"),
        ratio(F.col("_pairs"), p.cast("double") * n).alias("auc_roc"),
        F.coalesce(ratio(F.col("_ap"), p), zero).alias("avg_precision"),
        precision.alias("precision_val"),
        recall.alias("recall_val"),
        _f1(precision, recall).alias("f1_score"),
        ratio(F.col("_sq"), p + n).alias("brier_score"),
        ratio(p, p + n).alias("rate_true"),
        ratio(F.col("_tp") + F.col("_fp"), p + n).alias("rate_pred"),
    )


def baseline_auc(df: DataFrame, label: str, score: str, *, keys: Sequence[str] = (), reference: str = "is_reference") -> DataFrame:
    """AUC of the deployed model on its reference rows, 0.87 where it has none."""
    out = binary_metrics(df.filter(F.col(reference)), label, score, keys=keys)
    return out.select(*keys, F.coalesce("auc_roc", F.lit(T.BASELINE_AUC)).alias("baseline_auc"))


def estimated_auc(prediction_psi: Column, baseline: Column | float = T.BASELINE_AUC) -> Column:
    """Label-free AUC guess from the drift of the scores."""
    baseline = baseline if isinstance(baseline, Column) else F.lit(baseline)
    drop = F.least(prediction_psi * 0.4, F.lit(0.15))
    return F.greatest(baseline - drop, F.lit(0.5))


def regression_metrics(df: DataFrame, truth: str, prediction: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R2, and mean / population std of the predictions."""
    y, p = clean(truth), clean(prediction)
    rows = df.select(*keys, y.alias("_y"), p.alias("_p")).dropna(subset=["_y", "_p"])
    err = F.col("_y") - F.col("_p")
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(err * err).alias("_mse"),
        F.var_pop("_y").alias("_var"),
        F.avg("_p").alias("mean_pred"),
        F.stddev_pop("_p").alias("std_pred"),
    )
    r2 = F.coalesce(1 - ratio(F.col("_mse"), F.col("_var")), F.when(F.col("_mse") == 0, 1.0).otherwise(0.0))
    return sums.select(*keys, "n_samples", "mae", F.sqrt("_mse").alias("rmse"), r2.alias("r2"), "mean_pred", "std_pred")


def class_report(df: DataFrame, label: str, predicted: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class."""
    cells = df.groupBy(*keys, F.col(label).alias("_y"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    hit = F.col("_y") == F.col("_p")
    sides = F.array(
        F.struct(F.col("_y").alias("class"), F.col("_n").alias("actual"), F.lit(0).cast("long").alias("called"),
                 F.when(hit, F.col("_n")).otherwise(0).alias("tp")),
        F.struct(F.col("_p").alias("class"), F.lit(0).cast("long").alias("actual"), F.col("_n").alias("called"),
                 F.lit(0).cast("long").alias("tp")),
    )
    sums = cells.select(*keys, F.inline(sides)).groupBy(*keys, "class").agg(
        F.sum("actual").alias("support"), F.sum("called").alias("_called"), F.sum("tp").alias("_tp")
    )
    precision = F.coalesce(ratio(F.col("_tp"), F.col("_called")), F.lit(0.0))
    recall = F.coalesce(ratio(F.col("_tp"), F.col("support")), F.lit(0.0))
    return sums.select(
        *keys, "class", precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"), "support"
    )
