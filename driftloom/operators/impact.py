"""Cost of degraded models as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import thresholds as T


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def money(value: Column) -> Column:
    """Compact currency text: lakhs from 100000, thousands separators from 1000."""
    size = F.abs(value)
    return (
        F.when(size >= 100000, F.format_string("₹%.1fL", value / 100000))
        .otherwise(F.concat(F.lit("₹"), F.format_number(value, 0)))
    )


def monthly_loss(
    df: DataFrame,
    auc: str = "auc_roc",
    *,
    baseline: Column | float = T.BASELINE_AUC,
    customers: int = T.MONTHLY_CUSTOMERS,
    ltv: float = T.AVG_LTV,
    call_cost: float = T.OUTREACH_COST,
    churn_rate: float = T.TRUE_CHURN_RATE,
    coverage: float = T.OUTREACH_COVERAGE,
    sensitivity: float = T.RECALL_SENSITIVITY,
) -> DataFrame:
    """Monthly and annual loss caused by an AUC below the baseline, with status and headline."""
    pool = int(customers * churn_rate)
    baseline = _col(baseline)
    gap = baseline - F.col(auc)  # unknown without an AUC or a baseline; greatest() would call that no drop
    out = df.withColumn("auc_drop", F.when(gap.isNotNull(), F.greatest(F.lit(0.0), gap)))
    drop = F.col("auc_drop")
    out = out.withColumn("missed_churners", F.floor(pool * F.when(drop.isNotNull(), F.least(drop * sensitivity, F.lit(0.80)))))
    out = out.withColumn("revenue_at_risk", F.col("missed_churners") * T.RETENTION_RATE * ltv)
    calls = F.floor(pool * F.when(drop.isNotNull(), F.least(drop * 1.5, F.lit(0.50))) * coverage)
    out = out.withColumn("wasted_outreach", calls * float(call_cost))
    out = out.withColumn("total_monthly_loss", F.col("revenue_at_risk") + F.col("wasted_outreach"))
    out = out.withColumns(
        {
            "annual_revenue_risk": F.col("revenue_at_risk") * 12,
            "annual_wasted_spend": F.col("wasted_outreach") * 12,
            "total_annual_loss": F.col("total_monthly_loss") * 12,
            "roi_status": F.when(drop == 0, "healthy").when(drop < 0.07, "warning").when(drop.isNotNull(), "critical"),
        }
    )
    month, year = money(F.col("total_monthly_loss")), money(F.col("total_annual_loss"))
    headline = (
        F.when(
            drop == 0,
            F.format_string(
                "Model performing at baseline (AUC %.4f). No measurable revenue impact detected.", F.col(auc)
            ),
        )
        .when(
            drop < 0.03,
            F.format_string(
                "Minor AUC drop of %.4f — est. %d missed churners costing ~%s/month. Monitor closely.",
                drop, F.col("missed_churners"), month,
            ),
        )
        .when(
            drop < 0.07,
            F.format_string(
                "Moderate AUC degradation (%.4f drop). Est. %s/month in lost revenue + wasted outreach. "
                "Schedule retrain this week.", drop, month,
            ),
        )
        .when(
            drop.isNotNull(),
            F.format_string(
                "CRITICAL: AUC dropped %.4f from baseline. Est. %s/month loss (%s/year). Retrain immediately.",
                drop, month, year,
            ),
        )
    )
    return out.withColumn("roi_headline", headline)


def retrain_value(
    df: DataFrame,
    auc: str = "auc_roc",
    *,
    new_auc: Column | None = None,
    baseline: Column | float = T.BASELINE_AUC,
    cost: float = 0.0,
    days: int = 30,
    **business,
) -> DataFrame:
    """Net value of a retrain; the new AUC defaults to min(auc + 0.06, baseline)."""
    baseline = _col(baseline)
    new_auc = F.least(F.col(auc) + 0.06, baseline) if new_auc is None else new_auc
    names = df.columns
    out = df.withColumn("_new", new_auc)
    now = monthly_loss(out, auc, baseline=baseline, **business)
    now = now.select(*names, "_new", F.col("total_monthly_loss").alias("current_loss"))
    then = monthly_loss(now, "_new", baseline=baseline, **business)
    then = then.select(*names, "current_loss", F.col("_new").alias("new_auc"), F.col("total_monthly_loss").alias("new_loss"))
    daily = F.greatest((F.col("current_loss") - F.col("new_loss")) / 30, F.lit(0.0))
    out = then.withColumn("daily_savings", daily)
    daily = F.col("daily_savings")
    out = out.withColumn("gross_savings", daily * days)
    out = out.withColumn("npv", F.col("gross_savings") - cost)
    out = out.withColumn("payback_days", F.when(daily > 0, F.ceil(F.lit(cost) / F.when(daily > 0, daily))))
    out = out.withColumn("should_retrain", (F.col("npv") > 0) | F.lit(cost == 0))
    payback = F.coalesce(F.col("payback_days").cast("string"), F.lit("inf"))
    verdict = F.when(F.col("should_retrain"), F.lit("Retrain is justified.")).otherwise(
        F.concat(
            F.lit("Hold — compute cost ("), money(F.lit(float(cost))), F.lit(f") not recovered within {days} days (payback: "), payback, F.lit(" days).")
        )
    )
    text = F.concat(
        F.lit("Retrain saves est. "), money(daily), F.lit(f"/day. NPV over {days} days: "), money(F.col("npv")), F.lit(". "), verdict
    )
    return out.withColumn("rationale", text)


def battery_cost(
    df: DataFrame,
    *,
    recall: str = "recall_val",
    precision: str = "precision_val",
    soh_mae: str = "soh_mae",
    n_cells: Column | int = T.FLEET_SIZE,
) -> DataFrame:
    """Monthly cost of a fault model: missed faults, needless inspections, thermal risk."""
    n = _col(n_cells)
    faults = n * T.YEARLY_FAULT_RATE / 12
    out = df.withColumns(
        {
            "n_cells_monitored": n,
            "true_faults_per_month": faults,
            "faults_detected": faults * F.col(recall),
            "faults_missed": faults * (1 - F.col(recall)),
        }
    )
    found = F.col("faults_detected")
    out = out.withColumn("false_positives", found / F.greatest(F.col(precision), F.lit(0.01)) - found)
    out = out.withColumns(
        {
            "missed_warranty_cost": F.col("faults_missed") * T.WARRANTY_COST,
            "false_positive_cost": F.col("false_positives") * T.FALSE_POSITIVE_COST,
            "thermal_risk_cost": (F.col(soh_mae) / 0.10) * T.THERMAL_COST * 0.01,
        }
    )
    total = F.col("missed_warranty_cost") + F.col("false_positive_cost") + F.col("thermal_risk_cost")
    return out.withColumn("total_monthly_loss_usd", total).withColumn(
        "annualized_risk_usd", F.col("total_monthly_loss_usd") * 12
    )


def loss_band(loss: Column) -> Column:
    """Band of a monthly loss; an unknown loss has none."""
    known = loss.isNotNull() & ~F.isnan(loss)
    return F.when(known, F.when(loss > T.LOSS_CRITICAL, "critical").when(loss > T.LOSS_AMBER, "amber").otherwise("none"))


def risk_band(score: Column) -> Column:
    """Band of a score; an unknown score has none."""
    known = score.isNotNull() & ~F.isnan(score)
    return F.when(known, F.when(score >= T.RISK_HIGH, "high").when(score >= T.RISK_MEDIUM, "medium").otherwise("low"))


def monitoring_alerts(drift: DataFrame, performance: DataFrame, retrains: DataFrame) -> DataFrame:
    """Alert rows from batch reports, batch metrics and retrain decisions.

    All inputs carry ``model_id``, ``batch_id`` and ``ts``.  Where ``performance`` has a ``reason``, a non-empty one
    becomes a line of the message.
    """
    features = F.col("drifted_features")
    more = F.size(features) - 5
    names = F.concat(
        F.array_join(F.slice(features, 1, 5), ", "),
        F.when(more > 0, F.format_string(" (+%d more)", more)).otherwise(""),
    )
    who = ["model_id", "batch_id", "ts"]
    severe = F.col("overall_severity")
    by_drift = drift.filter(severe.isin("warning", "critical")).select(
        *who,
        F.upper(severe).alias("severity"),
        F.lit("drift").alias("category"),
        F.format_string("Data drift detected — %d feature(s)", F.size(features)).alias("title"),
        F.concat(
            F.format_string("Overall drift score: %.4f\nDrifted features: ", F.col("overall_drift_score")), names
        ).alias("message"),
    )
    auc = F.col("auc_roc")
    why = F.lit("")
    if "reason" in performance.columns:
        why = F.when(F.length("reason") > 0, F.concat(F.lit("\nReason: "), F.col("reason"))).otherwise("")
    by_quality = performance.filter(auc < T.AUC_WARNING).select(
        *who,
        F.when(auc < T.AUC_CRITICAL, "CRITICAL").otherwise("WARNING").alias("severity"),
        F.lit("performance").alias("category"),
        F.format_string("Model performance degradation — Batch %d", F.col("batch_id")).alias("title"),
        F.concat(F.format_string("AUC: %.4f | F1: %.4f", auc, F.col("f1_score")), why).alias("message"),
    )
    state = F.when(F.col("promoted"), "PROMOTED").otherwise("REJECTED")
    by_retrain = retrains.select(
        *who,
        F.when(F.col("promoted"), "INFO").otherwise("WARNING").alias("severity"),
        F.lit("retrain").alias("category"),
        F.concat(F.lit("Retraining complete — Model "), state).alias("title"),
        F.concat(
            F.format_string("Old AUC: %.4f → New AUC: %.4f\nDecision: ", F.col("old_auc"), F.col("new_auc")),
            F.col("promotion_reason"),
        ).alias("message"),
    )
    return by_drift.unionByName(by_quality).unionByName(by_retrain).withColumn(
        "alert_id", F.concat_ws("_", "category", "model_id", "batch_id", F.unix_seconds(F.col("ts").cast("timestamp")))
    ).withColumn("acknowledged", F.lit(False))
