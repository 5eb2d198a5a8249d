"""Schemas of the stored tables."""

MODELS = (
    "model_id bigint, name string, version string, description string, pipeline_path string, "
    "thresholds map<string,double>, tags map<string,string>, registered_at timestamp"
)
MODEL_STATUS = "model_id bigint, status string, at timestamp, seq bigint"
BATCH_METRICS = (
    "id bigint, model_id bigint, batch_id bigint, recorded_at timestamp, auc_roc double, f1_score double, "
    "precision_val double, recall_val double, brier_score double, drift_score double, drift_severity string, "
    "n_drifted_feats bigint, n_samples bigint, retrain_triggered boolean, roi_monthly_loss double, "
    "roi_missed_churners bigint, extra_json string"
)
RETRAIN_LOG = (
    "id bigint, model_id bigint, triggered_at timestamp, trigger_batch bigint, trigger_reason string, old_auc double, "
    "new_auc double, promoted boolean, promotion_reason string, run_id string"
)
BATTERY_FEATURES = [
    "cycle_count", "soc", "voltage", "current_a", "charge_rate_c", "temperature_c", "internal_resistance_mohm",
    "capacity_fade_pct", "calendar_age_days",
]
DRIFT_DETAILS = (
    "model_id bigint, batch_id bigint, feature string, method string, score double, p_value double, "
    "severity string, is_drifted boolean"
)
DATASETS = (
    "dataset_id bigint, name string, version string, domain string, description string, file_path string, "
    "n_rows bigint, n_cols int, columns array<string>, column_types map<string,string>, tags map<string,string>, "
    "registered_at timestamp, target_column string"
)
CLASS_BALANCE = "dataset_id bigint, class string, n bigint, share double"
DATASET_STATUS = "dataset_id bigint, status string, at timestamp, seq bigint"
DATASET_STATS = (
    "dataset_id bigint, column_name string, dtype string, mean double, std double, min double, max double, "
    "p25 double, p50 double, p75 double, null_count bigint, unique_count bigint, top_values array<string>"
)
ALERTS = (
    "alert_id string, model_id bigint, batch_id bigint, ts timestamp, severity string, category string, "
    "title string, message string, acknowledged boolean"
)
DRIFT_LOG = (
    "window_id bigint, predictions_at_check bigint, window_size bigint, drift_severity string, drift_score double, "
    "n_drifted_features bigint, drifted_features array<string>, prediction_psi double, estimated_auc double, "
    "roi_monthly_loss double, roi_status string, roi_headline string"
)
CHURN = (
    "tenure int, monthly_charges double, total_charges double, num_products int, num_support_calls int, "
    "avg_call_duration double, days_since_last_login int, data_usage_gb double, billing_amount_variance double, "
    "customer_lifetime_value double, contract_type string, payment_method string, internet_service string, "
    "tech_support string, online_security string, paperless_billing string, churn int, batch_id int, drift_type string"
)
CHURN_NUMERIC = [
    "tenure", "monthly_charges", "total_charges", "num_products", "num_support_calls", "avg_call_duration",
    "days_since_last_login", "data_usage_gb", "billing_amount_variance", "customer_lifetime_value",
]
CHURN_CATEGORICAL = [
    "contract_type", "payment_method", "internet_service", "tech_support", "online_security", "paperless_billing",
]
BATTERY = (
    "cell_id string, chemistry string, cycle_count int, calendar_age_days int, soh double, soc double, voltage double, "
    "current_a double, charge_rate_c double, temperature_c double, internal_resistance_mohm double, "
    "capacity_fade_pct double, thermal_runaway_risk double, fault_label int, batch_id int, drift_type string"
)
