"""Thresholds and default settings the results depend on."""

# Drift
PSI_WARNING = 0.10
PSI_CRITICAL = 0.20
KS_P_VALUE = 0.05
JSD_WARNING = 0.05
JSD_CRITICAL = 0.10
WASSERSTEIN_WARNING = 0.10
WASSERSTEIN_CRITICAL = 0.20
CHI2_P_VALUE = 0.05
MIN_SAMPLES = 100
PSI_BINS = 10
JSD_BINS = 20
SMOOTHING = 1e-10
DRIFTED_SHARE_CRITICAL = 0.3

# Model quality
AUC_WARNING = 0.80
AUC_CRITICAL = 0.70
TREND_DROP = 0.05
TREND_LAG = 3
TRIGGER_COOLDOWN = 3
ROLLING_WINDOW = 3
DEFAULT_THRESHOLD = 0.50
FAULT_THRESHOLD = 0.40
BASELINE_AUC = 0.87
MIN_PROMOTION_GAIN = 0.01

# Risk bands
RISK_HIGH = 0.70
RISK_MEDIUM = 0.40

# Alerts
ALERT_COOLDOWN_MINUTES = 30

# Online scoring
WINDOW_SIZE = 1000
CHECK_EVERY = 500
DRIFT_LOG_KEEP = 50

# Business impact
MONTHLY_CUSTOMERS = 5000
AVG_LTV = 3600.0
OUTREACH_COST = 50.0
TRUE_CHURN_RATE = 0.10
OUTREACH_COVERAGE = 0.70
RETENTION_RATE = 0.30
RECALL_SENSITIVITY = 1.8
LOSS_CRITICAL = 50000.0
LOSS_AMBER = 10000.0

# Battery fleet impact
FLEET_SIZE = 10000
WARRANTY_COST = 7000.0
THERMAL_COST = 50000.0
FALSE_POSITIVE_COST = 200.0
YEARLY_FAULT_RATE = 0.02

# Battery limits
VOLTAGE_MIN = 2.5
VOLTAGE_MAX = 4.2
TEMP_MAX = 45.0
NOMINAL_CAPACITY_AH = 2.5
CYCLER_CAPACITY_AH = 2.15
SOH_FAULT = 0.70

# Chemistry limits: chemistry, max voltage, min voltage, max temperature
CHEMISTRY_LIMITS = [
    ("NMC", 4.2, 2.8, 45.0),
    ("LFP", 3.65, 2.5, 55.0),
    ("NCA", 4.18, 2.7, 40.0),
]

# Status thresholds of a registered model
DEFAULT_MODEL_THRESHOLDS = {
    "auc_warning": 0.80,
    "auc_critical": 0.70,
    "f1_warning": 0.75,
    "psi_warning": 0.10,
    "psi_critical": 0.20,
}

TASK_THRESHOLDS = {
    "regression": {
        "mae_warning": 0.05,
        "mae_critical": 0.10,
        "r2_warning": 0.80,
        "r2_critical": 0.60,
        "psi_warning": 0.10,
        "psi_critical": 0.20,
    },
    "classification": {
        "auc_warning": 0.80,
        "auc_critical": 0.70,
        "f1_warning": 0.75,
        "f1_critical": 0.60,
        "psi_warning": 0.10,
        "psi_critical": 0.20,
    },
    "anomaly": {
        "anomaly_rate_warning": 0.05,
        "anomaly_rate_critical": 0.15,
        "psi_warning": 0.10,
        "psi_critical": 0.20,
    },
}
