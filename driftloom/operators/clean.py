"""Cleaning and normalisation of raw telemetry and tabular data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from driftloom.functions import thresholds as T
from driftloom.functions.statistics import clip
from driftloom.operators.ordered import clean, exact_quantiles
from driftloom.operators.windows import coulomb_fixed_step

# Raw column names accepted for each standard column, in order of preference.
COLUMN_ALIASES = {
    "Voltage_V": [
        "voltage", "voltage_v", "v", "vt", "volt", "voltage(v)", "voltage_measured", "terminal_voltage",
        "pack_voltage", "cell_voltage", "u", "ux",
    ],
    "Current_A": [
        "current", "current_a", "i", "current(a)", "current_measured", "pack_current", "cell_current", "i_a",
        "current_ma",
    ],
    "Temperature_C": [
        "temperature", "temperature_c", "temp", "t", "temp_c", "temperature (c)", "temperature_measured", "t_c",
        "cell_temp", "surface_temp", "ambient_temp",
    ],
    "soc_true": [
        "soc", "soc_true", "soc_zhhu", "soc_zhu", "state_of_charge", "soc_ref", "soc_label", "reference_soc",
        "true_soc", "rel_soc", "capacity_soc", "soc(%)",
    ],
    "soh": ["soh", "state_of_health", "health", "capacity_ratio", "relative_capacity", "normalized_capacity"],
    "cycle_count": ["cycle", "cycle_count", "cycle_number", "cycles", "charge_cycle", "cycle_index", "cyc"],
    "internal_resistance_mohm": [
        "resistance", "internal_resistance", "r_int", "rint", "internal_resistance_mohm", "ohmic_resistance",
    ],
    "charge_rate_c": ["c_rate", "charge_rate", "charge_rate_c", "crate"],
}


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def find_column(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """First alias that equals a column, else first alias of 3+ letters inside one."""
    by_name = {c.lower().strip(): c for c in columns}
    exact = next((by_name[a] for a in aliases if a in by_name), None)
    if exact is not None:
        return exact
    return next((c for a in aliases if len(a) >= 3 for low, c in by_name.items() if a in low), None)


def resolve_columns(columns: Sequence[str], taken: Sequence[str] = ()) -> dict[str, str | None]:
    """Standard column -> raw column (None if missing); looks at names only."""
    free = [c for c in columns if c not in taken]
    return {std: find_column(free, aliases) for std, aliases in COLUMN_ALIASES.items()}


@dataclass
class Normalised:
    """The normalised table and where each column came from."""

    df: DataFrame
    mapped: dict[str, str] = field(default_factory=dict)
    derived: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)


def correct_units(df: DataFrame, *, current: str | None = None, soc: str | None = None, soh: str | None = None) -> DataFrame:
    """mA to A above 200, percent to share above 1.5, judged by the whole column's maximum."""
    rules = [(current, 200.0, 1000.0), (soc, 1.5, 100.0), (soh, 1.5, 100.0)]
    rules = [r for r in rules if r[0]]
    peaks = df.agg(F.struct(*[F.max(F.abs(clean(c)) if c == current else clean(c)).alias(c) for c, _, _ in rules])).scalar()
    fixed = {
        c: F.when(F.col(f"_peaks.{c}") > limit, F.col(c) / by).otherwise(F.col(c)) for c, limit, by in rules
    }
    return df.withColumn("_peaks", peaks).withColumns(fixed).drop("_peaks")


def derive_soh(df: DataFrame, *, soc: str = "soc_true", cycle: str | None = "cycle_count") -> Column:
    """Linear fade over cycles when any cycle was counted, else a proxy from the state of charge."""
    proxy = clip(1.0 - (1.0 - F.col(soc)) * 0.1, 0.5, 1.0)
    if cycle is None:
        return proxy
    last = df.agg(F.max(clean(cycle))).scalar()
    return F.when(last > 0, clip(1.0 - 0.0002 * F.col(cycle), 0.5, 1.0)).otherwise(proxy)


def fault_label(
    *, voltage: Column | None, temperature: Column | None, soh: Column,
    v_min: float = T.VOLTAGE_MIN, v_max: float = T.VOLTAGE_MAX, t_max: float = T.TEMP_MAX,
) -> Column:
    """1 outside the voltage, temperature or health limits; a missing reading is no fault."""
    checks = [soh < T.SOH_FAULT]
    if voltage is not None:
        checks += [voltage < v_min, voltage > v_max]
    if temperature is not None:
        checks += [temperature > t_max]
    flags = [F.coalesce(c, F.lit(False)).cast("int") for c in checks]
    return F.greatest(*flags) if len(flags) > 1 else flags[0]


def normalise(
    df: DataFrame,
    *,
    cell: str | None = None,
    cell_id: str = "cell_001",
    time: str | None = None,
    order: Sequence[str] = (),
    nominal_capacity: float = T.NOMINAL_CAPACITY_AH,
    v_min: float = T.VOLTAGE_MIN,
    v_max: float = T.VOLTAGE_MAX,
    t_max: float = T.TEMP_MAX,
    impute: bool = True,
) -> Normalised:
    """Raw battery rows to the standard schema.

    ``cell``, ``time`` and ``order`` name the raw key columns; they are kept,
    and are needed when the state of charge must be counted from the current.
    """
    keep = [c for c in dict.fromkeys([cell, time, *order]) if c]
    found = resolve_columns(df.columns, keep)
    out = df.select(
        *[quoted(c) for c in keep],
        *[
            F.when(~F.isnan(quoted(raw).cast("double")), quoted(raw).cast("double")).alias(std)
            for std, raw in found.items()
            if raw
        ],
    )
    result = Normalised(
        out, {std: raw for std, raw in found.items() if raw}, [], [std for std, raw in found.items() if not raw]
    )
    has = set(result.mapped)
    scaled = {
        "current": "Current_A" if "Current_A" in has else None,
        "soc": "soc_true" if "soc_true" in has else None,
        "soh": "soh" if "soh" in has else None,
    }
    if any(scaled.values()):
        out = correct_units(out, **scaled)

    if "soc_true" not in has:
        if "Current_A" in has and cell and time:
            counted = out.withColumn("_i", F.coalesce("Current_A", F.lit(0.0)))
            out = coulomb_fixed_step(
                counted, cell=cell, time=time, order=list(order) or [time], current="_i", capacity_ah=nominal_capacity,
                out="soc_true",
            ).drop("_i")
            result.derived.append("soc_true")
        else:
            out = out.withColumn("soc_true", F.lit(0.5))
    out = out.withColumn("soc_true", clip(F.col("soc_true"), 0.0, 1.0))

    if "soh" not in has:
        out = out.withColumn("soh", derive_soh(out, cycle="cycle_count" if "cycle_count" in has else None))
        result.derived.append("soh")

    volts = F.col("Voltage_V") if "Voltage_V" in has else None
    heat = F.col("Temperature_C") if "Temperature_C" in has else None
    out = out.withColumn(
        "fault_label", fault_label(voltage=volts, temperature=heat, soh=F.col("soh"), v_min=v_min, v_max=v_max, t_max=t_max)
    )
    result.derived.append("fault_label")

    if "cycle_count" not in has:
        out = out.withColumn("cycle_count", F.lit(0.0))
    out = out.withColumn("calendar_age_days", F.floor(F.col("cycle_count") * 1.5).cast("int"))
    if "internal_resistance_mohm" not in has:
        out = out.withColumn("internal_resistance_mohm", 10.0 + F.col("cycle_count") * 0.0003)
    if "charge_rate_c" not in has:
        rate = clip(F.abs(F.col("Current_A")) / nominal_capacity, 0.1, 5.0) if "Current_A" in has else F.lit(0.5)
        out = out.withColumn("charge_rate_c", rate)
    out = out.withColumns(
        {
            "capacity_fade_pct": clip((1.0 - F.col("soh")) * 100, 0.0, 100.0),
            "soc": F.col("soc_true"),
            "cell_id": F.col(cell) if cell else F.lit(cell_id),
        }
    )
    if impute:
        numeric = [f.name for f in out.schema.fields if isinstance(f.dataType, NumericType) and f.name not in keep
                   and f.name not in ("fault_label", "calendar_age_days", "cell_id")]
        out = impute_median(out, numeric)
    result.df = out
    return result


def impute_median(df: DataFrame, columns: Sequence[str], *, keep_types: bool = False) -> DataFrame:
    """Fill NULL and NaN with the column's exact median, as doubles or in the column's own type."""
    medians = exact_quantiles(df.withColumn("_all", F.lit(1)), columns, ["_all"], {"median": 0.5})
    table = medians.agg(F.map_from_entries(F.collect_list(F.struct("feature", "median")))).scalar()
    types = dict(df.dtypes)

    def fill(c: str) -> Column:
        median = F.element_at(F.col("_medians"), c)
        if not keep_types:
            return F.coalesce(clean(c), median)
        own = F.col(c) if types[c] not in ("double", "float") else F.when(~F.isnan(c), F.col(c))
        return F.coalesce(own, median.cast(types[c]))

    filled = {c: fill(c) for c in columns}
    return df.withColumn("_medians", table).withColumns(filled).drop("_medians")


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Without the index columns a spreadsheet export leaves behind."""
    return df.select(*[quoted(c) for c in df.columns if not c.startswith("Unnamed")])


def thermal_risk(
    df: DataFrame, *, chemistry: str, temperature: str, c_rate: str, soh: str, voltage: str
) -> DataFrame:
    """Thermal risk score and fault flag against the limits of the cell's chemistry."""
    spark = df.sparkSession
    # three fixed rows, so the broadcast is bounded
    limits = spark.createDataFrame(T.CHEMISTRY_LIMITS, f"{chemistry} string, _vmax double, _vmin double, _tmax double")
    heat = F.greatest(F.lit(0.0), (F.col(temperature) - F.col("_tmax")) / 20) * 0.5
    speed = F.greatest(F.lit(0.0), F.col(c_rate) - 2.0) / 3.0 * 0.3
    age = F.greatest(F.lit(0.0), (1.0 - F.col(soh)) - 0.3) * 0.2
    out = df.join(F.broadcast(limits), chemistry, "left").withColumn(
        "thermal_runaway_risk", clip(heat + speed + age, 0.0, 1.0)
    )
    fault = (
        (F.col("thermal_runaway_risk") > 0.10)
        | (F.col(soh) < T.SOH_FAULT)
        | (F.col(voltage) < F.col("_vmin"))
        | (F.col(voltage) > F.col("_vmax"))
    )
    return out.withColumn("fault_label", F.coalesce(fault, F.lit(False)).cast("int")).drop("_vmax", "_vmin", "_tmax")


def cycler_features(
    df: DataFrame, *, voltage: str = "voltage_v", current: str = "current_a", temperature: str = "temperature_c"
) -> DataFrame:
    """Power and temperature columns beside the counted charge."""
    return df.withColumns(
        {"power_w": F.col(voltage) * F.col(current), "temperature_degc": F.col(temperature).cast("double")}
    )


# Row validation ------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A column must be present and, if given, within [lo, hi] and among ``allowed``."""

    column: str
    lo: float | None = None
    hi: float | None = None
    allowed: tuple[str, ...] = ()

    def failures(self) -> list[Column]:
        c = F.col(self.column)
        out = [F.when(c.isNull(), F.lit(f"{self.column}: missing"))]
        if self.lo is not None:
            out.append(F.when(c < self.lo, F.lit(f"{self.column}: below {self.lo:g}")))
        if self.hi is not None:
            out.append(F.when(c > self.hi, F.lit(f"{self.column}: above {self.hi:g}")))
        if self.allowed:
            out.append(F.when(~c.isin(*self.allowed), F.lit(f"{self.column}: not allowed")))
        return out


# Request limits of the churn table.
YES_NO = ("Yes", "No")
CHURN_RULES = [
    Rule("tenure", 0, 100),
    Rule("monthly_charges", 0, 500),
    Rule("total_charges", 0),
    Rule("num_products", 1, 10),
    Rule("num_support_calls", 0, 50),
    Rule("avg_call_duration", 0),
    Rule("days_since_last_login", 0),
    Rule("data_usage_gb", 0),
    Rule("billing_amount_variance", 0),
    Rule("customer_lifetime_value", 0),
    Rule("contract_type", allowed=("Month-to-month", "One year", "Two year")),
    Rule("payment_method", allowed=("Electronic check", "Mailed check", "Bank transfer", "Credit card")),
    Rule("internet_service", allowed=("DSL", "Fiber optic", "No")),
    Rule("tech_support", allowed=YES_NO),
    Rule("online_security", allowed=YES_NO),
    Rule("paperless_billing", allowed=YES_NO),
]


def validate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add the list of broken rules and ``is_valid``."""
    broken = F.array_compact(F.array(*[c for r in rules for c in r.failures()]))
    return df.withColumn("violations", broken).withColumn("is_valid", F.size("violations") == 0)


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the quarantined rows with their violations."""
    checked = validate(df, rules)
    return checked.filter("is_valid").drop("violations", "is_valid"), checked.filter("not is_valid").drop("is_valid")


def labelled(df: DataFrame, target: str) -> DataFrame:
    return df.dropna(subset=[target])


def select_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Only the listed columns that exist."""
    present = set(df.columns)
    return df.select(*[f for f in features if f in present])
