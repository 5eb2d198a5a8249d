"""Registered queries over batch histories, alerts and telemetry, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import profile as A
from driftloom.operators import windows as W
from driftloom.plans.fixtures import rounded, table
from driftloom.plans.quality_queries import ALERTS_SQL, LOSS_SQL, METRICS_SQL, _alert_stream, _loss, batch_metrics

MODEL = ["model_id"]


def telemetry(s, d):
    """Events as battery telemetry: cell = user, order = (ts, event_id)."""
    return table(s, d, "events").select(
        F.col("user_id").alias("cell_id"), "ts", "event_id",
        ((F.col("value") - 245) / 100).alias("current_a"),
        (2.4 + F.col("value") / 250).alias("voltage_v"),
        F.get_json_object("props", "$.k").cast("double").alias("temperature_c"),
        F.dayofmonth("ts").alias("cycle_count"),
        F.col("event_type").alias("test_type"),
    )


TELEMETRY_SQL = """tel as (select user_id as cell_id, ts, event_id, (value - 245) / 100 as current_a, 2.4 + value / 250 as voltage_v,
    (props->>'$.k')::double as temperature_c, day(ts)::int as cycle_count, event_type as test_type, epoch_us(ts) / 1e6::double as sec from events)"""

ORDER = ["ts", "event_id"]
SEQ = ["voltage_v", "current_a", "temperature_c"]


def _fixed(s, d):
    return W.coulomb_fixed_step(telemetry(s, d), cell="cell_id", time="ts", order=ORDER, current="current_a", capacity_ah=0.01)


def _variable(s, d):
    return W.coulomb_variable_step(
        telemetry(s, d), cell="cell_id", time="ts", order=ORDER, current="current_a", capacity_ah=500.0, initial=0.5
    )


def _windows(s, d, step=1):
    rows = W.min_max_scaled(_fixed(s, d), SEQ)
    return W.sequences(
        rows, cell="cell_id", time="ts", order=ORDER, features=[f"{c}_scaled" for c in SEQ], target="soc", length=10, step=step
    )


def _flat(df):
    """Windows as plain columns: first, last and sum of every feature."""
    def total(i):
        return F.aggregate("window", F.lit(0.0), lambda a, r: a + r[i])

    cols = []
    for i, f in enumerate(SEQ):
        cols += [
            F.col("window")[0][i].alias(f"{f}_first"), F.col("window")[9][i].alias(f"{f}_last"),
            total(i).alias(f"{f}_sum"),
        ]
    return rounded(df.select("cell_id", "event_id", "position", F.size("window").alias("length"), *cols, "target"))


SOC_SQL = """fx as (select *, greatest(0.0, least(1.0, 1.0 + sum(current_a * 1.0) over (partition by cell_id order by ts, event_id
    rows unbounded preceding) / (0.01::double * 3600.0::double))) as soc from tel)"""

_lim = ", ".join(f"min({f}) over () as lo_{f}, max({f}) over () as hi_{f}" for f in SEQ)
_scaled = ", ".join(
    f"({f} - lo_{f}) / (case when hi_{f} = lo_{f} then 1.0 else hi_{f} - lo_{f} end) as s_{f}" for f in SEQ
)
_agg = ", ".join(
    f"first_value(s_{f}) over w as {f}_first, s_{f} as {f}_last, sum(s_{f}) over w as {f}_sum" for f in SEQ
)
WINDOWS_SQL = f"""{TELEMETRY_SQL}, {SOC_SQL}, lim as (select *, {_lim} from fx), sc as (select *, {_scaled} from lim),
sq as (select cell_id, ts, event_id, row_number() over (partition by cell_id order by ts, event_id) as position, count(*) over w as length, {_agg}, soc as target
   from sc window w as (partition by cell_id order by ts, event_id rows between 9 preceding and current row))"""
_OUT = ", ".join(f"round({f}_{k}, 6) as {f}_{k}" for f in SEQ for k in ("first", "last", "sum"))

TRIGGER_SQL = """tr as (select *, lag(auc_roc, 3) over (partition by model_id order by batch_id) as before3,
    row_number() over (partition by model_id order by batch_id) as r from bm),
rule as (select *, case when auc_roc < 0.70 then 'auc_floor' when drift_severity in ('warning', 'critical') and auc_roc < 0.80 then 'drift_and_auc'
    when before3 - auc_roc > 0.05 and auc_roc < 0.80 then 'auc_trend' end as rule from tr)"""

LONG_HISTORY_SQL = """ph as (select l_partkey, l_orderkey, l_linenumber, l_discount, l_suppkey, l_quantity, l_extendedprice, l_tax, l_shipdate from lineitem)"""


def _long_history(s, d):
    """One long history: every order in date order, raised when its total is small."""
    rows = table(s, d, "orders").select(
        F.col("o_orderpriority").alias("model_id"), "o_orderkey", (F.col("o_totalprice") < 150000).alias("raised")
    )
    rows = W._numbered(rows, ["model_id"], "o_orderkey")
    return W.apply_cooldown(rows, "raised", keys=["model_id"]).select(
        "model_id", "o_orderkey", F.col("_r").alias("position"), "raised", "fired"
    )


def _fired(s, d):
    return W.alert_cooldown(_alert_stream(s, d))


QUERIES = {
    "W1_rolling_auc": lambda s, d: rounded(
        W.rolling_mean(batch_metrics(s, d), "auc_roc", keys=MODEL).select("model_id", "batch_id", "rolling_auc_roc")
    ),
    "W2_trigger_rules": lambda s, d: W.raw_triggers(batch_metrics(s, d), keys=MODEL).select("model_id", "batch_id", "rule"),
    "W3_trigger_cooldown": lambda s, d: W.retrain_triggers(batch_metrics(s, d), keys=MODEL).select(
        "model_id", "batch_id", "rule", "retrain_triggered"
    ),
    "W3_trigger_reasons": lambda s, d: W.retrain_triggers(batch_metrics(s, d), keys=MODEL).select(
        "model_id", "batch_id", "retrain_reason"
    ),
    "W3_cooldown_long_history": _long_history,
    "W4_alert_cooldown": lambda s, d: _fired(s, d).select("alert_id", "category", "severity", "fired"),
    "W5_coulomb_fixed_step": lambda s, d: rounded(_fixed(s, d).select("event_id", "cell_id", "soc")),
    "W6_coulomb_variable_step": lambda s, d: rounded(_variable(s, d).select("event_id", "cell_id", "cc_capacity_ah", "soc")),
    "W7_cumulative_loss": lambda s, d: rounded(
        W.cumulative(_loss(s, d), "total_monthly_loss", keys=MODEL).select("model_id", "batch_id", "cumulative_total_monthly_loss")
    ),
    "W8_sequences": lambda s, d: _flat(_windows(s, d)),
    "W8_sequences_step_3": lambda s, d: _flat(_windows(s, d, 3)),
    "W9_latest_sequence": lambda s, d: _flat(W.latest_sequence(_windows(s, d), cell="cell_id", order=ORDER)),
    "W10_min_max_scaled": lambda s, d: rounded(
        W.min_max_scaled(telemetry(s, d), SEQ, telemetry(s, d).filter("cycle_count <= 20")).select(
            "event_id", *[f"{f}_scaled" for f in SEQ]
        )
    ),
    "T1_recent_alerts": lambda s, d: _fired(s, d).filter("fired").orderBy(F.desc("ts"), "alert_id").limit(20).select(
        "alert_id", "category", "severity"
    ),
    "A11_fired_alert_counts": lambda s, d: A.count_by_value(
        _fired(s, d).filter("fired"), "severity", ["CRITICAL", "WARNING", "INFO"]
    ),
}

FIRED_SQL = f"""{ALERTS_SQL}, firsts as (select category, severity, ts, min(alert_id) as alert_id from al where severity <> 'CRITICAL' group by all),
chain as (
  select category, severity, min(ts) as ts from firsts group by all
  union all
  select c.category, c.severity, (select min(f.ts) from firsts f where f.category = c.category and f.severity = c.severity
      and f.ts >= c.ts + interval 30 minute) from chain c where c.ts is not null),
fired as (select f.alert_id from firsts f join chain c on f.category = c.category and f.severity = c.severity and f.ts = c.ts),
af as (select *, severity = 'CRITICAL' or alert_id in (select alert_id from fired) as fired from al)"""

COOLDOWN_SQL = """st as (
  select model_id, r, raised, raised as fired, case when raised then 3 else 0 end as left_over from raw where r = 1
  union all
  select n.model_id, n.r, n.raised, s.left_over = 0 and n.raised, case when s.left_over > 0 then s.left_over - 1 when n.raised then 3 else 0 end
  from st s join raw n on n.model_id = s.model_id and n.r = s.r + 1)"""

ORACLE = {
    "W1_rolling_auc": f"""with {METRICS_SQL} select model_id, batch_id, round(case when count(*) over w = 3 then avg(auc_roc) over w end, 6) as rolling_auc_roc
      from bm window w as (partition by model_id order by batch_id rows between 2 preceding and current row)""",
    "W2_trigger_rules": f"with {METRICS_SQL}, {TRIGGER_SQL} select model_id, batch_id, rule from rule",
    "W3_trigger_cooldown": f"""with recursive {METRICS_SQL}, {TRIGGER_SQL}, raw as (select *, rule is not null as raised from rule), {COOLDOWN_SQL}
      select model_id, batch_id, rule, fired as retrain_triggered from raw join st using (model_id, r)""",
    "W3_cooldown_long_history": f"""with recursive raw as (select o_orderpriority as model_id, o_orderkey, o_totalprice < 150000 as raised,
        row_number() over (partition by o_orderpriority order by o_orderkey) as r from orders), {COOLDOWN_SQL}
      select model_id, o_orderkey, r as position, raw.raised, fired from raw join st using (model_id, r)""",
    "W4_alert_cooldown": f"with recursive {FIRED_SQL} select alert_id, category, severity, fired from af",
    "A11_fired_alert_counts": f"""with recursive {FIRED_SQL} select count(*) as total, count(*) filter (severity = 'CRITICAL') as n_critical,
      count(*) filter (severity = 'WARNING') as n_warning, count(*) filter (severity = 'INFO') as n_info from af where fired""",
    "T1_recent_alerts": f"with recursive {FIRED_SQL} select alert_id, category, severity from af where fired order by ts desc, alert_id limit 20",
    "W5_coulomb_fixed_step": f"with {TELEMETRY_SQL}, {SOC_SQL} select event_id, cell_id, round(soc, 6) as soc from fx",
    "W6_coulomb_variable_step": f"""with {TELEMETRY_SQL}, dq as (select *, current_a * coalesce(greatest(0, sec - lag(sec) over w), 0) / 3600.0 as dq from tel
        window w as (partition by cell_id order by ts, event_id)),
      q as (select *, sum(dq) over (partition by cell_id order by ts, event_id rows unbounded preceding) as q from dq)
      select event_id, cell_id, round(q, 6) as cc_capacity_ah, round(greatest(0.0, least(1.0, 0.5 + q / 500)), 6) as soc from q""",
    "W7_cumulative_loss": f"""with {METRICS_SQL}, {LOSS_SQL.format(auc='auc_roc', src='bm')} select model_id, batch_id,
      round(sum(total_monthly_loss) over (partition by model_id order by batch_id), 6) as cumulative_total_monthly_loss from loss""",
    "W8_sequences": f"with {WINDOWS_SQL} select cell_id, event_id, position, length, {_OUT}, round(target, 6) as target from sq where length = 10",
    "W8_sequences_step_3": f"""with {WINDOWS_SQL} select cell_id, event_id, position, length, {_OUT}, round(target, 6) as target from sq
      where length = 10 and (position - 10) % 3 = 0""",
    "W9_latest_sequence": f"""with {WINDOWS_SQL} select cell_id, event_id, position, length, {_OUT}, round(target, 6) as target
      from (select *, max(position) over (partition by cell_id) as last from sq where length = 10) where position = last""",
    "W10_min_max_scaled": f"""with {TELEMETRY_SQL}, m as (select {', '.join(f'min({f}) as lo_{f}, max({f}) as hi_{f}' for f in SEQ)} from tel where cycle_count <= 20)
      select event_id, {', '.join(f'round(({f} - lo_{f}) / (hi_{f} - lo_{f}), 6) as {f}_scaled' for f in SEQ)} from tel, m""",
}

# texts round half up from the shortest decimal form; printf would round from the binary value
_HALF_UP = "round(({0})::varchar::decimal(30, 17), {1})::decimal(30, {1})::varchar"
_NOW, _BEFORE, _FALL = _HALF_UP.format("auc_roc", 4), _HALF_UP.format("before3", 4), _HALF_UP.format("before3 - auc_roc", 3)
ORACLE["W3_trigger_reasons"] = f"""with recursive {METRICS_SQL}, {TRIGGER_SQL}, raw as (select *, rule is not null as raised from rule), {COOLDOWN_SQL}
  select model_id, batch_id, case when not fired then ''
    when rule = 'auc_floor' then 'AUC ' || {_NOW} || ' below critical threshold 0.7'
    when rule = 'drift_and_auc' then 'AUC ' || {_NOW} || ' below warning threshold with ' || drift_severity || ' drift detected'
    else 'Rolling AUC drop: ' || {_BEFORE} || '→' || {_NOW} || ' (' || {_FALL} || ' over 3 batches)' end as retrain_reason
  from raw join st using (model_id, r)"""
