"""Faults, the benchmark over them, and data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators.overlay import DROP, Edit, Scope, apply_fault
from ..oracle import build as O
from ..plans import evaluate as V
from ..plans import events as E
from ..plans import scenarios as S
from .base import query, r6, results, rounded, sql, table, text

SINCE = Scope("2024-01-20")
_SINCE = "ts >= timestamp '2024-01-20'"


def _fault(spark, sf, edit, scope):
    return apply_fault(table(spark, sf, "events"), edit, scope.where("ts", "event_id"))


def _rows(df):
    return df.select("event_id", text("ts").alias("ts"), "user_id", "event_type", r6("value").alias("value"), "props")


def _sql(where: str, **replaced: str) -> str:
    cols = {"event_id": "event_id", "ts": "cast(ts as varchar)", "user_id": "user_id", "event_type": "event_type", "value": "round(value, 6)", "props": "props"}
    for c, new in replaced.items():
        cols[c] = f"case when {where} then {new} else {c} end"
    if "value" in replaced:
        cols["value"] = f"round({cols['value']}, 6)"
    return "select " + ", ".join(f"{e} as {c}" for c, e in cols.items()) + " from events"


@query("fault_unit_change", _sql(_SINCE, value="round(value * 1.60934e0, 2)"))
def fault_unit_change(spark, sf):
    return _rows(S.inject(table(spark, sf, "events"), "unit-change", "2024-01-20"))


@query("fault_null_spike", _sql(f"{_SINCE} and user_id % 2 = 0", user_id="null"))
def fault_null_spike(spark, sf):
    return _rows(S.inject(table(spark, sf, "events"), "null-spike", "2024-01-20"))


@query("fault_enum_drift", _sql(f"{_SINCE} and event_type = 'view' and {O.share('event_id', 10)}", event_type="'unknown'"))
def fault_enum_drift(spark, sf):
    return _rows(S.inject(table(spark, sf, "events"), "enum-drift", "2024-01-20"))


@query(
    "fault_case_change",
    ("select event_id, case when ts >= timestamp '2024-01-20' then upper(substr(event_type, 1, 1)) || substr(event_type, 2) else event_type end "
        "as capitalised, case when ts >= timestamp '2024-01-20' then lower(upper(event_type)) else upper(event_type) end as lowered from events"),
)
def fault_case_change(spark, sf):
    events = table(spark, sf, "events").withColumn("shout", F.upper("event_type"))
    where = SINCE.where("ts", "event_id")
    out = apply_fault(S.inject(events, "case-change", "2024-01-20"), Edit("lower", "shout"), where)
    return out.select("event_id", F.col("event_type").alias("capitalised"), F.col("shout").alias("lowered"))


@query("fault_row_drop", _sql("true") + f" where not coalesce(({_SINCE} and {O.share('event_id', 20)}), false)")
def fault_row_drop(spark, sf):
    return _rows(_fault(spark, sf, Edit(DROP), Scope("2024-01-20", None, 20)))


@query("fault_precision_loss", _sql("ts >= timestamp '2024-01-20' and ts < timestamp '2024-01-27'", value="round(value, 0)"))
def fault_precision_loss(spark, sf):
    return _rows(_fault(spark, sf, Edit("round", "value", 0), Scope("2024-01-20", "2024-01-27")))


MODEL = S.by_id("flag-logic-break-large-month", "mart-scaling-large-month", "mart-null-large-month")


@query(
    "fault_model_layer",
    sql("select run_id, cast(event_date as varchar) as event_date, event_type, events, round(revenue, 4) as revenue, round(avg_value, 6) as avg_value "
        "from agg_daily_events", O.events_ctes(MODEL)),
)
def fault_model_layer(spark, sf):
    from ..functions.runs import RUNS, run_names

    mart = E.build(table(spark, sf, "events"), MODEL)["agg_daily_events"]
    named = mart.withColumn("run_id", F.explode(run_names(RUNS, E.run_ids(MODEL))))
    return named.select(
        "run_id", text("event_date").alias("event_date"), "event_type", "events",
        rounded("revenue", 4).alias("revenue"), r6("avg_value").alias("avg_value"),
    )


# ---------------------------------------------------------------- the benchmark


def _catalog_sql() -> str:
    def q(v) -> str:
        return "null" if v is None else f"'{v}'"

    rows = [
        f"select '{s.id}' as scenario, '{s.layer}' as layer, '{s.node}' as node, '{s.edit.op if s.edit else 'none'}' as op, "
        f"{q(s.edit.column if s.edit else None)}::varchar as column_name, '{s.magnitude}' as magnitude, '{s.window}' as \"window\", "
        f"{q(s.expected_root)}::varchar as expected_root, '{', '.join(s.expected_columns)}' as expected_columns, "
        f"count(*) filter (where {O.scope(s, 'ts') if s.edit else 'false'}) as rows_touched from events"
        for s in S.catalogue()
    ]
    return " union all ".join(rows)


@query("scenario_catalog", _catalog_sql())
def scenario_catalog(spark, sf):
    """The catalogue with the number of rows each fault touches, all counted in one scan."""
    scenarios = S.catalogue()
    counts = table(spark, sf, "events").agg(
        *[
            F.count_if(s.scope.where("ts", "event_id") if s.edit else F.lit(False)).alias(f"n{i}")
            for i, s in enumerate(scenarios)
        ]
    )
    touched = counts.select(
        F.inline(F.array(*[F.struct(F.lit(s.id).alias("run_id"), F.col(f"n{i}").alias("rows_touched")) for i, s in enumerate(scenarios)]))
    )
    return S.catalogue_frame(spark, scenarios).join(touched, "run_id").select(
        F.col("run_id").alias("scenario"), "layer", "node", "op", "column_name", "magnitude", "window", "expected_root",
        F.concat_ws(", ", "expected_columns").alias("expected_columns"), "rows_touched",
    )


def _eval_ctes() -> dict[str, str]:
    def q(v) -> str:
        return "null" if v is None else f"'{v}'"

    rows = ", ".join(
        f"('{s.id}', '{s.layer}', '{s.magnitude}', '{s.window}', '{s.description}', {q(s.expected_root)}, "
        f"{q(s.expected_columns[0] if s.expected_columns else None)})"
        for s in S.catalogue()
    )
    return {
        **O.events_ctes(S.catalogue()),
        "cat": f'select * from (values {rows}) t(scenario, layer, magnitude, "window", description, expected_root, expected_column)',
        "top": "select * from incidents where incident_rank = 1",
        "alert": "select run_id, first(root order by incident_rank) as root from incidents where sev_rank <= 1 group by 1",
        "scored1": """select c.*, case when layer = 'control' then a.root is not null else t.root is not null end as detected,
            case when layer = 'control' then a.root else t.root end as predicted_root,
            case when layer = 'control' then a.root is null else coalesce(t.root = expected_root, false) end as root_correct,
            coalesce(contains(t.columns, expected_column), false) as named,
            (select count(*) from sig s where s.run_id = c.scenario) as n_signals,
            (select count(*) from incidents i where i.run_id = c.scenario) as n_incidents
            from cat c left join top t on t.run_id = c.scenario left join alert a on a.run_id = c.scenario""",
        "scored2": """select *, case when layer = 'control' or expected_column is null then root_correct else named end as column_correct
            from scored1""",
        "results": """select scenario, layer, magnitude, "window", description, detected, predicted_root, root_correct, column_correct,
            case when layer = 'control' then not detected else detected and root_correct and column_correct end as passed,
            n_signals, n_incidents from scored2""",
    }


EVAL = _eval_ctes()


@query("eval_results", sql("select * from results", EVAL))
def eval_results(spark, sf):
    return results(spark, sf)


@query("control_scenarios", sql("select scenario, detected, n_signals, n_incidents, passed from results where layer = 'control'", EVAL))
def control_scenarios(spark, sf):
    return results(spark, sf).where(F.col("layer") == "control").select("scenario", "detected", "n_signals", "n_incidents", "passed")


_F = "filter (where layer <> 'control' and {0})"


@query(
    "eval_summary",
    sql("select count(*) filter (where layer <> 'control') as total, "
        + ", ".join(f"count(*) {_F.format(c)} as {c}" for c in ("detected", "root_correct", "column_correct", "passed"))
        + f", round(count(*) {_F.format('detected')} / count(*) filter (where layer <> 'control'), 6) as detection_rate"
        + f", round(count(*) {_F.format('passed')} / count(*) filter (where layer <> 'control'), 6) as pass_rate"
        + ", count(*) filter (where layer = 'control') as controls, count(*) filter (where layer = 'control' and detected) as false_positives from results",
        EVAL),
)
def eval_summary(spark, sf):
    s = V.summary(results(spark, sf))
    return s.withColumns({"detection_rate": r6("detection_rate"), "pass_rate": r6("pass_rate")})


@query(
    "eval_breakdown",
    sql(" union all ".join(
        f"select '{d}' as dimension, \"{d}\" as value, count(*) filter (where passed) as passed, count(*) as total from results group by \"{d}\""
        for d in ("magnitude", "window", "layer")), EVAL),
)
def eval_breakdown(spark, sf):
    return V.breakdown(results(spark, sf))


@query("eval_misses", sql("select scenario, description, detected, predicted_root from results where not passed", EVAL))
def eval_misses(spark, sf):
    return V.misses(results(spark, sf))


# ---------------------------------------------------------------- data checks

_STG = ("event_key", "event_id", "user_id", "event_at", "event_type", "value_usd", "prop_k")
_BROKEN = O.events_ctes(S.by_id("null-spike-medium-month", "enum-drift-small-week"))


def _stg(spark, sf, scenario=None):
    events = table(spark, sf, "events")
    if scenario:
        s = S.by_id(scenario)[0]
        events = apply_fault(events, s.edit, s.scope.where("ts", "event_id"))
    return E.staging(events)


@query(
    "check_not_null",
    sql(" union all ".join(
        f"select 'stg_events' as node, '{c}' as column_name, 'not_null' as \"check\", count(*) - count({c}) as failures, count(*) as \"rows\" "
        "from stg_events where run_id = 'null-spike-medium-month'" for c in _STG), _BROKEN),
)
def check_not_null(spark, sf):
    return C.not_null(_stg(spark, sf, "null-spike-medium-month"), "stg_events", _STG)


_DUPLICATED = ("event_key", "user_id")


@query(
    "check_unique",
    sql(" union all ".join(
        f"select 'stg_events' as node, '{c}' as column_name, 'unique' as \"check\", count(*) filter (where v is not null and n > 1) as failures, "
        f"coalesce(sum(n), 0)::bigint as \"rows\" from (select {c} as v, count(*) as n from stg_events where run_id = 'null-spike-medium-month' group by 1)"
        for c in _DUPLICATED), _BROKEN),
)
def check_unique(spark, sf):
    stg = _stg(spark, sf, "null-spike-medium-month")
    return C.all_of([C.unique(stg, "stg_events", c) for c in _DUPLICATED])


_TYPES = ", ".join(f"'{t}'" for t in E.EVENT_TYPES)


@query(
    "check_accepted_values",
    sql(f"select 'stg_events' as node, 'event_type' as column_name, 'accepted_values' as \"check\", count(distinct event_type) filter "
        f"(where event_type not in ({_TYPES})) as failures, count(*) as \"rows\" from stg_events where run_id = 'enum-drift-small-week'", _BROKEN),
)
def check_accepted_values(spark, sf):
    return C.accepted_values(_stg(spark, sf, "enum-drift-small-week"), "stg_events", "event_type", E.EVENT_TYPES)


@query(
    "check_unexpected_values",
    sql(f"select event_type as value_field, count(*) as n_records from stg_events where run_id = 'enum-drift-small-week' "
        f"and event_type not in ({_TYPES}) group by 1", _BROKEN),
)
def check_unexpected_values(spark, sf):
    return C.unexpected_values(_stg(spark, sf, "enum-drift-small-week"), "event_type", E.EVENT_TYPES)


@query(
    "check_singular",
    "select o_custkey, orders, round(spent * 1.000000000001e0, 4) as spent from (select o_custkey, count(*) as orders, sum(o_totalprice) as spent from orders group by 1) "
    "where spent < 300000",
)
def check_singular(spark, sf):
    """Customers whose orders add up to less than the assertion allows: the failing rows."""
    spent = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("spent"))
    return C.singular(spent, F.col("spent") < 300000).withColumn("spent", rounded("spent", 4))


REPORT = {
    "rows with a zero discount": "l_discount = 0",
    "rows with a missing or tiny quantity": "l_quantity is null or l_quantity < 2",
    "rows with a high tax on a cheap part": "l_tax > 0.07e0 and l_extendedprice < 5000",
    "rows outside 1994": "year(l_shipdate) <> 1994",
    "rows cheaper than their quantity": "l_extendedprice < l_quantity * 100",
    "returned rows still open": "l_returnflag = 'R' and l_linestatus = 'O'",
}


@query(
    "quality_report",
    " union all ".join(
        f"select '{n}' as \"check\", count(*) filter (where {p}) as n, count(*) as total, "
        f"round(case when count(*) > 0 then count(*) filter (where {p}) / count(*) * 100 else 0 end, 6) as pct from lineitem"
        for n, p in REPORT.items()
    ),
)
def quality_report(spark, sf):
    return C.quality_report(table(spark, sf, "lineitem"), {n: F.expr(p) for n, p in REPORT.items()})
