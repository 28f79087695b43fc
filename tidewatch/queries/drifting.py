"""Drift between runs and against a run's own past."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import drift as D
from ..operators import profile as P
from ..operators import report as R
from ..operators import rolling as W
from ..oracle import build as O
from ..session import materialise
from ..settings import DEFAULT_THRESHOLDS, Settings
from .base import CTES, ROLLING, RUNS, SIGNAL_SQL, observed, once, query, r6, rounded, signal_view, sql, table, text
from .profiling import HISTORY, _history

_KEYS = "run_id, model_name, column_name"


@query("drift_whole_table", sql(f"select {SIGNAL_SQL} from whole_sig"))
def drift_whole_table(spark, sf):
    seen = observed(spark, sf)
    return signal_view(D.whole_table_signals(seen.columns, seen.pairs))


@query("drift_bounds", sql(f"select {SIGNAL_SQL} from bound_sig"))
def drift_bounds(spark, sf):
    seen = observed(spark, sf)
    return signal_view(D.bound_signals(seen.columns, seen.pairs))


@query("drift_per_day", sql(f"select {SIGNAL_SQL} from day_sig"))
def drift_per_day(spark, sf):
    seen = observed(spark, sf)
    return signal_view(D.per_day_signals(seen.partitions, seen.pairs))


@query("drift_previous_run", sql(f"select {SIGNAL_SQL} from sig"))
def drift_previous_run(spark, sf):
    seen = observed(spark, sf)
    return signal_view(D.previous_run(seen.columns, seen.partitions, seen.pairs))


# A later run of two tables that lost a column and some days each, and of one that is gone.
_LATER = {
    "events": ("props", "day(ts) not between 11 and 13"),
    "orders": ("o_orderpriority", "year(o_orderdate) <> 1999 or month(o_orderdate) > 6"),
}
_AXIS = {"events": "ts", "orders": "o_orderdate"}


def _missing_sql() -> str:
    parts = []
    for node, (column, keep) in _LATER.items():
        axis, kept = _AXIS[node], keep.replace("day(", "dayofmonth(")
        days = f"select distinct cast({axis} as date) as d from {node} where {axis} is not null"
        parts.append(
            f"select '{node}' as model_name, '{column}' as column_name, 'vanished_column' as metric, 'high' as severity, 0 as partitions, "
            f"null::varchar as first_partition, (select count(*) from {node})::double as baseline_value, null::double as current_value, 1e0 as change"
        )
        gone = f"select d from ({days}) where d not in (select cast({axis} as date) from {node} where {axis} is not null and ({kept}))"
        parts.append(
            f"select '{node}', '(table)', 'vanished_days', {O.grade('round(n / total, 9)', '0.02')}, n::int, first, total::double, "
            f"(total - n)::double, round(n / total, 6) from (select (select count(*) from ({days})) as total, count(*) as n, "
            f"cast(min(d) as varchar) as first from ({gone})) where n > 0"
        )
    parts.append(
        "select 'region', '(table)', 'vanished_table', 'critical', 0, null, (select count(*) from region)::double, null, 1.0"
    )
    return " union all ".join(parts)


@query("drift_missing", _missing_sql())
def drift_missing(spark, sf):
    tables = {n: table(spark, sf, n) for n in (*_LATER, "region")}
    later = {n: tables[n].where(keep).drop(column) for n, (column, keep) in _LATER.items()}
    runs = [P.profile_nodes(nodes, runs=[run]) for run, nodes in (("before", tables), ("after", later))]
    seen = materialise(runs[0].unionByName(runs[1]), "runs")
    found = D.missing_signals(P.column_profiles(seen), P.partition_profiles(seen), D.run_pairs(spark, [("before", "after")]))
    return signal_view(found).drop("run_id", "baseline_text", "current_text")


@query(
    "relative_change",
    sql("select run_id, model_name, column_name, metric, cast(partition_value as varchar) as partition_value, "
        "round(baseline_value, 6) as baseline_value, round(current_value, 6) as current_value, round(change, 6) as change from day_checks"),
)
def relative_change(spark, sf):
    seen = observed(spark, sf)
    rows = D.daily_checks(seen.partitions, seen.pairs)
    change = X.metric_change(F.col("metric"), F.col("baseline_value"), F.col("current_value"))
    return rows.select(
        "run_id", "model_name", "column_name", "metric", text("partition_value").alias("partition_value"),
        r6("baseline_value").alias("baseline_value"), r6("current_value").alias("current_value"), r6(change).alias("change"),
    )


# Overrides in file order: a later matching pattern wins.
STRICT = Settings(
    overrides={
        "*": {"row_count": 0.15},
        "agg_*": {"mean_value": 0.30, "row_count": 0.001},
        "fct_[a-m]*": {"distinct_count": 0.02},
        "stg_?vents": {"null_rate": 0.5},
    }
)
_STRICT_SQL = (
    "case when metric = 'null_rate' and model_name = 'stg_events' then 0.5 "
    "when metric = 'distinct_count' and model_name = 'fct_events' then 0.02 "
    "when metric = 'mean_value' and model_name like 'agg\\_%' escape '\\' then 0.30 "
    "when metric = 'row_count' and model_name like 'agg\\_%' escape '\\' then 0.001 "
    "when metric = 'row_count' then 0.15 "
    "when metric = 'null_rate' then 0.01 when metric = 'distinct_count' then 0.10 else 0.05 end"
)


@query(
    "thresholds_resolved",
    sql(f"select model_name, metric, lim as threshold, count(*) as comparisons, count(*) filter (where round(change, 9) >= lim) as over "
        f"from (select *, {_STRICT_SQL} as lim from day_checks) group by 1, 2, 3"),
)
def thresholds_resolved(spark, sf):
    seen = observed(spark, sf)
    limit = STRICT.limit(F.col("model_name"), F.col("metric"))
    rows = D.daily_checks(seen.partitions, seen.pairs).withColumn("threshold", limit)
    over = F.count_if(X.settled(F.col("change")) >= F.col("threshold"))
    return rows.groupBy("model_name", "metric", "threshold").agg(F.count(F.lit(1)).alias("comparisons"), over.alias("over"))


STRICT_CTES = O.events_ctes(RUNS, _STRICT_SQL, "regexp_matches(lower(column_name), '^event_.*$')")


@query("drift_overrides", sql(f"select {SIGNAL_SQL} from sig", STRICT_CTES))
def drift_overrides(spark, sf):
    """Per-node limits and masked bounds together."""
    seen = observed(spark, sf)
    settings = Settings(overrides=STRICT.overrides, mask_values=("EVENT_*",))
    return signal_view(D.previous_run(seen.columns, seen.partitions, seen.pairs, settings))


@query(
    "severity_grade",
    sql(f"select run_id, severity, metric, count(*) as signals, round(max(change / {O.LIMITS}), 6) as times_limit from sig "
        "where metric not in ('min_value', 'max_value') group by 1, 2, 3"),
)
def severity_grade(spark, sf):
    signals = observed(spark, sf).signals.where(~F.col("metric").isin("min_value", "max_value"))
    settings = Settings(thresholds=DEFAULT_THRESHOLDS)
    limit = settings.limit(F.col("model_name"), F.col("metric"))
    graded = signals.withColumns(
        {"times": F.col("change") / limit, "severity": settings.grade(X.settled(F.col("change")), limit)}
    )
    return graded.groupBy("run_id", "severity", "metric").agg(
        F.count(F.lit(1)).alias("signals"), r6(F.max("times")).alias("times_limit")
    )


@query(
    "severity_at_or_above",
    sql("select run_id, count(*) filter (where severity = 'critical') as at_critical, "
        "count(*) filter (where severity in ('critical', 'high')) as at_high, count(*) as at_warning from sig group by 1"),
)
def severity_at_or_above(spark, sf):
    level = F.col("severity")
    counts = {f"at_{s}": F.count_if(X.at_or_above(level, s)) for s in ("critical", "high", "warning")}
    return observed(spark, sf).signals.groupBy("run_id").agg(*[c.alias(n) for n, c in counts.items()])


_RANKED = f"{O.RANK}, round(change, 9) desc, model_name, column_name, metric, partitions"


@query(
    "signals_ranked",
    sql(f"select {SIGNAL_SQL}, row_number() over (partition by run_id order by {_RANKED}) as position from sig order by run_id, position"),
)
def signals_ranked(spark, sf):
    numbered = D.numbered(observed(spark, sf).signals).orderBy("run_id", "position")
    return numbered.select(*signal_view(numbered).columns, "position").withColumns(
        {c: r6(c) for c in ("baseline_value", "current_value", "change")}
    )


@query(
    "top_movers",
    sql(f"select {SIGNAL_SQL} from (select * from sig where run_id = (select run_id from started order by started_at desc limit 1) "
        "order by round(change, 9) desc, model_name, column_name, metric, partitions limit 10)", HISTORY),
)
def top_movers(spark, sf):
    """The ten largest changes of the latest run of the history."""
    latest = R.latest_runs(_history(spark, sf).read("profile_runs"), 1).select("run_id")
    signals = observed(spark, sf).signals.join(latest, "run_id", "left_semi")
    return signal_view(signals.orderBy(F.desc(X.settled(F.col("change"))), "model_name", "column_name", "metric", "partitions").limit(10))


VOLUME = {
    **CTES,
    "v": "select run_id, sum(n)::bigint as n from (select run_id, model_name, max(row_count) as n from cp group by 1, 2) group by 1",
}


@query(
    "volume_mismatch",
    sql("select b.run_id as baseline_run_id, c.run_id, b.n as baseline_rows, c.n as current_rows from v b join v c on b.run_id = 'baseline' "
        "and c.run_id <> 'baseline' where b.n > 0 and c.n > 0 and (c.n / b.n > 1.02 or c.n / b.n < 1 / 1.02)", VOLUME),
)
def volume_mismatch(spark, sf):
    seen = observed(spark, sf)
    return D.volume_mismatch(seen.columns, seen.pairs, tolerance=0.02)


# ---------------------------------------------------------------- rolling

ROLL = Settings(baseline_mode="rolling")


def _points(seen):
    return W.volume_series(seen.partitions).unionByName(W.column_series(seen.partitions, ROLL))


def _point_view(rows, *columns):
    return rows.select("run_id", "model_name", "column_name", "metric", text("partition_value").alias("partition_value"), *columns)


_POINT = f"{_KEYS}, metric, cast(partition_value as varchar) as partition_value"


@query("rolling_history", sql(f"select {_POINT}, n_hist::int as history_points, n_points from scored0", ROLLING))
def rolling_history(spark, sf):
    rows = W.scored(_points(observed(spark, sf)), ROLL)
    return _point_view(rows, F.size("history").alias("history_points"), F.col("_points").alias("n_points"))


@query("rolling_median_mad", sql(f"select {_POINT}, round(median, 6) as median, round(mad, 6) as mad from scored0 where n_hist > 0", ROLLING))
def rolling_median_mad(spark, sf):
    rows = W.scored(_points(observed(spark, sf)), ROLL).where(F.size("history") > 0)
    return _point_view(rows, r6("median").alias("median"), r6("mad").alias("mad"))


# A flat history at zero makes z as large as 1e11, where floats differ in digits behind the
# point: scores are shown with nine significant digits.
_STEP = "pow(10.0, floor(log10(greatest(z, 1))) - 8)"
_Z = f"case when isnan(z) or isinf(z) then z else round(z / {_STEP}) * {_STEP} end as z, round(ln(1 + z), 6) as log_z"


def _z():
    z = F.col("z")
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(z, F.lit(1.0)))) - 8)
    return [F.when(X.is_finite(z), F.round(z / step) * step).otherwise(z).alias("z"), r6(F.log(1 + z)).alias("log_z")]


@query("robust_z", sql(f"select {_POINT}, {_Z} from scored where n_hist >= 14 and value is not null", ROLLING))
def robust_z(spark, sf):
    rows = W.scored(_points(observed(spark, sf)), ROLL)
    kept = rows.where((F.size("history") >= ROLL.min_history) & F.col("value").isNotNull())
    return _point_view(kept, *_z())


@query("rolling_flags", sql(f"select {_POINT}, round(value, 6) as value, round(median, 6) as median, {_Z} from flags", ROLLING))
def rolling_flags(spark, sf):
    rows = W.flags(_points(observed(spark, sf)), ROLL)
    return _point_view(rows, r6("value").alias("value"), r6("median").alias("median"), *_z())


# A higher share than the default, so that ordinary uneven days are dropped too.
SPARSE = Settings(min_partition_share=0.95)
_SPARSE = {**ROLLING, "long_enough": ROLLING["long_enough"].replace("typ * 0.2", "typ * 0.95")}


@query("rolling_dense_days", sql("select run_id, model_name, column_name, cast(partition_value as varchar) as partition_value, row_count from dense", _SPARSE))
def rolling_dense_days(spark, sf):
    rows = W.dense_days(observed(spark, sf).partitions, SPARSE)
    return rows.select("run_id", "model_name", "column_name", text("partition_value").alias("partition_value"), "row_count")


def _rolled(spark, sf):
    return once(spark, ("rolled", sf), lambda: materialise(W.rolling(observed(spark, sf).partitions, ROLL), "rolling"))


@query("rolling_volume", sql(f"select {SIGNAL_SQL} from roll where column_name = '(table)'", ROLLING))
def rolling_volume(spark, sf):
    points = W.volume_series(observed(spark, sf).partitions)
    return signal_view(W.signals_of(W.flags(points, ROLL), ROLL))


@query("rolling_columns", sql(f"select {SIGNAL_SQL} from roll where column_name <> '(table)'", ROLLING))
def rolling_columns(spark, sf):
    points = W.column_series(observed(spark, sf).partitions, ROLL)
    return signal_view(W.signals_of(W.flags(points, ROLL), ROLL))


@query("rolling_signals", sql(f"select {SIGNAL_SQL} from roll where run_id <> 'baseline'", ROLLING))
def rolling_signals(spark, sf):
    return signal_view(_rolled(spark, sf)).where(F.col("run_id") != "baseline")


@query("drift_rolling", sql(f"select {SIGNAL_SQL} from roll", ROLLING))
def drift_rolling(spark, sf):
    return signal_view(_rolled(spark, sf))
