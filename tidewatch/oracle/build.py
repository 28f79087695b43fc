"""Plain SQL for the same results, written per run and per column.

Deliberately naive: every run is its own copy of the rows and every column its own
aggregate, so that nothing of the Spark plans is shared with what checks them.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..plans.scenarios import BASELINE, Scenario

LIMITS = "case metric when 'row_count' then 0.02 when 'null_rate' then 0.01 when 'distinct_count' then 0.10 else 0.05 end"
RANK = "case severity when 'critical' then 0 when 'high' then 1 else 2 end"


def rel(b: str, c: str) -> str:
    return (
        f"case when {b} is null or {b} = 0 then case when {c} is null or {c} = 0 then 0.0 else 1.0 end "
        f"when {c} is null then 1.0 else abs({c} - {b}) / abs({b}) end"
    )


def grade(change: str, limit: str) -> str:
    return (
        f"case when {change} >= {limit} * 5.0 then 'critical' when {change} >= {limit} * 2.0 then 'high' "
        f"else 'warning' end"
    )


def share(key: str, percent: int) -> str:
    return f"({key} * 2654435761) % 4294967296 % 100 < {percent}"


def scope(s: Scenario, time_column: str) -> str:
    parts = ["true"]
    if s.scope.since:
        parts.append(f"{time_column} >= timestamp '{s.scope.since}'")
    if s.scope.until:
        parts.append(f"{time_column} < timestamp '{s.scope.until}'")
    if s.scope.percent < 100:
        parts.append(share("event_id", s.scope.percent))
    return " and ".join(parts)


def edited(s: Scenario | None, node: str, column: str, time_column: str) -> str:
    if s is None or s.node != node or s.edit is None or s.edit.column != column:
        return column
    op, arg = s.edit.op, s.edit.arg
    new = {
        "scale": f"{column} * {arg}e0",
        "scale_cents": f"round({column} * {arg}e0, 2)",
        "null": "null",
        "set": f"'{arg}'" if isinstance(arg, str) else str(arg).lower(),
        "upper": f"upper({column})",
        "lower": f"lower({column})",
        "round": f"round({column}, 0)",
    }[op]
    return f"case when {scope(s, time_column)} then {new} else {column} end as {column}"


def raw_run(run: str, s: Scenario | None) -> str:
    cols = [edited(s, "events", c, "ts") for c in ("user_id", "event_type", "value")]
    keep = f" where not coalesce(({scope(s, 'ts')}), false)" if s and s.edit and s.edit.op == "drop" else ""
    return f"select '{run}' as run_id, event_id, ts, {', '.join(cols)}, props from events{keep}"


STG = """select run_id, md5(concat_ws('|', event_id, ts, user_id)) as event_key, event_id, user_id, ts as event_at,
 event_type, try_cast(value as double) as value_usd, try_cast(json_extract_string(props, '$.k') as int) as prop_k
 from raw_events"""

FLAGGED = """select *, value_usd < 0 as flag_negative_value, user_id is null as flag_no_user,
 event_type = 'error' as flag_error, event_type = 'purchase' and value_usd < 1 as flag_low_purchase,
 event_type not in ('signup', 'error', 'click', 'view', 'purchase') as flag_unknown_type,
 event_at < timestamp '2024-01-01' or event_at >= timestamp '2024-02-01' as flag_out_of_period from stg_events"""

CLEAN = """select *, not (flag_negative_value or flag_no_user or flag_error or flag_low_purchase or flag_unknown_type
 or flag_out_of_period) as is_clean, cast(event_at as date) as event_date from flagged"""

DAILY_EVENTS = """select run_id, event_date, event_type, count(*) as events, sum(value_usd::decimal(28, 8))::double as revenue,
 sum(value_usd::decimal(28, 8))::double / count(value_usd) as avg_value from fct_events where is_clean group by all"""

DAILY_QUALITY = """select run_id, event_date, count(*) as events_total, count(*) filter (where is_clean) as events_clean,
 count(*) filter (where flag_negative_value) as n_negative_value, count(*) filter (where flag_no_user) as n_no_user,
 count(*) filter (where flag_error) as n_error, count(*) filter (where flag_low_purchase) as n_low_purchase,
 count(*) filter (where flag_unknown_type) as n_unknown_type,
 count(*) filter (where flag_out_of_period) as n_out_of_period from fct_events group by all"""

# node -> (partition axis, {column: class}); classes: i integer, f fractional, o other
NODES = {
    "events": ("ts", {"event_id": "i", "ts": "o", "user_id": "i", "event_type": "o", "value": "f", "props": "o"}),
    "stg_events": ("event_at", {"event_key": "o", "event_id": "i", "user_id": "i", "event_at": "o", "event_type": "o", "value_usd": "f", "prop_k": "i"}),
    "fct_events": ("event_date", {
        "event_key": "o", "event_id": "i", "user_id": "i", "event_at": "o", "event_type": "o", "value_usd": "f", "prop_k": "i",
        "flag_negative_value": "o", "flag_no_user": "o", "flag_error": "o", "flag_low_purchase": "o",
        "flag_unknown_type": "o", "flag_out_of_period": "o", "is_clean": "o", "event_date": "o"}),
    "agg_daily_events": ("event_date", {"event_date": "o", "event_type": "o", "events": "i", "revenue": "f", "avg_value": "f"}),
    "agg_daily_quality": ("event_date", {
        "event_date": "o", "events_total": "i", "events_clean": "i", "n_negative_value": "i", "n_no_user": "i",
        "n_error": "i", "n_low_purchase": "i", "n_unknown_type": "i", "n_out_of_period": "i"}),
}
RELATION = {"events": "raw_events"}
EDGES = [("stg_events", "events"), ("fct_events", "stg_events"), ("agg_daily_events", "fct_events"), ("agg_daily_quality", "fct_events")]


def metrics(column: str, kind: str, bounds: bool = True) -> str:
    c = f'"{column}"'
    distinct = f"count(distinct round({c}, 6))" if kind == "f" else f"count(distinct {c})"
    mean = f"avg({c})::double" if kind in "if" else "null::double"
    if not bounds:
        lo = hi = "null::varchar"
    elif kind == "f":
        lo, hi = (f"cast(round({fn}({c}), 6)::decimal(38, 6) as varchar)" for fn in ("min", "max"))
    else:
        lo, hi = (f"cast({fn}({c}) as varchar)" for fn in ("min", "max"))
    if kind == "l":  # by six digits
        digits = "list_transform({}, lambda x: cast(round(cast(x as decimal(38, 12)), 6) as decimal(38, 6))::varchar)"
        lo, hi = (f"'[' || array_to_string({digits.format(f'{fn}({c})')}, ',') || ']'" for fn in ("min", "max"))
    return (
        f"count(*) as row_count, count(*) - count({c}) as null_count, {distinct} as distinct_count, "
        f"{lo} as min_value, {hi} as max_value, {mean} as mean_value"
    )


RATES = (
    "case when row_count > 0 then null_count / row_count else 0.0 end as null_rate, "
    "case when row_count > 0 then distinct_count / row_count else 0.0 end as distinct_rate"
)


def profile_ctes(nodes: dict, relation: dict[str, str], runs: bool = True) -> dict[str, str]:
    whole, daily = [], []
    run = "run_id, " if runs else "'run' as run_id, "
    for node, (axis, columns) in nodes.items():
        table = relation.get(node, node)
        for c, kind in columns.items():
            head = f"'{node}' as model_name, '{c}' as column_name"
            whole.append(f"select {run}{head}, {metrics(c, kind)} from {table} group by 1")
            if axis:
                daily.append(
                    f"select {run}{head}, cast({axis} as date) as partition_value, {metrics(c, kind)} "
                    f"from {table} where {axis} is not null group by 1, 4"
                )
    out = {"cp": f"select *, {RATES} from ({' union all '.join(whole)})"}
    if daily:
        out["pp"] = f"select *, {RATES} from ({' union all '.join(daily)})"
    return out


def _check(metric: str, b: str, c: str) -> str:
    if metric == "null_rate":
        change = f"abs(coalesce({c}, 0) - coalesce({b}, 0))"
    else:
        change = rel(b, c)
    keep = f" and ({b} is not null or {c} is not null)" if metric == "mean_value" else ""
    return change, keep


def checks(source: str, day: bool) -> str:
    parts = []
    for m in ("row_count", "null_rate", "distinct_count", "mean_value"):
        change, keep = _check(m, f"b.{m}", f"c.{m}")
        extra = ", b.partition_value" if day else ""
        on = " and b.partition_value = c.partition_value" if day else ""
        parts.append(
            f"select b.run_id as baseline_run_id, c.run_id, b.model_name, b.column_name{extra}, '{m}' as metric, "
            f"b.{m}::double as baseline_value, c.{m}::double as current_value, {change} as change "
            f"from {source} b join {source} c on b.model_name = c.model_name and b.column_name = c.column_name{on} "
            f"where b.run_id = '{BASELINE}' and c.run_id <> '{BASELINE}'{keep}"
        )
    return " union all ".join(parts)


def signal_ctes(limits: str = LIMITS, mask: str = "false") -> dict[str, str]:
    def shown(v: str) -> str:
        return (
            f"case when {v} is null then null when {mask} then '<masked>' else {v} end"
        )

    bounds = " union all ".join(
        f"select b.run_id as baseline_run_id, c.run_id, b.model_name, b.column_name, '{m}' as metric, "
        f"b.{m} as before, c.{m} as after from cp b join cp c on b.model_name = c.model_name and "
        f"b.column_name = c.column_name where b.run_id = '{BASELINE}' and c.run_id <> '{BASELINE}' "
        f"and b.{m} is distinct from c.{m}"
        for m in ("min_value", "max_value")
    )
    columns = (
        "run_id, baseline_run_id, model_name, column_name, metric, baseline_value, current_value, change, severity, "
        "partitions, baseline_text, current_text, first_partition"
    )
    g = grade("round(change, 9)", "lim")
    return {
        "whole_checks": checks("cp", False),
        "day_checks": checks("pp", True),
        "whole_sig": f"""select run_id, baseline_run_id, model_name, column_name, metric, baseline_value, current_value, change,
            {g} as severity, 0 as partitions, null::varchar as baseline_text, null::varchar as current_text,
            null::varchar as first_partition from (select *, {limits} as lim from whole_checks) where round(change, 9) >= lim""",
        "bound_sig": f"""select run_id, baseline_run_id, model_name, column_name, metric, null::double as baseline_value,
            null::double as current_value, 1.0 as change, 'warning' as severity, 0 as partitions,
            {shown('before')} as baseline_text, {shown('after')} as current_text, null::varchar as first_partition from ({bounds})""",
        "day_sig": f"""select run_id, baseline_run_id, model_name, column_name, metric,
            first(baseline_value order by round(change, 9) desc, partition_value) as baseline_value,
            first(current_value order by round(change, 9) desc, partition_value) as current_value,
            first(change order by round(change, 9) desc, partition_value) as change,
            {grade('round(first(change order by round(change, 9) desc, partition_value), 9)', 'max(lim)')} as severity,
            count(*)::int as partitions, null::varchar as baseline_text, null::varchar as current_text,
            cast(min(partition_value) as varchar) as first_partition
            from (select *, {limits} as lim from day_checks) where round(change, 9) >= lim group by 1, 2, 3, 4, 5""",
        "sig": f"select {columns} from whole_sig union all select {columns} from bound_sig union all select {columns} from day_sig",
    }


def lineage_ctes(edges: Sequence[tuple[str, str]], sources: Sequence[str]) -> dict[str, str]:
    pairs = ", ".join(f"('{c}', '{p}')" for c, p in edges)
    names = dict.fromkeys([*sources, *[c for c, _ in edges]])
    nodes = ", ".join(f"('{n}', {str(n in sources).lower()})" for n in names)
    return {
        "edges": f"select * from (values {pairs}) t(child, parent)",
        "nodes": f"select * from (values {nodes}) t(name, is_source)",
        "reach": "select child as descendant, parent as ancestor from edges union select r.descendant, e.parent "
                 "from reach r join edges e on r.ancestor = e.child",
        "affected": "select distinct run_id, model_name from sig",
        "paths": "select d.run_id, d.model_name as descendant, a.model_name as ancestor from affected d join reach r "
                 "on d.model_name = r.descendant join affected a on a.run_id = d.run_id and a.model_name = r.ancestor",
        "roots": "select run_id, model_name as root from affected a where not exists (select 1 from paths p "
                 "where p.run_id = a.run_id and p.descendant = a.model_name)",
        "blast": "select p.run_id, p.ancestor as root, p.descendant as node from paths p join roots r "
                 "on p.run_id = r.run_id and p.ancestor = r.root",
        "node_cols": "select run_id, model_name, string_agg(column_name, ', ' order by column_name) as columns "
                     "from (select distinct run_id, model_name, column_name from sig) group by 1, 2",
        "evidence": f"select r.run_id, r.root, {RANK} as sev_rank, s.* exclude (run_id, model_name) from roots r join sig s "
                    "on s.run_id = r.run_id and s.model_name = r.root",
        "inc": """select e.run_id, e.root, bool_or(coalesce(n.is_source, false)) as is_source, min(sev_rank) as sev_rank,
                  count(*)::int as signal_count from evidence e left join nodes n on n.name = e.root group by 1, 2""",
        "blast_text": "select run_id, root, string_agg(node, ', ' order by node) as blast_radius, count(*) as blast_size "
                      "from blast group by 1, 2",
        "incidents": """select i.run_id, i.root, i.is_source,
                  case i.sev_rank when 0 then 'critical' when 1 then 'high' else 'warning' end as severity, i.sev_rank,
                  c.columns, coalesce(b.blast_radius, '') as blast_radius, coalesce(b.blast_size, 0) as blast_size,
                  i.signal_count, row_number() over (partition by i.run_id order by i.sev_rank,
                  coalesce(b.blast_size, 0) desc, i.root) as incident_rank
                  from inc i join node_cols c on c.run_id = i.run_id and c.model_name = i.root
                  left join blast_text b on b.run_id = i.run_id and b.root = i.root""",
    }


def events_ctes(scenarios: Sequence[Scenario], limits: str = LIMITS, mask: str = "false") -> dict[str, str]:
    runs = [(BASELINE, None), *[(s.id, s) for s in scenarios]]
    fct_edits = []
    for c in ("user_id", "value_usd", "is_clean"):
        cases = [
            f"when run_id = '{s.id}' then {edited(s, 'fct_events', c, 'event_at').removesuffix(f' as {c}')}"
            for s in scenarios
            if s.node == "fct_events" and s.edit.column == c
        ]
        if cases:
            fct_edits.append(f"case {' '.join(cases)} else {c} end as {c}")
    replace = f"* replace ({', '.join(fct_edits)})" if fct_edits else "*"
    return {
        "raw_events": " union all ".join(raw_run(r, s) for r, s in runs),
        "stg_events": STG,
        "flagged": FLAGGED,
        "clean": CLEAN,
        "fct_events": f"select {replace} from clean",
        "agg_daily_events": DAILY_EVENTS,
        "agg_daily_quality": DAILY_QUALITY,
        **profile_ctes(NODES, RELATION),
        **signal_ctes(limits, mask),
        **lineage_ctes(EDGES, ["events"]),
    }


def rolling_ctes(limits: str = LIMITS) -> dict[str, str]:
    w = "window w as (partition by run_id, model_name, column_name, metric order by partition_value rows between 28 preceding and 1 preceding)"
    metrics_union = " union all ".join(
        f"select run_id, model_name, column_name, '{m}' as metric, partition_value, {m}::double as value from dense"
        for m in ("null_rate", "distinct_count", "mean_value")
    )
    first = "first({0} order by round(z, 9) desc, partition_value)"
    med, val, z = (first.format(x) for x in ("median", "value", "z"))
    return {
        "typical": "select *, quantile_cont(row_count::double, 0.5) over s as typ, count(*) over s as n from pp "
                   "window s as (partition by run_id, model_name, column_name)",
        "long_enough": "select * from typical where n > 14 and row_count >= typ * 0.2",
        "dense": "select * exclude (typ, n) from (select *, count(*) over (partition by run_id, model_name, column_name) as n2 "
                 "from long_enough) where n2 > 14",
        "points": "select run_id, model_name, '(table)' as column_name, 'row_count' as metric, partition_value, "
                  f"max(row_count)::double as value from pp group by 1, 2, 3, 4, 5 union all {metrics_union}",
        "scored0": f"""select *, median(value) over w as median, mad(value) over w as mad, count(value) over w as n_hist,
                  count(*) over (partition by run_id, model_name, column_name, metric) as n_points from points {w}""",
        "scored": """select *, case when mad = 0 then case when abs(value - median) <= greatest(abs(median), 1e-9) * 1e-6 then 0.0
                  else abs(value - median) / greatest(abs(median), 1e-9) * 10 end
                  else abs((value - median) * 0.6745e0 / mad) end as z from scored0""",
        "flags": "select * from scored where n_points > 14 and n_hist >= 14 and value is not null and round(z, 9) >= 3.5",
        "roll0": f"""select run_id, model_name, column_name, metric, {med} as med, {val} as val, {z} as z,
                  count(*)::int as partitions, cast(min(partition_value) as varchar) as first_partition
                  from flags group by 1, 2, 3, 4""",
        "roll": f"""select run_id, null::varchar as baseline_run_id, model_name, column_name, metric, med as baseline_value,
                  val as current_value, change, case when partitions < 2 then 'warning' else {grade('round(z, 9)', '3.5')} end as severity,
                  partitions, null::varchar as baseline_text, null::varchar as current_text, first_partition
                  from (select *, {rel('med', 'val')} as change, {limits} as lim from roll0)
                  where round(case when metric = 'null_rate' then abs(val - med) else change end, 9) >= lim""",
    }


def decimal_rounds(final: str) -> str:
    """Rounding to four or six digits as decimals, which know their ties; what is no decimal stays."""
    out, i = "", 0
    while (at := final.find("round(", i)) >= 0:
        depth, j = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(final[j], 0)
            j += 1
        value, _, digits = final[at + 6 : j - 1].rpartition(", ")
        value = decimal_rounds(value)
        if digits in ("4", "6"):
            rounded = f"coalesce(round(try_cast(({value}) as decimal(38, 12)), {digits})::double, ({value})::double)"
        else:
            rounded = f"round({value}, {digits})"
        out += final[i:at] + rounded
        i = j
    return out + final[i:]


def with_ctes(ctes: dict[str, str], final: str) -> str:
    """The final query with only the CTEs it needs, in their given order."""
    import re

    needed, queue = set(), [final]
    while queue:
        text = queue.pop()
        for name in ctes:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                queue.append(ctes[name])
    body = ", ".join(
        f"{n} as {'' if n == 'reach' else 'materialized '}({ctes[n]})" for n in ctes if n in needed
    )
    return f"with recursive {body} {final}" if body else final
