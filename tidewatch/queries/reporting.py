"""Reports, charts, prompts and alerts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import alert as A
from ..operators import explain as X
from ..operators import report as R
from ..oracle import build as O
from ..session import materialise, shared_dir
from ..sources.store import MetricStore
from .base import CTES, OBSERVED, observed, once, query, r6, sql, text
from .causes import status

METRICS = R.CHART_METRICS


def _series(spark, sf):
    seen = observed(spark, sf)
    return once(spark, ("series", sf), lambda: materialise(R.series(seen.partitions, seen.pairs), "series"))


def _series_sql(kind: str, base_days: str = "true", cur_days: str = "true") -> str:
    """Baseline and current per day and metric, one block per run."""
    parts = []
    for run in OBSERVED:
        for i, m in enumerate(METRICS):
            parts.append(
                f"select '{run}' as run_id, coalesce(b.model_name, c.model_name) as model_name, coalesce(b.column_name, c.column_name) as "
                f"column_name, coalesce(b.partition_value, c.partition_value) as partition_value, {i} as metric_order, '{m}' as metric, "
                f"b.{m}::double as baseline, c.{m}::double as current from (select * from pp where run_id = 'baseline' and {base_days}) b "
                f"{kind} join (select * from pp where run_id = '{run}' and {cur_days}) c on b.model_name = c.model_name "
                f"and b.column_name = c.column_name and b.partition_value = c.partition_value"
            )
    return " union all ".join(parts)


_DAY = "cast(partition_value as varchar) as partition_value"
SER = {**CTES, "ser": _series_sql("inner")}
_OUTER = {**CTES, "ser": _series_sql("full outer", "partition_value < date '2024-01-28'", "partition_value >= date '2024-01-04'")}


@query(
    "metric_series",
    sql(f"select run_id, model_name, column_name, metric, {_DAY}, round(baseline, 6) as baseline, round(current, 6) as current, "
        "coalesce(abs(current - baseline) > abs(baseline) * 1e-6, false) as differs from ser", SER),
)
def metric_series(spark, sf):
    return _series(spark, sf).select(
        "run_id", "model_name", "column_name", "metric", text("partition_value").alias("partition_value"),
        r6("baseline").alias("baseline"), r6("current").alias("current"), R.diverges().alias("differs"),
    )


@query(
    "metric_series_outer",
    sql(f"select run_id, model_name, column_name, metric, {_DAY}, round(baseline, 6) as baseline, round(current, 6) as current from ser", _OUTER),
)
def metric_series_outer(spark, sf):
    """Days that only one of the two runs holds stay in the series."""
    seen = observed(spark, sf)
    day, base = F.col("partition_value"), F.col("run_id") == "baseline"
    partial = seen.partitions.where(
        F.when(base, day < F.lit("2024-01-28").cast("date")).otherwise(day >= F.lit("2024-01-04").cast("date"))
    )
    return R.series(partial, seen.pairs, "full_outer").select(
        "run_id", "model_name", "column_name", "metric", text("partition_value").alias("partition_value"),
        r6("baseline").alias("baseline"), r6("current").alias("current"),
    )


def _domain_sql(variant: str) -> str:
    lo, hi, share = ("least(p2, med_b, med_c)", "greatest(p98, med_b, med_c)", "0.08e0") if variant == "dashboard" else ("p2", "p98", "0.10e0")
    low = "lo1 - pad" if variant == "dashboard" else "case when least >= 0 and lo1 - pad < 0 then 0.0 else lo1 - pad end"
    return f"""
      select run_id, model_name, column_name, metric, '{variant}' as variant, round(dlo, 6) as domain_lo, round(dhi, 6) as domain_hi,
       (select count(*) from vals v where v.run_id = d.run_id and v.model_name = d.model_name and v.column_name = d.column_name
        and v.metric = d.metric and (v.v < dlo or v.v > dhi)) as clipped
      from (select *, {low} as dlo, hi1 + pad as dhi from (select *, (hi1 - lo1) * {share} as pad from (select *,
        case when lo = hi then lo - abs(case when lo = 0 then 1 else lo end) * 0.1e0 else lo end as lo1,
        case when lo = hi then hi + abs(case when lo = 0 then 1 else lo end) * 0.1e0 else hi end as hi1
        from (select *, {lo} as lo, {hi} as hi from spread)))) d"""


DOMAIN = {
    **SER,
    "vals": "select run_id, model_name, column_name, metric, unnest([baseline, current]) as v from ser",
    "spread": """select s.run_id, s.model_name, s.column_name, s.metric, quantile_cont(v, 0.02) as p2, quantile_cont(v, 0.98) as p98, min(v) as least,
       any_value(m.med_b) as med_b, any_value(m.med_c) as med_c from vals s join (select run_id, model_name, column_name, metric,
       median(baseline) as med_b, median(current) as med_c from ser group by 1, 2, 3, 4) m using (run_id, model_name, column_name, metric)
       where v is not null group by 1, 2, 3, 4""",
}


@query("chart_domain", sql(f"{_domain_sql('dashboard')} union all {_domain_sql('report')}", DOMAIN))
def chart_domain(spark, sf):
    points = _series(spark, sf)
    both = [R.chart_domain(points, v).withColumn("variant", F.lit(v)) for v in ("dashboard", "report")]
    return both[0].unionByName(both[1]).select(
        "run_id", "model_name", "column_name", "metric", "variant", r6("domain_lo").alias("domain_lo"), r6("domain_hi").alias("domain_hi"), "clipped"
    )


PICKS = {
    **SER,
    "candidates": """select r.run_id, r.root, 0 as node_order, r.root as model_name, s.column_name from roots r join (select distinct run_id, model_name,
        column_name from sig) s on s.run_id = r.run_id and s.model_name = r.root union all
        select b.run_id, b.root, dense_rank() over (partition by b.run_id, b.root order by b.node), b.node, s.column_name from blast b
        join (select distinct run_id, model_name, column_name from sig) s on s.run_id = b.run_id and s.model_name = b.node""",
    "live": "select distinct run_id, model_name, column_name, metric, metric_order from ser where abs(current - baseline) > greatest(abs(baseline), 1e-9) * 1e-6",
    "picked": """select c.run_id, c.root, c.node_order, c.model_name, c.column_name, first(l.metric order by l.metric_order) as metric
        from candidates c join live l using (run_id, model_name, column_name) group by 1, 2, 3, 4, 5""",
    "picks": "select * from (select run_id, root, row_number() over (partition by run_id, root order by node_order, column_name) as chart, model_name, "
             "column_name, metric from picked) where chart <= 3",
}


@query("chart_picks", sql("select * from picks", PICKS))
def chart_picks(spark, sf):
    return R.chart_picks(observed(spark, sf).incidents, _series(spark, sf))


_OVER = """select run_id, count(*) as nodes, sum(n)::bigint as rows_profiled, (select count(*) from sig s where s.run_id = v.run_id) as signals,
    (select count(*) from roots r where r.run_id = v.run_id) as incidents from (select run_id, model_name, max(row_count) as n from cp group by 1, 2) v
    group by 1"""


@query("overview", sql(_OVER))
def overview(spark, sf):
    seen = observed(spark, sf)
    return R.overview(seen.columns, seen.signals, seen.incidents)


def _payload(spark, sf):
    seen = observed(spark, sf)
    points = _series(spark, sf)
    drawn = R.charts(R.chart_picks(seen.incidents, points), points)
    return R.payload("demo", seen.columns, seen.pairs, seen.signals, seen.incidents, status(spark, sf), seen.edges, drawn)


@query(
    "report_payload",
    sql(f"""select 'demo' as project, o.run_id, 'baseline' as baseline_run_id, o.nodes, o.rows_profiled, o.signals, o.incidents,
      (select count(*) from edges) as edges,
      (select string_agg(model_name || '.' || column_name || '.' || metric, ', ' order by {O.RANK}, round(change, 9) desc, model_name, column_name,
        metric, partitions) from sig s where s.run_id = o.run_id) as signal_order,
      (select string_agg(root, ', ' order by incident_rank) from incidents i where i.run_id = o.run_id) as roots,
      (select string_agg(p.model_name || '.' || p.column_name || '.' || p.metric, ', ' order by i.incident_rank, p.chart) from picks p
        join incidents i on i.run_id = p.run_id and i.root = p.root where p.run_id = o.run_id) as charts,
      (select count(*) from picks p join ser s using (run_id, model_name, column_name, metric) where p.run_id = o.run_id) as points
      from ({_OVER}) o where o.run_id <> 'baseline'""", PICKS),
)
def report_payload(spark, sf):
    """The content of the nested report, read back out of it."""
    p = _payload(spark, sf)
    charts = F.flatten(F.transform("incidents", lambda i: i["charts"]))

    def name(x):
        return F.concat(x["model"], F.lit("."), x["column"], F.lit("."), x["metric"])

    return p.select(
        "project", "run_id", "baseline_run_id", F.col("overview.nodes").alias("nodes"), F.col("overview.rows_profiled").alias("rows_profiled"),
        F.col("overview.signals").alias("signals"), F.col("overview.incidents").alias("incidents"),
        F.size("lineage.edges").cast("bigint").alias("edges"),
        F.array_join(F.transform(F.col("signals"), name), ", ").alias("signal_order"),
        F.array_join(F.transform(F.col("incidents"), lambda i: i["root"]), ", ").alias("roots"),
        F.array_join(F.transform(charts, name), ", ").alias("charts"),
        F.aggregate(charts, F.lit(0).cast("bigint"), lambda n, c: n + F.size(c["points"])).alias("points"),
    )


_PARTS = "run_id, part, item, root, model_name, column_name, metric, day, baseline, current, change, severity, partitions, baseline_text, current_text, detail"


def _part(part: str, source: str, **given: str) -> str:
    columns = {c: "null" for c in _PARTS.split(", ")} | given | {"part": f"'{part}'", "run_id": "run_id"}
    kinds = {"item": "bigint", "baseline": "double", "current": "double", "change": "double", "partitions": "int"}
    return "select " + ", ".join(f"cast({v} as {kinds.get(c, 'varchar')}) as {c}" for c, v in columns.items()) + f" from {source}"


_MEASURED = {
    "model_name": "model_name", "column_name": "column_name", "metric": "metric", "baseline": "baseline_value", "current": "current_value",
    "change": "change", "severity": "severity", "partitions": "partitions", "baseline_text": "baseline_text", "current_text": "current_text",
    "day": "first_partition",
}
_RUN_OF = "(select distinct run_id from sig)"
REPORT = {
    **PICKS,
    "over": _OVER,
    "parts": " union all ".join([
        *[_part("overview", f"(select * from over where run_id in {_RUN_OF})", metric=f"'{c}'", current=c) for c in ("nodes", "rows_profiled", "signals", "incidents")],
        _part("node", f"(select r.run_id, n.*, case when exists (select 1 from roots x where x.run_id = r.run_id and x.root = n.name) then 'root' when exists "
              f"(select 1 from blast x where x.run_id = r.run_id and x.node = n.name) then 'affected' else 'clean' end as status from {_RUN_OF} r cross join nodes n)",
              model_name="name", detail="case when is_source then 'source' else 'model' end", severity="status"),
        _part("edge", f"(select r.run_id, e.* from {_RUN_OF} r cross join edges e)", model_name="child", detail="parent", item="0"),
        _part("signal", f"(select *, row_number() over (partition by run_id order by {O.RANK}, round(change, 9) desc, model_name, column_name, metric, partitions) "
              "as position from sig)", item="position", **_MEASURED),
        _part("incident", "incidents", item="incident_rank", root="root", severity="severity", column_name="columns", detail="blast_radius",
              baseline_text="case when is_source then 'source table' else 'model' end"),
        _part("evidence", "(select *, root as model_name, row_number() over (partition by run_id, root order by sev_rank, round(change, 9) desc, column_name, metric, "
              "partitions) as position from evidence)", item="position", root="root", **_MEASURED),
        _part("point", "(select * from picks p join ser s using (run_id, model_name, column_name, metric))", item="chart", root="root", model_name="model_name",
              column_name="column_name", metric="metric", day="partition_value", baseline="baseline", current="current"),
    ]),
}
_SHOWN = ", ".join(f"round({c}, 6) as {c}" if c in ("baseline", "current", "change") else c for c in _PARTS.split(", "))


@query("report_parts", sql(f"select {_SHOWN} from parts", REPORT))
def report_parts(spark, sf):
    """The whole report of every run, value by value, written by run and part and read back."""
    def make():
        seen, points = observed(spark, sf), _series(spark, sf)
        picks = R.chart_picks(seen.incidents, points)
        compared = seen.columns.join(seen.signals.select("run_id").distinct(), "run_id", "left_semi")
        kept = MetricStore(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
        kept.save_report(R.report_parts(compared, seen.signals, seen.incidents, status(spark, sf), seen.edges, picks, points))
        return kept.read("report_parts")

    rows = once(spark, ("report", sf), make)
    return rows.select(*[r6(c).alias(c) if c in ("baseline", "current", "change") else c for c in R.PART_COLUMNS])


# ---------------------------------------------------------------- prompts


def _num(c: str) -> str:
    return f"coalesce(format('{{:,.4f}}', round({c}, 4)), '-')"


def _pct(c: str) -> str:
    return f"format('{{:.1f}}', round({c} * 100, 1)) || '%'"


def _quoted(c: str) -> str:
    return f"case when {c} is null then 'None' else chr(39) || {c} || chr(39) end"


_LINE = f"""'  ' || column_name || '.' || metric || ': ' || case when metric in ('min_value', 'max_value') then
  case when baseline_text is null and current_text is null then 'changed' else {_quoted('baseline_text')} || ' -> ' || {_quoted('current_text')} end
  else {_num('baseline_value')} || ' -> ' || {_num('current_value')} || '  (' || {_pct('change')} || ' change, severity ' || severity ||
  case when baseline_value is not null and baseline_value <> 0 and current_value is not null
  then ', ratio x' || format('{{:.4f}}', round(current_value / baseline_value, 4)) else '' end || ')' end"""


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PROMPT = {
    **CTES,
    "ev_text": f"select run_id, root, string_agg({_LINE}, chr(10) order by sev_rank, round(change, 9) desc, column_name, metric, partitions) as t "
               "from evidence group by 1, 2",
    "parents": "select n.name, coalesce((select string_agg(parent, ', ' order by parent) from edges where child = n.name), '(source)') as ps from nodes n",
    "lin_text": "select run_id, root, string_agg('  ' || node || ' <- ' || ps, chr(10) order by o, node) as t from (select run_id, root, root as node, 0 as o "
                "from roots union all select run_id, root, node, 1 from blast) m join parents p on p.name = m.node group by 1, 2",
    "down_text": "select b.run_id, b.root, string_agg('  ' || b.node || ': ' || c.columns, chr(10) order by b.node) as t from blast b "
                 "join node_cols c on c.run_id = b.run_id and c.model_name = b.node group by 1, 2",
    "prompts": f"""select i.run_id, i.root, concat_ws(chr(10), {_literal(X.TASK)},
      chr(10) || 'The change began at ' || i.root || ', ' || case when i.is_source then 'a source' else 'a model' end || ', in: ' || i.columns,
      chr(10) || 'Measured there:', e.t, chr(10) || 'Carried on to (node: columns):', coalesce(d.t, '  none'),
      chr(10) || 'Where each of these reads from:', l.t, '', {_literal(X.NOTES)}) as prompt
      from incidents i join ev_text e using (run_id, root) join lin_text l using (run_id, root) left join down_text d using (run_id, root)""",
}


@query("prompt_evidence", sql("select run_id, root, t as evidence_text from ev_text", PROMPT))
def prompt_evidence(spark, sf):
    return X.evidence_lines(observed(spark, sf).incidents)


def _prompts(spark, sf):
    seen = observed(spark, sf)
    return X.prompts(seen.incidents, seen.edges)


@query("incident_prompts", sql("select run_id, root, prompt from prompts", PROMPT))
def incident_prompts(spark, sf):
    return _prompts(spark, sf)


@query(
    "prompt_cache",
    sql("select run_id, root, substr(sha256(prompt), 1, 32) as prompt_key, run_id like 'unit%' as cached, "
        "case when run_id like 'unit%' then 'stored' else 'stand-in answer to a prompt of ' || length(prompt) || ' characters' end as summary from prompts", PROMPT),
)
def prompt_cache(spark, sf):
    """One answer comes from the cache, the others are asked for on the executors."""
    wanted = _prompts(spark, sf)
    cache = wanted.where(F.col("run_id").startswith("unit")).select(
        X.prompt_key(F.col("prompt")).alias("prompt_key"), "prompt", F.lit('{"summary": "stored"}').alias("response")
    )
    answered, _ = X.resolve(wanted, cache)
    parsed = X.parse(F.col("response"))
    return answered.select("run_id", "root", "prompt_key", (parsed["summary"] == "stored").alias("cached"), parsed["summary"].alias("summary"))


@query(
    "response_parse",
    sql("select run_id, model_name, severity, 'drift in ' || model_name as summary, column_name as cause, 'check ' || metric as first_check, n "
        "from (select run_id, model_name, severity, column_name, metric, count(*) as n from sig group by all)"),
)
def response_parse(spark, sf):
    """Answers as models write them: bare, fenced, or wrapped in prose, by severity."""
    signals = observed(spark, sf).signals.groupBy("run_id", "model_name", "severity", "column_name", "metric").agg(F.count(F.lit(1)).alias("n"))
    answer = F.to_json(
        F.struct(
            F.concat(F.lit("drift in "), F.col("model_name")).alias("summary"),
            F.array(F.struct(F.col("column_name").alias("cause"), F.lit("low").alias("confidence"), F.lit("{n/a}").alias("reasoning"))).alias("likely_causes"),
            F.array(F.concat(F.lit("check "), F.col("metric"))).alias("checks_to_add"),
            F.lit("nobody").alias("who_is_affected"),
        )
    )
    raw = (
        F.when(F.col("severity") == "critical", answer)
        .when(F.col("severity") == "high", F.concat(F.lit("```json\n"), answer, F.lit("\n```")))
        .otherwise(F.concat(F.lit("Here is what I found:\n"), answer, F.lit("\nHope that helps.")))
    )
    p = X.parse(raw)
    return signals.select(
        "run_id", "model_name", "severity", p["summary"].alias("summary"), p["likely_causes"][0]["cause"].alias("cause"),
        p["checks_to_add"][0].alias("first_check"), "n",
    )


# ---------------------------------------------------------------- alerts


_VALUE = "coalesce(case when {0}_text <> '' then " + _quoted("{0}_text") + " end, " + _num("{0}_value").replace("{:,.4f}", "{{:,.4f}}") + ")"
_FOUND = "severity in ('critical', 'high')"
ALERT = {
    **PROMPT,
    "hit": f"""select s.*, r.root is not null as is_root, row_number() over (partition by s.run_id order by r.root is null, {O.RANK},
      round(abs(change), 9) desc, model_name, column_name, metric, partitions) as position, count(*) over (partition by s.run_id) as n_hits,
      '[' || severity || '] ' || model_name || ' / ' || column_name || ' / ' || metric || ': ' || {_VALUE.format("baseline")} || ' to ' ||
      {_VALUE.format("current")} || case when metric in ('min_value', 'max_value') then '' else ', moved ' || {_pct('change')} end ||
      case when partitions = 1 then ', on 1 day' when partitions > 1 then ', on ' || partitions || ' days' else '' end ||
      coalesce(' from ' || first_partition, '') as line
      from sig s left join roots r on r.run_id = s.run_id and r.root = s.model_name where {_FOUND}""",
    "origin_line": """select run_id, incident_rank, root || case when is_source then ' (source) in ' else ' (model) in ' end || columns ||
      case when blast_size > 0 then '; reached ' || blast_size || ': ' || blast_radius else '' end as line from incidents""",
    "message": f"""select h.run_id, count(*) as n_hits, case min({O.RANK}) when 0 then 'critical' when 1 then 'high' else 'warning' end as worst,
      (select count(*) from incidents i where i.run_id = h.run_id) as n_origins from hit h group by 1""",
    "titled": """select *, 'Drift in demo, worst ' || worst || ': ' || n_hits || ' signals from ' || n_origins || ' origins' as text from message""",
}
_SECTION = """'{{"type":"section","text":{{"type":"mrkdwn","text":' || to_json({0}) || '}}}}'"""


def _listed(title: str, source: str, position: str, shown: int, total: str) -> str:
    lines = f"(select string_agg(line, chr(10) order by {position}) from {source} x where x.run_id = m.run_id and {position} <= {shown})"
    more = f"case when {total} > {shown} then chr(10) || '... and ' || ({total} - {shown}) || ' more' else '' end"
    return _SECTION.format(f"'*{title}*' || chr(10) || {lines} || {more}")


@query(
    "alert_topk",
    sql("select run_id, position, is_root, model_name, column_name, metric, severity, line, greatest(n_hits - 6, 0) as rest from hit where position <= 6", ALERT),
)
def alert_topk(spark, sf):
    seen = observed(spark, sf)
    return A.top_signals(A.hits(seen.signals, seen.roots, "high"))


@query(
    "alert_payload",
    sql(f"""select run_id, text, '[' || concat_ws(',',
      '{{"type":"header","text":{{"type":"plain_text","text":' || to_json(text) || '}}}}',
      {_listed("Began at", "origin_line", "incident_rank", 3, "n_origins")},
      {_listed("Strongest signals", "hit", "position", 6, "n_hits")},
      '{{"type":"context","elements":[{{"type":"mrkdwn","text":"compared with previous_run  |  shown from high on"}}]}}'
      ) || ']' as blocks from titled m""", ALERT),
)
def alert_payload(spark, sf):
    seen = observed(spark, sf)
    return A.messages(seen.signals, seen.incidents, seen.roots, "demo", threshold="high")
