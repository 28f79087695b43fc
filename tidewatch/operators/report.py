"""Report and dashboard datasets: series, charts, overview, lineage state, payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from . import drift, rca

# Fixed order: the first metric that moved is the one to draw.
CHART_METRICS = ("mean_value", "null_rate", "distinct_count", "row_count")
SERIES_KEYS = ["baseline_run_id", "run_id", "model_name", "column_name", "metric"]


def series(partitions: DataFrame, pairs: DataFrame, how: str = "inner") -> DataFrame:
    """Baseline and current value per day, for every column and metric at once.

    Inner for the report; full outer for the dashboard, which also shows days
    that exist in one run only.
    """
    keys = ["model_name", "column_name", "partition_value"]
    pair = drift.paired(drift.with_grain(partitions), pairs, [*keys, "grain"], list(CHART_METRICS), how)
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("metric_order"), F.lit(m).alias("metric"),
                F.col("b_" + m).cast("double").alias("baseline"), F.col("c_" + m).cast("double").alias("current"),
            )
            for i, m in enumerate(CHART_METRICS)
        ]
    )
    return pair.select("baseline_run_id", "run_id", *keys, F.inline(entries))


def diverges() -> Column:
    """Does a day differ between the two runs (the shaded band of a chart)?"""
    b, c = F.col("baseline"), F.col("current")
    return F.coalesce(F.abs(c - b) > F.abs(b) * 1e-6, F.lit(False))


def moved() -> Column:
    """Is a day different enough for its series to be worth drawing?"""
    b, c = F.col("baseline"), F.col("current")
    return F.coalesce(F.abs(c - b) > F.greatest(F.abs(b), F.lit(1e-9)) * 1e-6, F.lit(False))


def chart_domain(points: DataFrame, variant: str = "dashboard", clip: bool = True) -> DataFrame:
    """Axis range per series, clipped to p2..p98, and the points left outside.

    The dashboard keeps the medians of both runs in view and pads by 8%; the
    report pads by 10% and never goes below zero for values that cannot.
    """
    both = F.array(F.col("baseline"), F.col("current"))
    values = points.select(*SERIES_KEYS, F.explode(F.filter(both, lambda v: v.isNotNull())).alias("v"))
    low_end, high_end = (0.02, 0.98) if clip else (0.0, 1.0)
    spread = values.groupBy(*SERIES_KEYS).agg(
        F.percentile("v", F.lit(low_end)).alias("p2"), F.percentile("v", F.lit(high_end)).alias("p98"),
        F.min("v").alias("least"),
    )
    medians = points.groupBy(*SERIES_KEYS).agg(
        F.percentile("baseline", F.lit(0.5)).alias("med_b"), F.percentile("current", F.lit(0.5)).alias("med_c")
    )
    joined = spread.join(medians, SERIES_KEYS)
    if variant == "dashboard":
        lo, hi, share = F.least("p2", "med_b", "med_c"), F.greatest("p98", "med_b", "med_c"), 0.08
    else:
        lo, hi, share = F.col("p2"), F.col("p98"), 0.10
    widen = F.abs(F.when(F.col("lo") == 0, 1.0).otherwise(F.col("lo"))) * 0.1
    flat = F.col("lo") == F.col("hi")
    pad = (F.col("hi1") - F.col("lo1")) * share
    low = F.col("lo1") - pad
    if variant == "report":
        low = F.when((F.col("least") >= 0) & (low < 0), 0.0).otherwise(low)
    ranges = (
        joined.withColumns({"lo": lo, "hi": hi})
        .withColumns(
            {
                "lo1": F.when(flat, F.col("lo") - widen).otherwise(F.col("lo")),
                "hi1": F.when(flat, F.col("lo") + widen).otherwise(F.col("hi")),
            }
        )
        .select(*SERIES_KEYS, low.alias("domain_lo"), (F.col("hi1") + pad).alias("domain_hi"))
    )
    outside = (F.col("v") < F.col("domain_lo")) | (F.col("v") > F.col("domain_hi"))
    return (
        values.join(ranges, SERIES_KEYS)
        .groupBy(*SERIES_KEYS, "domain_lo", "domain_hi")
        .agg(F.count_if(outside).alias("clipped"))
    )


# ---------------------------------------------------------------- overview and lineage state


def latest_runs(profile_runs: DataFrame, n: int = 2) -> DataFrame:
    return profile_runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def overview(columns: DataFrame, signals: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes, rows, signals and incidents per run."""
    per_node = columns.groupBy("run_id", "model_name").agg(F.max("row_count").alias("rows"))
    size = per_node.groupBy("run_id").agg(F.count(F.lit(1)).alias("nodes"), F.sum("rows").alias("rows_profiled"))
    moved_count = signals.groupBy("run_id").agg(F.count(F.lit(1)).alias("signals"))
    causes = found.groupBy("run_id").agg(F.count(F.lit(1)).alias("incidents"))
    zero = F.lit(0).cast("bigint")
    return (
        size.join(moved_count, "run_id", "left")
        .join(causes, "run_id", "left")
        .select(
            "run_id", "nodes", "rows_profiled",
            F.coalesce("signals", zero).alias("signals"), F.coalesce("incidents", zero).alias("incidents"),
        )
    )


def lineage_status(
    nodes: DataFrame, depths: DataFrame, profiled: DataFrame, signals: DataFrame, root: DataFrame, blast: DataFrame
) -> DataFrame:
    """Every node that a run profiled or named, with both labels in use.

    `status` (report) marks only nodes inside a blast radius as affected;
    `state` (dashboard) marks every node that has a signal.  What is known of a node is a union of
    facts, one group-by folds them, and a node of which nothing but its profile is known is clean.
    profiled: (run_id, model_name, ...) of the runs to label.
    """
    facts = {
        "seen": profiled.select("run_id", F.col("model_name").alias("name")).distinct(),
        "has_signal": rca.affected(signals).select("run_id", F.col("model_name").alias("name")),
        "in_blast": blast.select("run_id", F.col("node").alias("name")).distinct(),
        "is_root": root.select("run_id", F.col("root").alias("name")),
    }
    union = None
    for fact, rows in facts.items():
        told = rows.withColumn("fact", F.lit(fact))
        union = told if union is None else union.unionByName(told)
    labels = union.groupBy("run_id", "name").agg(*[F.bool_or(F.col("fact") == f).alias(f) for f in facts])
    known = nodes.select("name", "is_source").distinct().join(depths, "name")
    return labels.join(known, "name").select(
        "run_id", "name",
        F.when(F.col("is_source"), "source").otherwise("model").alias("kind"),
        "depth",
        F.when(F.col("is_root"), "root").when(F.col("in_blast"), "affected").otherwise("clean").alias("status"),
        F.when(F.col("is_root"), "root").when(F.col("has_signal"), "affected").otherwise("ok").alias("state"),
    )


# ---------------------------------------------------------------- charts and payload


def chart_candidates(found: DataFrame) -> DataFrame:
    """Columns to draw per incident: those of the root, then downstream in order."""
    first = found.select(
        "run_id", "root", F.array(F.struct(F.col("root").alias("node"), F.col("columns").alias("columns"))).alias("own"),
        F.transform(
            "blast_radius", lambda n: F.struct(n.alias("node"), F.col("downstream_columns")[n].alias("columns"))
        ).alias("down"),
    )
    nodes = first.select("run_id", "root", F.posexplode(F.concat("own", "down")).alias("node_order", "entry"))
    return nodes.select(
        "run_id", "root", "node_order", F.col("entry.node").alias("model_name"),
        F.posexplode("entry.columns").alias("column_order", "column_name"),
    )


def chart_picks(found: DataFrame, points: DataFrame, limit: int = 3) -> DataFrame:
    """Up to three charts per incident: per candidate the first metric that moved."""
    live = points.groupBy("run_id", "model_name", "column_name", "metric", "metric_order").agg(
        F.bool_or(moved()).alias("live")
    ).where("live")
    drawn = chart_candidates(found).join(live, ["run_id", "model_name", "column_name"])
    first = drawn.groupBy("run_id", "root", "node_order", "column_order", "model_name", "column_name").agg(
        F.min_by("metric", "metric_order").alias("metric")
    )
    order = Window.partitionBy("run_id", "root").orderBy("node_order", "column_order")
    return (
        first.withColumn("chart", F.row_number().over(order))
        .where(F.col("chart") <= limit)
        .select("run_id", "root", "chart", "model_name", "column_name", "metric")
    )


def charts(picks: DataFrame, points: DataFrame) -> DataFrame:
    """The picked charts with their points in day order."""
    joined = picks.join(points, ["run_id", "model_name", "column_name", "metric"])
    point = F.struct(F.col("partition_value").cast("string").alias("day"), "baseline", "current")
    return joined.groupBy("run_id", "root", "chart", "model_name", "column_name", "metric").agg(
        F.array_sort(F.collect_list(point)).alias("points")
    )


def _array_of(df: DataFrame, keys: list[str], order: list[Column], entry: Column, name: str) -> DataFrame:
    """Entries per key as one array in the given order (sort keys lead, then are dropped)."""
    sorting = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])

    def compare(a: Column, b: Column) -> Column:
        return F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)

    packed = F.array_sort(F.collect_list(F.struct(sorting.alias("o"), entry.alias("e"))), compare)
    return df.groupBy(*keys).agg(F.transform(packed, lambda p: p["e"]).alias(name))


def payload(
    project: str, columns: DataFrame, pairs: DataFrame, signals: DataFrame, found: DataFrame,
    status: DataFrame, edges: DataFrame, drawn: DataFrame, explanations: DataFrame | None = None,
) -> DataFrame:
    """Everything a report page shows, one row per run.

    Sizes follow the lineage graph and the number of days kept, both limited;
    no table data is in it.
    """
    over = overview(columns, signals, found).select(
        "run_id", F.struct("nodes", "rows_profiled", "signals", "incidents").alias("overview")
    )
    node_list = _array_of(status, ["run_id"], [F.col("name")], F.struct("name", "kind", "status"), "nodes")
    shown = edges.join(status.select("run_id", F.col("name").alias("child")), "child")  # of the nodes of each run
    edge_list = shown.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("parent").alias("from"), F.col("child").alias("to")))).alias("edges")
    )
    s = signals.withColumns({"sev_rank": X.severity_rank(F.col("severity")), "down": -X.settled(F.col("change"))})
    signal_list = _array_of(
        s, ["run_id"],
        [F.col(c) for c in ("sev_rank", "down", "model_name", "column_name", "metric", "partitions")],
        F.struct(
            F.col("model_name").alias("model"), F.col("column_name").alias("column"), "metric",
            F.col("baseline_value").alias("baseline"), F.col("current_value").alias("current"),
            "baseline_text", "current_text", "change", "severity", "partitions", "first_partition",
        ),
        "signals",
    )
    chart_list = _array_of(
        drawn, ["run_id", "root"], [F.col("chart")],
        F.struct(F.col("model_name").alias("model"), F.col("column_name").alias("column"), "metric", "points"),
        "charts",
    )
    lines = F.transform(
        "evidence",
        lambda e: F.struct(
            e["column_name"].alias("column"), e["metric"].alias("metric"),
            e["baseline_value"].alias("baseline"), e["current_value"].alias("current"),
            e["baseline_text"].alias("baseline_text"), e["current_text"].alias("current_text"),
            e["change"].alias("change"), e["severity"].alias("severity"),
            e["partitions"].alias("partitions"), e["first_partition"].alias("first_partition"),
        ),
    )
    ranked = found.join(chart_list, ["run_id", "root"], "left")
    if explanations is not None:
        ranked = ranked.join(explanations.select("run_id", "root", "explanation"), ["run_id", "root"], "left")
    else:
        ranked = ranked.withColumn("explanation", F.lit(None).cast("string"))
    incident_list = _array_of(
        ranked, ["run_id"], [F.col("incident_rank")],
        F.struct(
            "root", F.when(F.col("is_source"), "source table").otherwise("model").alias("kind"), "severity",
            "columns", "blast_radius", "downstream_columns", lines.alias("evidence"), "charts", "explanation",
        ),
        "incidents",
    )
    return (
        pairs.join(over, "run_id")
        .join(node_list, "run_id", "left")
        .join(edge_list, "run_id", "left")
        .join(signal_list, "run_id", "left")
        .join(incident_list, "run_id", "left")
        .select(
            F.lit(project).alias("project"), "run_id", "baseline_run_id", "overview",
            F.struct("nodes", "edges").alias("lineage"), "incidents", "signals",
        )
    )


PART_COLUMNS = [
    "run_id", "part", "item", "root", "model_name", "column_name", "metric", "day", "baseline", "current", "change", "severity",
    "partitions", "baseline_text", "current_text", "detail",
]
_PART_TYPES = {
    "item": "bigint", "baseline": "double", "current": "double", "change": "double", "partitions": "int",
}


def report_parts(
    columns: DataFrame, signals: DataFrame, found: DataFrame, status: DataFrame, edges: DataFrame, picks: DataFrame, points: DataFrame,
    explanations: DataFrame | None = None,
) -> DataFrame:
    """All that a report page shows as rows (run_id, part, item, ...), one per thing shown.

    Nothing is gathered: a page reads the parts it shows, and a run with very many signals has as
    many rows.  Parts: overview, node, edge, signal, incident, evidence, point and explanation.
    """
    def part(name: str, rows: DataFrame, **given: str | Column) -> DataFrame:
        made = {k: F.col(v) if isinstance(v, str) else v for k, v in given.items()} | {"part": F.lit(name), "run_id": F.col("run_id")}
        return rows.select(*[made.get(c, F.lit(None)).cast(_PART_TYPES.get(c, "string")).alias(c) for c in PART_COLUMNS])

    measured = {
        "model_name": "model_name", "column_name": "column_name", "metric": "metric", "baseline": "baseline_value", "current": "current_value",
        "change": "change", "severity": "severity", "partitions": "partitions", "baseline_text": "baseline_text", "current_text": "current_text",
        "day": "first_partition",
    }
    over = overview(columns, signals, found)
    totals = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("n")) for c in ("nodes", "rows_profiled", "signals", "incidents")])
    of_run = edges.join(status.select("run_id", F.col("name").alias("child")), "child")
    lines = found.select("run_id", "root", F.posexplode("evidence").alias("at", "e")).select(
        "run_id", "root", (F.col("at") + 1).alias("at"), F.col("root").alias("model_name"),
        *[F.col(f"e.{c}") for c in rca.EVIDENCE_FIELDS if c not in ("sev_rank", "order_change")],
    )
    drawn = picks.join(points, ["run_id", "model_name", "column_name", "metric"])
    parts = [
        part("overview", over.select("run_id", F.inline(totals)), metric="name", current="n"),
        part("node", status, model_name="name", detail="kind", severity="status"),
        part("edge", of_run, model_name="child", detail="parent", item="position"),
        part("signal", drift.numbered(signals), item="position", **measured),
        part(
            "incident", found, item="incident_rank", root="root", severity="severity", column_name=F.array_join("columns", ", "),
            detail=F.array_join("blast_radius", ", "), baseline_text=F.when(F.col("is_source"), "source table").otherwise("model"),
        ),
        part("evidence", lines, item="at", root="root", **measured),
        part(
            "point", drawn, item="chart", root="root", model_name="model_name", column_name="column_name", metric="metric", day="partition_value",
            baseline="baseline", current="current",
        ),
    ]
    if explanations is not None:
        parts.append(part("explanation", explanations, root="root", detail="explanation"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_feed(profile_runs: DataFrame, columns: DataFrame, signals: DataFrame, found: DataFrame, n: int = 10) -> DataFrame:
    """The last runs, newest first, with what each measured and found."""
    last = latest_runs(profile_runs, n)
    return last.select("run_id", "started_at").join(overview(columns, signals, found), "run_id").orderBy(F.desc("started_at"), F.desc("run_id"))


def validated(points: DataFrame, model: str, column: str, metric: str) -> DataFrame:
    """One series; a metric that is not drawn is an error, a column without points an empty series."""
    if metric not in CHART_METRICS:
        raise ValueError(f"no series of {metric!r}; there are {', '.join(CHART_METRICS)}")
    one = (F.col("model_name") == model) & (F.col("column_name") == column) & (F.col("metric") == metric)
    return points.where(one).orderBy("partition_value")


def payload_json(rows: DataFrame) -> DataFrame:
    return rows.select("run_id", F.to_json(F.struct(*rows.columns)).alias("payload"))
