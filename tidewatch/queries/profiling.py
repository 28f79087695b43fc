"""Sources, projections and profiles."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import drift as D
from ..operators import profile as P
from ..operators import report as R
from ..oracle import build as O
from ..plans import events as E
from ..session import materialise, shared_dir
from ..settings import Settings
from ..sources import store
from ..sources import tables as T
from .base import CTES, OBSERVED, observed, once, query, r6, sql, table, text

# table -> {column: class} of the given data, for the oracle (see oracle.build.metrics)
SCHEMAS = {
    "region": {"r_regionkey": "i", "r_name": "o"},
    "nation": {"n_nationkey": "i", "n_name": "o", "n_regionkey": "i"},
    "customer": {"c_custkey": "i", "c_name": "o", "c_nationkey": "i", "c_acctbal": "f", "c_mktsegment": "o"},
    "supplier": {"s_suppkey": "i", "s_name": "o", "s_nationkey": "i", "s_acctbal": "f"},
    "part": {"p_partkey": "i", "p_name": "o", "p_brand": "o", "p_type": "o", "p_size": "i", "p_retailprice": "f"},
    "orders": {"o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "o", "o_totalprice": "f", "o_orderdate": "o", "o_orderpriority": "o"},
    "lineitem": {
        "l_orderkey": "i", "l_partkey": "i", "l_suppkey": "i", "l_linenumber": "i", "l_quantity": "f", "l_extendedprice": "f",
        "l_discount": "f", "l_tax": "f", "l_returnflag": "o", "l_linestatus": "o", "l_shipdate": "o"},
    "events": {"event_id": "i", "ts": "o", "user_id": "i", "event_type": "o", "value": "f", "props": "o"},
    "documents": {"doc_id": "i", "text": "o", "lang": "o", "source": "o", "n_chars": "i"},
    "embeddings": {"vec_id": "i", "embedding": "l", "label": "i"},
    "pages": {"page_id": "i", "url": "o", "html": "o"},
    "benchmark": {"item_id": "i", "text": "o"},
    "labels": {"doc_id": "i", "quality": "i", "toxic": "i"},
    "conversations": {"conv_id": "i", "turn": "i", "role": "o", "text": "o"},
}
CLEAN = O.events_ctes([])
AXES = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


def _tables(spark, sf, names=None):
    return {n: table(spark, sf, n, spread=True) for n in (names or SCHEMAS)}


# ---------------------------------------------------------------- sources


@query("scan_parquet", "select event_id, cast(ts as varchar) as ts, user_id, event_type, round(value, 6) as value, props from events")
def scan_parquet(spark, sf):
    events = T.read_parquet(spark, f"{sf}/events*.parquet")
    return events.select("event_id", text("ts").alias("ts"), "user_id", "event_type", r6("value").alias("value"), "props")


SAMPLE = "((event_id + {0}) * 2654435761) % 4294967296, event_id"


@query(
    "sample_repeatable",
    "select l_orderkey, l_linenumber, round(l_extendedprice, 6) as l_extendedprice from (select *, l_orderkey * 8 + l_linenumber as k from lineitem) "
    "order by ((k + 42) * 2654435761) % 4294967296, k limit 1000",
)
def sample_repeatable(spark, sf):
    items = table(spark, sf, "lineitem").withColumn("k", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return T.sample_rows(items, "k", 1000, seed=42).select("l_orderkey", "l_linenumber", r6("l_extendedprice").alias("l_extendedprice"))


@query(
    "demo_sample",
    "select event_id, cast(ts as varchar) as ts, event_type, round(value, 6) as value from events where ts >= timestamp '2024-01-05' "
    f"and ts < timestamp '2024-01-25' order by {SAMPLE.format(7)} limit 2000",
)
def demo_sample(spark, sf):
    events = table(spark, sf, "events")
    window = events.where(
        (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-25").cast("timestamp_ntz"))
    )
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}/sample"
    T.write_sample(T.sample_rows(window, "event_id", 2000, seed=7), path)  # zstd; what is compared is the file's
    rows = T.read_parquet(spark, path)
    return rows.select("event_id", text("ts").alias("ts"), "event_type", r6("value").alias("value"))


_CLASS = {"f": "float", "i": "integer", "l": "other"}


def _class(column: str, kind: str) -> str:
    if column in AXES.values():
        return "date"
    return _CLASS.get(kind, "text")


@query(
    "list_columns",
    " union all ".join(
        f"select '{t}' as node, {i} as position, '{c}' as column_name, '{_class(c, k)}' as type_class, count(*) as row_count from {t}"
        for t, cols in SCHEMAS.items()
        for i, (c, k) in enumerate(cols.items(), 1)
    ),
)
def list_columns(spark, sf):
    return T.list_columns({n: table(spark, sf, n) for n in SCHEMAS})


SELECT = Settings(include=("*", ), exclude=("*e*s", "n?tion", "[pq]a*"))


@query(
    "select_nodes",
    " union all ".join(
        f"select '{t}' as node, count(*) as row_count from {t} having not regexp_matches('{t}', '^(.*e.*s|n.tion|[pq]a.*)$')"
        for t in SCHEMAS
    ),
)
def select_nodes(spark, sf):
    counts = None
    for name in SCHEMAS:
        one = table(spark, sf, name).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("node"), "row_count")
        # The node name is a constant, so a node left out is not even scanned.
        one = one.where(SELECT.selected(F.col("node")))
        counts = one if counts is None else counts.unionByName(one)
    return counts


# ---------------------------------------------------------------- projections


@query(
    "staging_projection",
    sql("select event_key, event_id, user_id, cast(event_at as varchar) as event_at, event_type, round(value_usd, 6) as value_usd, "
        "prop_k from stg_events", CLEAN),
)
def staging_projection(spark, sf):
    stg = E.staging(table(spark, sf, "events"))
    return stg.withColumns({"event_at": text("event_at"), "value_usd": r6("value_usd")})


@query(
    "surrogate_key",
    "select l_orderkey, l_linenumber, md5(concat_ws('|', l_orderkey, l_linenumber, l_shipdate, l_returnflag, "
    "case when l_linestatus = 'O' then l_suppkey end)) as sale_key from lineitem",
)
def surrogate_key(spark, sf):
    parts = ["l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag"]
    open_supplier = F.when(F.col("l_linestatus") == "O", F.col("l_suppkey"))
    key = F.md5(F.concat_ws("|", *[text(p) for p in parts], text(open_supplier)))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", key.alias("sale_key"))


_FLAGS = [f"flag_{n}" for n in E.FLAGS]


@query(
    "quality_flags",
    sql(f"select run_id, event_id, {', '.join(_FLAGS)}, is_clean, cast(event_date as varchar) as event_date from clean", CLEAN),
)
def quality_flags(spark, sf):
    fct = E.fact(E.staging(table(spark, sf, "events")))
    return fct.select(F.lit("baseline").alias("run_id"), "event_id", *_FLAGS, "is_clean", text("event_date").alias("event_date"))


@query(
    "agg_daily_revenue",
    sql("select cast(event_date as varchar) as event_date, event_type, events, round(revenue, 6) as revenue, "
        "round(avg_value, 6) as avg_value from agg_daily_events", CLEAN),
)
def agg_daily_revenue(spark, sf):
    mart = E.build(table(spark, sf, "events"))["agg_daily_events"]
    return mart.withColumns({"event_date": text("event_date"), "revenue": r6("revenue"), "avg_value": r6("avg_value")})


@query(
    "agg_daily_quality",
    sql("select * exclude (run_id) replace (cast(event_date as varchar) as event_date) from agg_daily_quality", CLEAN),
)
def agg_daily_quality(spark, sf):
    return E.build(table(spark, sf, "events"))["agg_daily_quality"].withColumn("event_date", text("event_date"))


# ---------------------------------------------------------------- profiles

PROFILE_OUT = ["model_name", "column_name", "row_count", "null_count", "distinct_count"]


def _profile_view(p, *extra):
    rates = {c: r6(c) for c in ("null_rate", "mean_value")}
    return p.withColumns(rates).select(*extra, *PROFILE_OUT, "null_rate", "min_value", "max_value", "mean_value")


def _profile_sql(extra: str, source: str) -> str:
    return (
        f"select {extra}{', '.join(PROFILE_OUT)}, round(null_rate, 6) as null_rate, min_value, max_value, "
        f"round(mean_value, 6) as mean_value from {source}"
    )


def _digits6(c: str):
    values = F.from_json(F.col(c), "array<double>")
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: r6(x).cast("decimal(38,6)").cast("string")), ","), F.lit("]"))


_ALL = " union all ".join(
    f"select '{t}' as model_name, '{c}' as column_name, {O.metrics(c, k)} from {t}"
    for t, cols in SCHEMAS.items()
    for c, k in cols.items()
)


@query("profile_whole_table", sql(_profile_sql("round(distinct_rate, 6) as distinct_rate, ", "allp"), {"allp": f"select *, {O.RATES} from ({_ALL})"}))
def profile_whole_table(spark, sf):
    # No axis: these profiles ask for the whole-table grain only.
    nodes = _tables(spark, sf)
    whole_only = Settings(partition_columns={n: None for n in nodes})
    p = P.column_profiles(P.profile_nodes(nodes, whole_only))
    # Engines write the floats of a list differently; they are compared by six digits, all of them.
    listed = F.col("data_type").startswith("array")
    p = p.withColumns({c: F.when(listed, _digits6(c)).otherwise(F.col(c)) for c in ("min_value", "max_value")})
    return _profile_view(p, r6("distinct_rate").alias("distinct_rate"))


_BIG = {t: (AXES[t], SCHEMAS[t]) for t in ("orders", "lineitem", "events")}


@query("profile_per_day", sql(_profile_sql("cast(partition_value as varchar) as partition_value, ", "pp"), O.profile_ctes(_BIG, {}, runs=False)))
def profile_per_day(spark, sf):
    p = P.partition_profiles(P.profile_nodes(_tables(spark, sf, _BIG)))
    return _profile_view(p, text("partition_value").alias("partition_value"))


@query(
    "partition_axis",
    sql(
        " union all ".join(
            f"select '{n}' as model_name, '{axis}' as axis, cast(min(cast({axis} as date)) as varchar) as first_day, "
            f"cast(max(cast({axis} as date)) as varchar) as last_day from {t}"
            for n, axis, t in (("events", "ts", "events"), ("lineitem", "l_shipdate", "lineitem"), ("fct_events", "event_date", "clean"))
        ),
        CLEAN,
    ),
)
def partition_axis(spark, sf):
    # One node per mode: first timestamp, fixed, off, and a date preferred to a timestamp.
    nodes = _tables(spark, sf, _BIG)
    nodes["fct_events"] = E.build(nodes["events"])["fct_events"]
    settings = Settings(partition_columns={"orders": None, "lineitem": "l_shipdate"})
    out = None
    for name, df in nodes.items():
        axis = P.partition_axis(df, name, settings)
        if axis is None:
            continue
        day = F.to_date(axis)
        row = df.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(
            F.lit(name).alias("model_name"), F.lit(axis).alias("axis"), text("a").alias("first_day"), text("b").alias("last_day")
        )
        out = row if out is None else out.unionByName(row)
    return out


LIMITS = (2000, 60)  # days a node may have; the wide axes then need months, or years


def _grain_sql(t: str, axis: str, limit: int) -> str:
    day, month, year = (f"count(distinct date_trunc('{g}', {axis}))" for g in ("day", "month", "year"))
    return (
        f"select '{t}' as model_name, {limit} as partition_limit, {day} as partitions, case when {day} <= {limit} then 'day' "
        f"when {month} <= {limit} then 'month' when {year} <= {limit} then 'year' end as grain from {t}"
    )


def _coarse(limit: int) -> Settings:
    return Settings(max_partitions=limit, coarser=("month", "year"))


def _axes_profile(spark, sf):
    """The date columns and one number of the dated tables, at all grains."""
    def make():
        numbers = {"orders": "o_totalprice", "lineitem": "l_partkey", "events": "user_id"}
        nodes = {n: df.select(AXES[n], numbers[n]) for n, df in _tables(spark, sf, AXES).items()}
        return materialise(P.profile_nodes(nodes, Settings(max_partitions=1, coarser=("month", "year"), sketches=True)), "grains")

    return once(spark, ("grains", sf), make)


@query("partition_guard", " union all ".join(_grain_sql(t, a, n) for t, a in AXES.items() for n in LIMITS))
def partition_guard(spark, sf):
    p = _axes_profile(spark, sf)
    each = [P.partition_guard(p, _coarse(n)).withColumn("partition_limit", F.lit(n)) for n in LIMITS]
    return each[0].unionByName(each[1]).select("model_name", "partition_limit", "partitions", "grain")


_NUMBERED = {"orders": ("o_totalprice", "f"), "lineitem": ("l_partkey", "i"), "events": ("user_id", "i")}
_GRAINED = {
    f"p_{t}": " union all ".join(
        f"select '{t}' as model_name, '{c}' as column_name, '{g}' as grain, cast(date_trunc('{g}', {a}) as date) as partition_value, "
        f"{O.metrics(c, k)} from {t} where {a} is not null group by 4"
        for g in ("day", "month", "year") for c, k in ((a, "o"), _NUMBERED[t])
    )
    for t, a in AXES.items()
}


@query(
    "profile_coarse",
    sql("select g.partition_limit, p.model_name, p.grain, cast(partition_value as varchar) as partition_value, column_name, row_count, null_count, "
        "distinct_count, min_value, max_value, round(mean_value, 6) as mean_value from prof p join guard g using (model_name, grain)",
        {**_GRAINED, "prof": " union all ".join(f"select * from p_{t}" for t in AXES),
         "guard": " union all ".join(_grain_sql(t, a, n) for t, a in AXES.items() for n in LIMITS)}),
)
def profile_coarse(spark, sf):
    """Per-period profiles at the finest grain that each limit allows."""
    p = _axes_profile(spark, sf)
    each = [P.partition_profiles(p, _coarse(n)).withColumn("partition_limit", F.lit(n)) for n in LIMITS]
    return each[0].unionByName(each[1]).select(
        "partition_limit", "model_name", "grain", text("partition_value").alias("partition_value"), "column_name", "row_count", "null_count",
        "distinct_count", "min_value", "max_value", r6("mean_value").alias("mean_value"),
    )


@query(
    "distinct_by_sketch",
    " union all ".join(
        f"select '{t}' as model_name, '{c}' as column_name, cast(year({a}) as varchar) as span, count(distinct {f'round({c}, 6)' if k == 'f' else c}) "
        f"as distinct_count, true as within_5_percent from {t} where {a} is not null group by 3"
        for t, a in AXES.items() for c, k in ((a, "o"), _NUMBERED[t])
    ),
)
def distinct_by_sketch(spark, sf):
    """Distinct values of a year, exactly and as the union of the sketches of its days."""
    p = _axes_profile(spark, sf)
    years = p.where(F.col("grain") == "year").select("model_name", "column_name", F.year("partition_value").cast("string").alias("span"), "distinct_count")
    spans = p.where(F.col("grain") == "year").select("partition_value").distinct().select(
        F.year("partition_value").cast("string").alias("span"), F.col("partition_value").alias("first_day"),
        F.last_day(F.add_months("partition_value", 11)).alias("last_day"),
    )
    guess = P.distinct_over(p.where(F.col("grain") == P.DAY), spans).drop("run_id")
    off = F.abs(F.col("distinct_estimate") - F.col("distinct_count"))
    return years.join(guess, ["model_name", "column_name", "span"]).select(
        "model_name", "column_name", "span", "distinct_count", (off <= F.col("distinct_count") * 0.05 + 1).alias("within_5_percent")
    )


MASKED = Settings(mask_values=("event_*", "*_KEY"))


@query(
    "mask_bounds",
    sql(
        "select run_id, model_name, column_name, case when min_value is null then null when regexp_matches(lower(column_name), "
        "'^(event_.*|.*_key)$') then '<masked>' when length(min_value) > 120 then substr(min_value, 1, 117) || '...' else min_value end as min_shown, "
        "case when max_value is null then null when regexp_matches(lower(column_name), '^(event_.*|.*_key)$') then '<masked>' "
        "when length(max_value) > 120 then substr(max_value, 1, 117) || '...' else max_value end as max_shown from cp"
    ),
)
def mask_bounds(spark, sf):
    name = F.col("column_name")
    return observed(spark, sf).columns.select(
        "run_id", "model_name", "column_name",
        X.shown_bound(name, F.col("min_value"), MASKED).alias("min_shown"),
        X.shown_bound(name, F.col("max_value"), MASKED).alias("max_shown"),
    )


# ---------------------------------------------------------------- history

# The history of the observed runs: one a day from the last event on, in the order they are observed.
_ORDER = ["baseline", *OBSERVED]
_STARTED = "case run_id " + " ".join(f"when '{r}' then {i}" for i, r in enumerate(_ORDER)) + " end"
HISTORY = {
    **CTES,
    "started": "select run_id, models_count, cast((select max(ts) from events)::timestamp + to_days(" + _STARTED + ") as varchar) as started_at "
               "from (select run_id, count(distinct model_name)::int as models_count from cp group by 1)",
}


def _history(spark, sf) -> store.MetricStore:
    """A store that holds every observed run, written as `run_profile` writes one."""
    def make():
        last = table(spark, sf, "events").agg(F.max("ts").cast("string").alias("ts")).first().ts
        start = datetime.fromisoformat(last)
        kept = store.MetricStore(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
        seen = observed(spark, sf)
        both = seen.partitions.withColumns({"data_type": F.lit(None).cast("string"), "distinct_rate": F.lit(None).cast("double")})
        whole = seen.columns.withColumns({"grain": F.lit(P.WHOLE), "partition_value": F.lit(None).cast("date")})
        kept.add_profiles(whole.unionByName(both), {r: start + timedelta(days=i) for i, r in enumerate(_ORDER)}, finished_at=start)
        at = F.lit(start).cast("timestamp")
        # Signals of some runs were written before three columns existed.
        early = F.col("run_id").startswith("unit")
        old = seen.signals.where(early).withColumn("detected_at", at).drop("partitions", "baseline_text", "current_text", "first_partition")
        old.write.partitionBy("run_id").parquet(kept.path("drift_signals"))
        kept.append("drift_signals", seen.signals.where(~early).withColumn("detected_at", at))
        return kept

    return once(spark, ("history", sf), make)


@query(
    "column_history",
    sql("select run_id, started_at as profiled_at, row_count, round(null_rate, 6) as null_rate, distinct_count, min_value, "
        "max_value from cp join started using (run_id) where model_name = 'events' and column_name = 'user_id' order by 2", HISTORY),
)
def column_history(spark, sf):
    rows = store.history(_history(spark, sf).read("column_profiles"), "events", "user_id")
    return rows.withColumns({"null_rate": r6("null_rate"), "profiled_at": text("profiled_at")})


@query("latest_runs", sql("select run_id, started_at, models_count from started order by 2 desc limit 2", HISTORY))
def latest_runs(spark, sf):
    """The two newest runs of the stored history."""
    runs = R.latest_runs(_history(spark, sf).read("profile_runs"), 2)
    return runs.select("run_id", text("started_at").alias("started_at"), "models_count")


@query(
    "run_feed",
    sql("select s.run_id, s.started_at, s.models_count::bigint as nodes, sum(v.n)::bigint as rows_profiled, "
        "(select count(*) from sig x where x.run_id = s.run_id) as signals, (select count(*) from roots x where x.run_id = s.run_id) as incidents "
        "from started s join (select run_id, model_name, max(row_count) as n from cp group by 1, 2) v on v.run_id = s.run_id group by all "
        "order by 2 desc limit 4", HISTORY),
)
def run_feed(spark, sf):
    """The last four runs of the history with what each measured and found."""
    kept = _history(spark, sf)
    feed = R.run_feed(kept.read("profile_runs"), kept.read("column_profiles"), kept.read("drift_signals"), observed(spark, sf).incidents, 4)
    return feed.withColumn("started_at", text("started_at"))


@query(
    "profile_run_history",
    sql("select run_id, model_name, 'table' as grain, count(*) as profiles, sum(row_count)::bigint as measured, any_value(started_at) as first_at from cp "
        "join started using (run_id) group by 1, 2 union all "
        "select run_id, model_name, 'day', count(*), sum(row_count)::bigint, any_value(started_at) from pp join started using (run_id) group by 1, 2", HISTORY),
)
def profile_run_history(spark, sf):
    """Rows of both profile tables as the store holds them."""
    kept = _history(spark, sf)
    both = kept.read("column_profiles").select("run_id", "model_name", "row_count", "profiled_at", F.lit("table").alias("grain")).unionByName(
        kept.read("partition_profiles").select("run_id", "model_name", "row_count", "profiled_at", "grain")
    )
    return both.groupBy("run_id", "model_name", "grain").agg(
        F.count(F.lit(1)).alias("profiles"), F.sum("row_count").alias("measured"), text(F.min("profiled_at")).alias("first_at")
    )


@query(
    "history_merge_schema",
    sql("select run_id, model_name, column_name, metric, severity, case when run_id like 'unit%' then null else partitions end as partitions, "
        "case when run_id like 'unit%' then null else baseline_text end as baseline_text from sig"),
)
def history_merge_schema(spark, sf):
    """Signals written before three columns existed, read from one table next to current ones."""
    kept = _history(spark, sf).read("drift_signals")
    return kept.select("run_id", "model_name", "column_name", "metric", "severity", "partitions", "baseline_text")


@query(
    "run_volume",
    sql("select run_id, sum(n)::bigint as volume from (select run_id, model_name, max(row_count) as n from cp group by 1, 2) group by 1"),
)
def run_volume(spark, sf):
    return D.run_volume(observed(spark, sf).columns)


@query(
    "volume_series",
    sql("select run_id, model_name, cast(partition_value as varchar) as partition_value, max(row_count) as row_count from pp group by 1, 2, 3"),
)
def volume_series(spark, sf):
    from ..operators.rolling import volume_series as series

    rows = series(observed(spark, sf).partitions)
    return rows.select("run_id", "model_name", text("partition_value").alias("partition_value"), F.col("value").cast("bigint").alias("row_count"))
