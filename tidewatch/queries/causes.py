"""Lineage and root causes."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from ..operators import drift as D

from ..operators import lineage as L
from ..operators import profile as P
from ..operators import rca as R
from ..oracle import build as O
from ..plans import orders as ORD
from ..plans import sales as SALES
from ..session import materialise
from ..sources.manifest import listing, read_manifest
from .base import SIGNAL_SQL, observed, once, query, r6, rounded, signal_view, sql, table, text

MANIFEST = str(Path(__file__).parent.parent / "plans" / "events_manifest.json")


@query(
    "manifest_nodes",
    sql("select n.name, case when n.is_source then 'source' else 'model' end as kind, "
        "case when n.is_source then 'source' when n.name like 'stg%' then 'view' else 'table' end as materialized, "
        "coalesce((select string_agg(parent, ', ' order by parent) from edges where child = n.name), '-') as parents, "
        "max(c.row_count) as row_count from nodes n join cp c on c.model_name = n.name where c.run_id = 'baseline' group by all"),
)
def manifest_nodes(spark, sf):
    nodes = listing(read_manifest(spark, MANIFEST))
    rows = observed(spark, sf).columns.where(F.col("run_id") == "baseline").groupBy(F.col("model_name").alias("name"))
    return nodes.join(rows.agg(F.max("row_count").alias("row_count")), "name")


@query(
    "lineage_edges",
    sql("select e.child, e.parent, count(distinct s.run_id) as runs_drifted_together from edges e left join affected s on s.model_name = e.child "
        "and exists (select 1 from affected p where p.run_id = s.run_id and p.model_name = e.parent) group by 1, 2"),
)
def lineage_edges(spark, sf):
    seen = observed(spark, sf)
    edges = L.edges(read_manifest(spark, MANIFEST)).select("child", "parent")
    hit = R.affected(seen.signals)
    both = (
        edges.join(hit.withColumnRenamed("model_name", "child"), "child")
        .join(hit.withColumnRenamed("model_name", "parent"), ["run_id", "parent"])
        .select("child", "parent", "run_id")
    )
    return edges.join(both, ["child", "parent"], "left").groupBy("child", "parent").agg(
        F.count_distinct("run_id").alias("runs_drifted_together")
    )


@query(
    "lineage_closure",
    sql("select r.descendant, r.ancestor, count(s.metric) as signals_above from reach r left join sig s on s.model_name = r.ancestor group by 1, 2"),
)
def lineage_closure(spark, sf):
    seen = observed(spark, sf)
    above = seen.signals.groupBy(F.col("model_name").alias("ancestor")).agg(F.count("metric").alias("signals_above"))
    return L.closure(seen.edges).join(above, "ancestor", "left").select(
        "descendant", "ancestor", F.coalesce("signals_above", F.lit(0)).alias("signals_above")
    )


@query(
    "lineage_depth",
    sql("select n.name, coalesce(d.depth, 0)::int as depth, count(distinct s.column_name) as drifted_columns from nodes n left join "
        "(select descendant, count(*) as depth from reach group by 1) d on d.descendant = n.name left join sig s on s.model_name = n.name group by all"),
)
def lineage_depth(spark, sf):
    seen = observed(spark, sf)
    depths = L.depth(seen.nodes, seen.hops)
    drifted = seen.signals.groupBy(F.col("model_name").alias("name")).agg(F.count_distinct("column_name").alias("drifted_columns"))
    return depths.join(drifted, "name", "left").select("name", "depth", F.coalesce("drifted_columns", F.lit(0)).alias("drifted_columns"))


@query("rca_roots", sql("select run_id, root from roots"))
def rca_roots(spark, sf):
    return observed(spark, sf).roots


@query("rca_blast_radius", sql("select run_id, root, node from blast"))
def rca_blast_radius(spark, sf):
    seen = observed(spark, sf)
    return R.blast_radius(seen.signals, seen.roots, seen.hops).select("run_id", "root", "node")

_INCIDENT_SQL = "run_id, root, is_source, severity, columns, blast_radius, signal_count, incident_rank"


@query("incidents", sql(f"select {_INCIDENT_SQL} from incidents order by run_id, incident_rank"))
def incidents(spark, sf):
    found = observed(spark, sf).incidents
    return R.flattened(found).join(found.select("run_id", "root", "incident_rank"), ["run_id", "root"]).orderBy("run_id", "incident_rank")


@query(
    "incident_downstream",
    sql("select b.run_id, b.root, b.node, c.columns from blast b join node_cols c on c.run_id = b.run_id and c.model_name = b.node"),
)
def incident_downstream(spark, sf):
    found = observed(spark, sf).incidents
    return found.select("run_id", "root", F.explode("downstream_columns").alias("node", "names")).select(
        "run_id", "root", "node", F.concat_ws(", ", "names").alias("columns")
    )


@query(
    "incident_evidence",
    sql("select run_id, root, row_number() over (partition by run_id, root order by sev_rank, round(change, 9) desc, column_name, metric, partitions) "
        "as position, column_name, metric, severity, partitions, round(baseline_value, 6) as baseline_value, round(current_value, 6) as current_value, "
        "round(change, 6) as change, baseline_text, current_text, first_partition from evidence"),
)
def incident_evidence(spark, sf):
    rows = observed(spark, sf).incidents.select("run_id", "root", F.posexplode("evidence").alias("position", "e"))
    plain = [F.col(f"e.{c}") for c in ("column_name", "metric", "severity", "partitions", "baseline_text", "current_text", "first_partition")]
    numbers = [r6(f"e.{c}").alias(c) for c in ("baseline_value", "current_value", "change")]
    return rows.select("run_id", "root", (F.col("position") + 1).alias("position"), *plain, *numbers)


@query(
    "incident_totals",
    sql("select run_id, count(*) as root_causes, sum(1 + blast_size)::bigint as affected_nodes from incidents group by 1"),
)
def incident_totals(spark, sf):
    return R.totals(observed(spark, sf).incidents)

_AFFECTED_RUNS = "select distinct run_id from sig"


@query(
    "lineage_status",
    sql(f"select r.run_id, n.name, case when n.is_source then 'source' else 'model' end as kind, "
        "coalesce((select count(*) from reach where descendant = n.name), 0)::int as depth, "
        "case when exists (select 1 from roots x where x.run_id = r.run_id and x.root = n.name) then 'root' "
        "when exists (select 1 from blast x where x.run_id = r.run_id and x.node = n.name) then 'affected' else 'clean' end as status, "
        "case when exists (select 1 from roots x where x.run_id = r.run_id and x.root = n.name) then 'root' "
        "when exists (select 1 from affected x where x.run_id = r.run_id and x.model_name = n.name) then 'affected' else 'ok' end as state "
        f"from ({_AFFECTED_RUNS}) r cross join nodes n"),
)
def lineage_status(spark, sf):
    return status(spark, sf)

def status(spark, sf):
    from ..operators.report import lineage_status as labels

    seen = observed(spark, sf)
    compared = seen.columns.join(seen.signals.select("run_id").distinct(), "run_id", "left_semi")
    blast = R.blast_radius(seen.signals, seen.roots, seen.hops)
    return labels(seen.nodes, L.depth(seen.nodes, seen.hops), compared, seen.signals, seen.roots, blast)


# ---------------------------------------------------------------- worked example on the given orders

_ORDERS = {
    "raw_orders": "select 'baseline' as run_id, o_orderkey as order_id, cast(o_orderdate as date) as order_date, "
                  "(1 + o_custkey % 5)::int as customer_segment, o_totalprice as amount, "
                  "case when o_orderkey % 7 <> 0 then (1 + o_orderkey % 3)::int end as channel_id from orders",
    "faulty_orders": "select 'inflated' as run_id, * exclude (run_id) replace (case when order_date >= (select max(order_date) - 29 from raw_orders) "
                     "then amount * 1.6e0 else amount end as amount) from raw_orders",
    "both_orders": "select * from raw_orders union all select * from faulty_orders",
    "stg_orders": "select run_id, order_id, order_date, customer_segment, amount as amount_usd, channel_id from both_orders where amount > 0",
    "fct_orders": "select *, amount_usd * 0.1e0 as fee_usd from stg_orders",
    "agg_daily_orders": "select run_id, order_date, count(*) as order_count, sum(amount_usd::decimal(28, 8))::double / count(amount_usd) as avg_amount_usd, sum(fee_usd::decimal(28, 8))::double as total_fee_usd "
                        "from fct_orders group by all",
}
_BASE = {"order_id": "i", "order_date": "o", "customer_segment": "i"}
_ORDER_NODES = {
    "orders": ("order_date", {**_BASE, "amount": "f", "channel_id": "i"}),
    "stg_orders": ("order_date", {**_BASE, "amount_usd": "f", "channel_id": "i"}),
    "fct_orders": ("order_date", {**_BASE, "amount_usd": "f", "channel_id": "i", "fee_usd": "f"}),
    "agg_daily_orders": ("order_date", {"order_date": "o", "order_count": "i", "avg_amount_usd": "f", "total_fee_usd": "f"}),
}
_ORDER_CTES = {**_ORDERS, **O.profile_ctes(_ORDER_NODES, {"orders": "both_orders"}), **O.signal_ctes()}


@query(
    "orders_fault",
    sql("select cast(order_date as varchar) as order_date, count(*) filter (where run_id = 'baseline') as orders, "
        "round(sum(amount) filter (where run_id = 'baseline'), 4) as amount_before, round(sum(amount) filter (where run_id = 'inflated'), 4) "
        "as amount_after from both_orders group by 1", _ORDER_CTES),
)
def orders_fault(spark, sf):
    orders = ORD.from_tables(table(spark, sf, "orders"))
    after = F.when(ORD.recent(orders), F.col("amount") * 1.6).otherwise(F.col("amount"))
    return orders.withColumn("after", after).groupBy(text("order_date").alias("order_date")).agg(
        F.count(F.lit(1)).alias("orders"), rounded(F.sum("amount"), 4).alias("amount_before"), rounded(F.sum("after"), 4).alias("amount_after")
    )


@query(
    "orders_dag",
    sql("select cast(order_date as varchar) as order_date, order_count, round(avg_amount_usd, 4) as avg_amount_usd, "
        "round(total_fee_usd, 4) as total_fee_usd from agg_daily_orders where run_id = 'inflated'", _ORDER_CTES),
)
def orders_dag(spark, sf):
    mart = ORD.build(ORD.inflated(ORD.from_tables(table(spark, sf, "orders"))))["agg_daily_orders"]
    return mart.select(
        text("order_date").alias("order_date"), "order_count", rounded("avg_amount_usd", 4).alias("avg_amount_usd"),
        rounded("total_fee_usd", 4).alias("total_fee_usd"),
    )


@query("orders_drift", sql(f"select {SIGNAL_SQL} from sig", _ORDER_CTES))
def orders_drift(spark, sf):
    """The worked example end to end."""
    def make():
        orders = ORD.from_tables(table(spark, sf, "orders", spread=True))
        profiles = P.profile_nodes(ORD.build(orders), runs=["baseline"]).unionByName(
            P.profile_nodes(ORD.build(ORD.inflated(orders)), runs=["inflated"])
        )
        return materialise(profiles, "orders")

    stored = once(spark, ("orders", sf), make)
    pairs = D.run_pairs(spark, [("baseline", "inflated")])
    return signal_view(D.previous_run(P.column_profiles(stored), P.partition_profiles(stored), pairs))


# ---------------------------------------------------------------- two sources, one fact

_LATE_O, _LATE_L = "o_orderdate >= timestamp '1996-01-01'", "l_shipdate >= timestamp '1996-01-01'"
_SALES = {
    "raw_o": "select 'baseline' as run_id, * from orders union all select 'one-source', * from orders union all "
             f"select 'both-sources', * replace (case when {_LATE_O} then null else o_orderstatus end as o_orderstatus) from orders",
    "raw_l": "select 'baseline' as run_id, * from lineitem union all "
             + " union all ".join(
                 f"select '{r}', * replace (case when {_LATE_L} then l_extendedprice * 1.3e0 else l_extendedprice end as l_extendedprice) from lineitem"
                 for r in ("one-source", "both-sources")),
    "stg_o": "select run_id, o_orderkey as order_id, o_custkey as customer_id, o_orderstatus as status, o_totalprice as total_usd, "
             "o_orderdate as ordered_at, o_orderpriority as priority from raw_o",
    "stg_l": "select run_id, l_orderkey as order_id, l_linenumber as line_number, l_quantity as quantity, l_extendedprice as price_usd, "
             "l_discount as discount, l_shipdate as shipped_at from raw_l",
    "fct_s": "select run_id, order_id, line_number, status, quantity, price_usd, price_usd * (1 - discount) as net_usd, "
             "cast(ordered_at as date) as order_date from stg_l join stg_o using (run_id, order_id)",
    "monthly": "select run_id, cast(date_trunc('month', order_date) as date) as month, count(*) as lines, sum(net_usd::decimal(28, 8))::double as net_usd, "
               "sum(quantity::decimal(28, 8))::double as quantity from fct_s group by all",
    "by_status": "select run_id, status, count(*) as lines, sum(net_usd::decimal(28, 8))::double as net_usd from fct_s group by all",
}
_SALES_NODES = {
    "orders": ("o_orderdate", {"o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "o", "o_totalprice": "f", "o_orderdate": "o", "o_orderpriority": "o"}),
    "lineitem": ("l_shipdate", {"l_orderkey": "i", "l_partkey": "i", "l_suppkey": "i", "l_linenumber": "i", "l_quantity": "f", "l_extendedprice": "f",
                        "l_discount": "f", "l_tax": "f", "l_returnflag": "o", "l_linestatus": "o", "l_shipdate": "o"}),
    "stg_orders": ("ordered_at", {"order_id": "i", "customer_id": "i", "status": "o", "total_usd": "f", "ordered_at": "o", "priority": "o"}),
    "stg_lineitem": ("shipped_at", {"order_id": "i", "line_number": "i", "quantity": "f", "price_usd": "f", "discount": "f", "shipped_at": "o"}),
    "fct_sales": ("order_date", {"order_id": "i", "line_number": "i", "status": "o", "quantity": "f", "price_usd": "f", "net_usd": "f", "order_date": "o"}),
    "agg_monthly_sales": ("month", {"month": "o", "lines": "i", "net_usd": "f", "quantity": "f"}),
    "agg_status_revenue": (None, {"status": "o", "lines": "i", "net_usd": "f"}),
}
_SALES_REL = {"orders": "raw_o", "lineitem": "raw_l", "stg_orders": "stg_o", "stg_lineitem": "stg_l", "fct_sales": "fct_s",
              "agg_monthly_sales": "monthly", "agg_status_revenue": "by_status"}
_SALES_EDGES = [(c, p) for c, ps in SALES.PARENTS.items() for p in ps]
_SALES_CTES = {
    **_SALES, **O.profile_ctes(_SALES_NODES, _SALES_REL), **O.signal_ctes(), **O.lineage_ctes(_SALES_EDGES, ["orders", "lineitem"]),
}

def _sales(spark, sf):
    def make():
        orders, items = SALES.broken_sources(table(spark, sf, "orders", spread=True), table(spark, sf, "lineitem", spread=True))
        stored = materialise(P.profile_nodes(SALES.build(orders, items, store=True), runs=SALES.RUN_IDS), "sales")
        pairs = D.run_pairs(spark, [("baseline", r) for r in SALES.RUN_IDS[1:]])
        signals = materialise(D.previous_run(P.column_profiles(stored), P.partition_profiles(stored), pairs), "sales_signals")
        nodes = L.node_frame(spark, SALES.PARENTS)
        return signals, L.hops(L.edges(nodes)), nodes

    return once(spark, ("sales", sf), make)


@query("sales_drift", sql(f"select {SIGNAL_SQL} from sig", _SALES_CTES))
def sales_drift(spark, sf):
    """Two sources, three runs; every node with a date is compared per day."""
    return signal_view(_sales(spark, sf)[0])


@query("sales_incidents", sql(f"select {_INCIDENT_SQL} from incidents", _SALES_CTES))
def sales_incidents(spark, sf):
    signals, hops, nodes = _sales(spark, sf)
    found = R.ranked(R.incidents(signals, hops, nodes))
    return R.flattened(found).join(found.select("run_id", "root", "incident_rank"), ["run_id", "root"])
