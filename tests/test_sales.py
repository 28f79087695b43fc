from tidewatch.functions.layers import as_layers
from tidewatch.operators import profile as P
from tidewatch.plans import sales as SALES
from tidewatch.sources.tables import read_parquet


def _nodes(spark, small, **how):
    return SALES.build(*SALES.broken_sources(*(read_parquet(spark, f"{small}/{t}.parquet") for t in ("orders", "lineitem"))), **how)


def test_sources_are_joined_once(spark, small):
    """What is profiled of the fact and its marts reads written rows, the same ones as without writing."""
    stored, lazy = _nodes(spark, small, store=True), _nodes(spark, small)
    for node in ("fct_sales", "agg_monthly_sales", "agg_status_revenue"):
        assert "Join" not in stored[node]._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(str, stored[node].collect())) == sorted(map(str, lazy[node].collect()))


def test_distinct_values_are_found_once(spark, small):
    """Both grains are counted from one shuffle of the distinct values."""
    table = as_layers(_nodes(spark, small)["orders"])
    fields = [f for f in table.base.schema.fields if f.name in table.columns]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = P._distinct_counts(P.distinct_values(table, fields, "o_orderdate"), SALES.RUN_IDS, [P.DAY])
        assert "ReusedExchange" in counts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
