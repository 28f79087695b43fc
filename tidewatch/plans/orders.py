"""The worked example: orders, a filtered staging view, a fact with a fee, a daily mart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import exact_sums, exact_totals
from ..operators.overlay import Edit, apply_fault

PARENTS = {
    "orders": [],
    "stg_orders": ["orders"],
    "fct_orders": ["stg_orders"],
    "agg_daily_orders": ["fct_orders"],
}


def seed(spark: SparkSession, n: int = 90000) -> DataFrame:
    """The deterministic example table: no randomness and no clock."""
    i = F.col("id")
    cents = F.round(F.lit(10) + (i % 137) * F.expr("0.37BD"), 2)
    return spark.range(1, n + 1).select(
        i.alias("order_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 90).cast("int")).alias("order_date"),
        (1 + i % 5).cast("int").alias("customer_segment"),
        cents.cast("double").alias("amount"),
        F.when(i % 7 != 0, (1 + i % 3).cast("int")).alias("channel_id"),
    )


def from_tables(orders: DataFrame) -> DataFrame:
    """The given orders in the shape of the example."""
    k = F.col("o_orderkey")
    return orders.select(
        k.alias("order_id"),
        F.to_date("o_orderdate").alias("order_date"),
        (1 + F.col("o_custkey") % 5).cast("int").alias("customer_segment"),
        F.col("o_totalprice").alias("amount"),
        F.when(k % 7 != 0, (1 + k % 3).cast("int")).alias("channel_id"),
    )


def recent(orders: DataFrame, days: int = 29) -> Column:
    """The last days of the table, counted from its own newest order."""
    newest = orders.agg(F.date_sub(F.max("order_date"), days))
    return F.col("order_date") >= newest.scalar()


def inflated(orders: DataFrame, factor: float = 1.6) -> DataFrame:
    return apply_fault(orders, Edit("scale", "amount", factor), recent(orders))


def build(orders: DataFrame) -> dict[str, DataFrame]:
    stg = orders.where(F.col("amount") > 0).select(
        "order_id", "order_date", "customer_segment", F.col("amount").alias("amount_usd"), "channel_id"
    )
    fct = stg.withColumn("fee_usd", F.col("amount_usd") * 0.1)
    sums = exact_sums(amount=F.col("amount_usd"), fee=F.col("fee_usd"))
    daily = fct.groupBy("order_date").agg(
        F.count(F.lit(1)).alias("order_count"), F.count("amount_usd").alias("priced"), *[c.alias(n) for n, c in sums.items()]
    )
    agg = exact_totals(daily, "amount", "fee").select(
        "order_date", "order_count", (F.col("amount") / F.col("priced")).alias("avg_amount_usd"), F.col("fee").alias("total_fee_usd")
    )
    return {"orders": orders, "stg_orders": stg, "fct_orders": fct, "agg_daily_orders": agg}
