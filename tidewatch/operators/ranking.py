"""Row numbers within groups, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """df with the number of each row within its keys, in the given order, from 1.

    Rows are dealt by ranges of (keys, order) and numbered inside their range; a range then
    starts behind as many rows of its group as the ranges before it hold.  A group may so be of any
    size.  The dealt rows are written, as ranges are sampled and must not be dealt twice.  Rows
    that are equal in keys and order meet in one range.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    sizes = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))
    earlier = sizes.select(*keys, F.col("_range").alias("_before"), "_size")
    pairs = sizes.drop("_size").join(earlier, list(keys)).where(F.col("_before") < F.col("_range"))
    offsets = pairs.groupBy(*keys, "_range").agg(F.sum("_size").alias("_offset"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    numbered = dealt.withColumn("_at", F.row_number().over(inside)).join(offsets, [*keys, "_range"], "left")
    at = (F.col("_at") + F.coalesce("_offset", F.lit(0))).cast("int")
    return numbered.select(*df.columns, at.alias(name))


def totals(df: DataFrame, keys: Sequence[str], name: str = "total") -> DataFrame:
    """df with the number of rows of its keys."""
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), list(keys))
