"""Drift of a day against the days before it, within one run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..settings import Settings
from .drift import _signals

SERIES = ["run_id", "model_name", "column_name", "metric"]
COLUMN_METRICS = ("null_rate", "distinct_count", "mean_value")
TABLE = "(table)"


def volume_series(partitions: DataFrame) -> DataFrame:
    """Rows per node and day; the columns of a node share it."""
    days = partitions.groupBy("run_id", "model_name", "partition_value")
    return days.agg(F.max("row_count").cast("double").alias("value")).select(
        "run_id", "model_name", F.lit(TABLE).alias("column_name"),
        F.lit("row_count").alias("metric"), "partition_value", "value",
    )


def dense_days(partitions: DataFrame, settings: Settings) -> DataFrame:
    """Daily rows without the days that hold hardly any rows.

    A series must be longer than the minimum history before and after dropping
    its sparse days.
    """
    series = Window.partitionBy("run_id", "model_name", "column_name")
    typical = F.percentile(F.col("row_count").cast("double"), F.lit(0.5)).over(series)
    points = F.count(F.lit(1)).over(series)
    long_enough = partitions.withColumns({"_typical": typical, "_points": points}).where(
        F.col("_points") > settings.min_history
    )
    dense = long_enough.where(
        F.col("row_count") >= F.col("_typical") * settings.min_partition_share
    )
    return (
        dense.withColumn("_points", points)
        .where(F.col("_points") > settings.min_history)
        .drop("_points", "_typical")
    )


def column_series(partitions: DataFrame, settings: Settings) -> DataFrame:
    values = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
            for m in COLUMN_METRICS
        ]
    )
    return dense_days(partitions, settings).select(
        "run_id", "model_name", "column_name", "partition_value", F.inline(values)
    ).select(*SERIES, "partition_value", "value")


def scored(points: DataFrame, settings: Settings) -> DataFrame:
    """Every point with the median, MAD and z of the rows before it.

    A frame is a number of rows, not of calendar days, and never leaves its
    series, so series spread over the cluster and none needs more than its own
    days in memory.
    """
    series = Window.partitionBy(*SERIES).orderBy("partition_value")
    frame = series.rowsBetween(-settings.window, -1)
    whole = Window.partitionBy(*SERIES)
    median = X.middle(F.col("history"))
    spread = F.transform("history", lambda h: F.abs(h - F.col("median")))
    return (
        points.withColumns(
            {
                "history": F.collect_list("value").over(frame),
                "_points": F.count(F.lit(1)).over(whole),
            }
        )
        .withColumn("median", median)
        .withColumn("mad", X.middle(spread))
        .withColumn("z", X.robust_z(F.col("value"), F.col("median"), F.col("mad")))
    )


def flags(points: DataFrame, settings: Settings) -> DataFrame:
    """Points with enough history whose z reaches the limit."""
    enough = (F.col("_points") > settings.min_history) & (F.size("history") >= settings.min_history)
    return scored(points, settings).where(
        enough & F.col("value").isNotNull() & (X.settled(F.col("z")) >= settings.z)
    )


def signals_of(flagged: DataFrame, settings: Settings) -> DataFrame:
    """One signal per series whose worst day is also large enough to matter."""
    worst_first = F.struct(X.settled(F.col("z")), -F.unix_date("partition_value"))
    worst = flagged.groupBy(*SERIES).agg(
        F.max_by(F.struct("median", "value", "z"), worst_first).alias("worst"),
        F.count(F.lit(1)).cast("int").alias("partitions"),
        F.min("partition_value").cast("string").alias("first_partition"),
    )
    med, val, z = F.col("worst.median"), F.col("worst.value"), F.col("worst.z")
    change = X.relative_change(med, val)
    practical = F.when(F.col("metric") == "null_rate", F.abs(val - med)).otherwise(change)
    limit = settings.limit(F.col("model_name"), F.col("metric"))
    severity: Column = F.when(F.col("partitions") < 2, "warning").otherwise(
        settings.grade(X.settled(z), F.lit(settings.z))
    )
    return _signals(
        worst.where(X.settled(practical) >= limit),
        baseline_run_id=F.lit(None).cast("string"),
        baseline_value=med, current_value=val, change=change, severity=severity,
    )


def rolling(partitions: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Volume once per node, then the column metrics, for every run given."""
    settings = settings or Settings()
    points = volume_series(partitions).unionByName(column_series(partitions, settings))
    return signals_of(flags(points, settings), settings)
