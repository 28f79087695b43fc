"""Reading observed tables, describing them, and sampling them repeatably."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import row_order


def read_parquet(spark: SparkSession, pattern: str, spread: bool = False) -> DataFrame:
    """One table from one file or many.

    With spread, a table stored in fewer splits than there are cores is dealt out
    over them once, before the work per row multiplies; large tables have more
    splits than that and are read as they are.
    """
    df = spark.read.parquet(pattern)
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def type_class(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dtype, T.NumericType):
        return "integer"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "text" if isinstance(dtype, T.StringType) else "other"


def list_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """(node, position, column, class, rows) of the given tables, one scan each."""
    out = None
    for name, df in tables.items():
        entries = F.array(
            *[
                F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("column_name"), F.lit(type_class(f.dataType)).alias("type_class"))
                for i, f in enumerate(df.schema.fields)
            ]
        )
        rows = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("node"), "row_count", F.inline(entries))
        out = rows if out is None else out.unionByName(rows)
    return out


_SLICE_BITS = 12


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows, the same ones however the table is split; the key has to be unique.

    Rows are ranked by a hash of their key and cut at a hash value: the hash range
    is counted in a million slices, whole slices are taken by a filter, and only the
    slice that holds the cut is ranked.
    """
    ordered = df.withColumn("_o", row_order(key, seed))
    sliced = ordered.withColumn("_s", F.shiftright("_o", _SLICE_BITS))
    counts = sliced.groupBy("_s").agg(F.count(F.lit(1)).alias("c"))
    # One window over the slice counts: at most 2**20 of them, whatever the table holds.
    seen = counts.withColumn("seen", F.sum("c").over(Window.orderBy("_s")))
    cut = seen.where(F.col("seen") >= n).agg(F.min_by(F.struct("_s", (F.col("seen") - F.col("c")).alias("before")), "_s").alias("cut"))
    marked = sliced.withColumn("_cut", cut.scalar())
    below = marked.where(F.col("_cut").isNull() | (F.col("_s") < F.col("_cut._s")))
    rank = F.row_number().over(Window.partitionBy("_s").orderBy("_o", key))
    rim = marked.where(F.col("_s") == F.col("_cut._s")).withColumn("_r", rank).where(F.col("_r") <= n - F.col("_cut.before"))
    return below.unionByName(rim.drop("_r")).drop("_o", "_s", "_cut")


def write_sample(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
