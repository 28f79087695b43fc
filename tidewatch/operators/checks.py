"""Declarative data checks: all return (node, column_name, check, failures, rows)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(node: str, column: str, check: str, failures, rows) -> list[Column]:
    return [
        F.lit(node).alias("node"), F.lit(column).alias("column_name"), F.lit(check).alias("check"),
        failures.alias("failures"), rows.alias("rows"),
    ]


def not_null(df: DataFrame, node: str, columns: Sequence[str]) -> DataFrame:
    """All columns in one aggregate over one scan."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)])
    rows = F.array(
        *[F.struct(*_row(node, c, "not_null", F.col("rows") - F.col(f"n{i}"), F.col("rows"))) for i, c in enumerate(columns)]
    )
    return counts.select(F.inline(rows))


def unique(df: DataFrame, node: str, column: str) -> DataFrame:
    """Values that occur more than once; nulls are not compared."""
    per_value = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return per_value.agg(
        F.count_if(F.col(column).isNotNull() & (F.col("n") > 1)).alias("failures"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
    ).select(*_row(node, column, "unique", F.col("failures"), F.col("rows")))


def accepted_values(df: DataFrame, node: str, column: str, values: Sequence) -> DataFrame:
    """Distinct values outside the documented set."""
    per_value = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return per_value.agg(
        F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(*values)).alias("failures"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
    ).select(*_row(node, column, "accepted_values", F.col("failures"), F.col("rows")))


def unexpected_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """The undocumented values themselves, with how often they occur."""
    return (
        df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))
        .groupBy(F.col(column).alias("value_field"))
        .agg(F.count(F.lit(1)).alias("n_records"))
    )


def singular(df: DataFrame, failing: Column) -> DataFrame:
    """A query that must return no rows: the failing rows are the result."""
    return df.where(failing)


def quality_report(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """Rows and percentage per predicate, all counted in one scan."""
    names = list(predicates)
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(predicates[n]).alias(f"n{i}") for i, n in enumerate(names)],
    )
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"n{i}").alias("n")) for i, n in enumerate(names)])
    pct = F.when(F.col("total") > 0, F.col("n") / F.col("total") * 100).otherwise(0.0)
    return counts.select("total", F.inline(rows)).select("check", "n", "total", F.round(pct, 6).alias("pct"))


def all_of(results: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), results)
