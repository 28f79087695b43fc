"""Run membership: which runs a row belongs to, as bits of one bigint.

Profiling a clean table and sixty broken copies of it row by row would read the
table sixty-one times.  Instead a row that is the same in many runs is kept once
and carries one bit per run; only rows that differ are added.  Aggregates are
taken per distinct mask and fanned out to runs once they are small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import literal

RUNS = "_runs"
MAX_RUNS = 63


def bit(index: int) -> int:
    return 1 << index


def tag(df: DataFrame, index: int) -> DataFrame:
    """Mark every row as belonging to one run."""
    return df.withColumn(RUNS, F.lit(bit(index)).cast("bigint"))


def mask_of(df: DataFrame) -> Column:
    return F.col(RUNS) if RUNS in df.columns else F.lit(1).cast("bigint")


def has_runs(df: DataFrame) -> bool:
    return RUNS in df.columns


def run_names(mask: str, runs: Sequence[str]) -> Column:
    """The array of run ids whose bit is set in a mask column."""
    if len(runs) > MAX_RUNS:
        raise ValueError(f"at most {MAX_RUNS} runs per batch")
    pairs = ", ".join(f"struct({bit(i)}L as bit, {literal(r)} as run)" for i, r in enumerate(runs))
    return F.expr(f"transform(filter(array({pairs}), p -> (p.bit & {mask}) != 0), p -> p.run)")


def single_bits(df: DataFrame) -> DataFrame:
    """Fan rows out so that each carries exactly one run."""
    bits = f"transform(sequence(0, {MAX_RUNS - 1}), i -> shiftleft(1L, i))"
    return df.withColumn(RUNS, F.explode(F.expr(f"filter({bits}, b -> (b & {RUNS}) != 0)")))


def aggregate_per_run(df: DataFrame, keys: Sequence[str], **sums: Column) -> DataFrame:
    """Additive aggregates per key and run.

    Rows are first reduced per (key, mask), so the fan-out to runs touches only
    partial sums, never input rows.
    """
    if not has_runs(df):
        return df.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])
    part = df.groupBy(*keys, RUNS).agg(*[c.alias(n) for n, c in sums.items()])
    return single_bits(part).groupBy(*keys, RUNS).agg(*[F.sum(n).alias(n) for n in sums])
