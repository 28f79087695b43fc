"""The registry of named queries and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..oracle import build as O
from ..plans import evaluate as V
from ..plans import scenarios as S
from ..session import materialise
from ..settings import Settings
from ..sources.tables import read_parquet

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The runs most queries look at: one per kind of fault, next to the clean baseline.
OBSERVED = (
    "unit-change-large-month", "null-spike-large-week", "row-drop-medium-month",
    "case-change-large-week", "mart-null-large-month",
)
RUNS = S.by_id(*OBSERVED)
CTES = O.events_ctes(RUNS)
ROLLING = {**CTES, **O.rolling_ctes()}

_MEMO: dict[tuple, object] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def forget() -> None:
    """Drop the stored metric tables, so that the next query computes its own."""
    _MEMO.clear()


def once(spark: SparkSession, key: tuple, make: Callable[[], object]):
    """Metric tables are written once and read by many queries, as in production."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _MEMO:
        _MEMO[full] = make()
    return _MEMO[full]


def table(spark: SparkSession, sf: str, name: str, spread: bool = False) -> DataFrame:
    return read_parquet(spark, f"{sf}/{name}.parquet", spread)


def observed(spark: SparkSession, sf: str, settings: Settings | None = None, tag: str = "") -> V.Observed:
    return once(
        spark, ("observed", sf, tag),
        lambda: V.observe(table(spark, sf, "events", spread=True), RUNS, settings),
    )


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the whole fault catalogue."""
    def make() -> DataFrame:
        seen = V.observe(table(spark, sf, "events", spread=True), S.catalogue())
        return materialise(V.scores(spark, seen), "scores")

    return once(spark, ("results", sf), make)


def r6(c: Column | str) -> Column:
    return rounded(c, 6)


def rounded(c: Column | str, digits: int) -> Column:
    """Rounded for comparison, as decimals: a tie is then the same tie in every engine."""
    value = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.round(value.try_cast("decimal(38,12)"), digits).cast("double"), value.cast("double"))


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


SIGNAL_OUT = [
    "run_id", "model_name", "column_name", "metric", "severity", "partitions", "baseline_text", "current_text",
    "first_partition",
]


def signal_view(signals: DataFrame) -> DataFrame:
    return signals.select(*SIGNAL_OUT, *[r6(c).alias(c) for c in ("baseline_value", "current_value", "change")])


SIGNAL_SQL = f"{', '.join(SIGNAL_OUT)}, round(baseline_value, 6) as baseline_value, round(current_value, 6) as current_value, round(change, 6) as change"


def sql(final: str, ctes: dict[str, str] = CTES) -> str:
    return O.with_ctes(ctes, O.decimal_rounds(final))
