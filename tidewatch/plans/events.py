"""The observed events nodes: one source, a staging projection, a flagged fact, two marts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import any_of, exact_sums, exact_totals
from ..functions.layers import Layers, marks
from ..functions.runs import RUNS, aggregate_per_run, bit
from ..operators.overlay import add_faults
from .scenarios import BASELINE, Scenario

PARENTS = {
    "events": [],
    "stg_events": ["events"],
    "fct_events": ["stg_events"],
    "agg_daily_events": ["fct_events"],
    "agg_daily_quality": ["fct_events"],
}
MARTS = ("agg_daily_events", "agg_daily_quality")

# Documented codes and the period the data covers.
EVENT_TYPES = ("signup", "error", "click", "view", "purchase")
PERIOD = ("2024-01-01", "2024-02-01")

FLAGS = ("negative_value", "no_user", "error", "low_purchase", "unknown_type", "out_of_period")


def _carry(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in marks(df)]


def _when(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def staging(events: DataFrame) -> DataFrame:
    """Rename and type the raw columns; bad text becomes null, not a failed job."""
    key = F.concat_ws("|", F.col("event_id"), F.col("ts"), F.col("user_id"))
    return events.select(
        F.md5(key).alias("event_key"),
        "event_id",
        "user_id",
        F.col("ts").alias("event_at"),
        "event_type",
        F.col("value").try_cast("double").alias("value_usd"),
        F.get_json_object("props", "$.k").try_cast("int").alias("prop_k"),
        *_carry(events),
    )


def fact(stg: DataFrame) -> DataFrame:
    """Flag doubtful events instead of removing them; an unknown flag stays unknown."""
    at, kind = F.col("event_at"), F.col("event_type")
    flags = {
        "negative_value": F.col("value_usd") < 0,
        "no_user": F.col("user_id").isNull(),
        "error": kind == "error",
        "low_purchase": (kind == "purchase") & (F.col("value_usd") < 1),
        "unknown_type": ~kind.isin(*EVENT_TYPES),
        "out_of_period": (at < _when(PERIOD[0])) | (at >= _when(PERIOD[1])),
    }
    flagged = stg.withColumns({f"flag_{n}": c for n, c in flags.items()})
    return flagged.withColumns(
        {
            "is_clean": ~any_of([F.col(f"flag_{n}") for n in FLAGS]),
            "event_date": F.to_date("event_at"),
        }
    )


def daily_events(fct: DataFrame) -> DataFrame:
    """Revenue per day and event type over clean events."""
    sums = aggregate_per_run(
        fct.where("is_clean"), ["event_date", "event_type"],
        events=F.count(F.lit(1)), _valued=F.count("value_usd"), **exact_sums(revenue=F.col("value_usd")),
    )
    sums = exact_totals(sums, "revenue")
    columns = [c for c in sums.columns if c not in ("_valued", "revenue")]
    return sums.select(*columns, "revenue", "_valued").withColumn("avg_value", F.try_divide(F.col("revenue"), F.col("_valued"))).drop("_valued")


def daily_quality(fct: DataFrame) -> DataFrame:
    """Events per day, clean events, and events per flag."""
    return aggregate_per_run(
        fct, ["event_date"],
        events_total=F.count(F.lit(1)),
        events_clean=F.count_if("is_clean"),
        **{f"n_{n}": F.count_if(F.col(f"flag_{n}")) for n in FLAGS},
    )


def run_ids(scenarios: Sequence[Scenario]) -> list[str]:
    return [BASELINE, *[s.id for s in scenarios]]


_SCOPE_COLUMNS = {"events": ("ts", "event_id"), "fct_events": ("event_at", "event_id")}


# What the marts read of the fact: copies of an event that are equal in these are one row.
_DAILY_EVENTS = ("is_clean", "event_date", "event_type", "value_usd")
_DAILY_QUALITY = ("is_clean", "event_date", *[f"flag_{n}" for n in FLAGS])


def layers(events: DataFrame, scenarios: Sequence[Scenario] = (), store: bool = False) -> dict[str, DataFrame | Layers]:
    """All nodes; the source, staging and fact in layers (see functions.layers), the marts flat."""

    def broken(table: DataFrame | Layers, node: str, store: bool = False) -> Layers:
        time_column, key_column = _SCOPE_COLUMNS[node]
        faults = [
            (i + 1, s.edit, s.scope.sql(time_column, key_column))
            for i, s in enumerate(scenarios)
            if s.node == node and s.edit is not None
        ]
        return add_faults(table, faults, store)

    everyone = bit(len(scenarios) + 1) - 1
    raw = broken(events.withColumn(RUNS, F.lit(everyone).cast("bigint")), "events", store) if scenarios else Layers(events)
    stg = raw.map(staging)
    fct = stg.map(fact)
    if scenarios:
        fct = broken(fct, "fct_events")
    return {
        "events": raw,
        "stg_events": stg,
        "fct_events": fct,
        "agg_daily_events": daily_events(fct.flat(_DAILY_EVENTS)),
        "agg_daily_quality": daily_quality(fct.flat(_DAILY_QUALITY)),
    }


def build(events: DataFrame, scenarios: Sequence[Scenario] = ()) -> dict[str, DataFrame]:
    """All nodes; with scenarios, each node holds the rows of every run (see functions.runs)."""
    return {name: node.flat() if isinstance(node, Layers) else node for name, node in layers(events, scenarios).items()}
