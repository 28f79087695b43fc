"""The fault benchmark: every scenario profiled, compared, traced and scored in one go."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.runs import MAX_RUNS
from ..operators import drift, lineage, profile, rca
from ..session import materialise
from ..settings import Settings
from . import events as E
from .scenarios import BASELINE, Scenario, catalogue, catalogue_frame


@dataclass
class Observed:
    """The metric tables of a batch of runs over the events nodes."""

    columns: DataFrame
    partitions: DataFrame
    pairs: DataFrame
    nodes: DataFrame
    edges: DataFrame
    hops: lineage.Hops
    settings: Settings
    _signals: DataFrame | None = None
    _incidents: DataFrame | None = None
    _roots: DataFrame | None = None

    @property
    def signals(self) -> DataFrame:
        if self._signals is None:
            found = drift.previous_run(self.columns, self.partitions, self.pairs, self.settings)
            self._signals = materialise(found, "signals")
        return self._signals

    @property
    def roots(self) -> DataFrame:
        if self._roots is None:
            self._roots = materialise(rca.roots(self.signals, self.hops), "roots")
        return self._roots

    @property
    def incidents(self) -> DataFrame:
        if self._incidents is None:
            found = rca.ranked(rca.incidents(self.signals, self.hops, self.nodes))
            self._incidents = materialise(found, "incidents")
        return self._incidents


def profiles(events: DataFrame, scenarios: Sequence[Scenario], settings: Settings) -> DataFrame:
    """Profiles of the clean run and of every scenario, in as few batches as the run masks allow."""
    step = MAX_RUNS - 1  # the baseline takes part in every batch
    batches = [scenarios[i : i + step] for i in range(0, len(scenarios), step)] or [[]]
    out = None
    for batch in batches:
        nodes = E.layers(events, batch, store=True)
        # A mart is small, but what it is made of is not: written once, it is not made again for each pass.
        nodes |= {mart: materialise(nodes[mart], mart) for mart in E.MARTS}
        part = profile.profile_nodes(nodes, settings, E.run_ids(batch))
        out = part if out is None else out.unionByName(part.where(F.col("run_id") != BASELINE))
    return out


def observe(events: DataFrame, scenarios: Sequence[Scenario], settings: Settings | None = None) -> Observed:
    """Profile the clean nodes and one run per scenario, reading the events once per pass."""
    settings = settings or Settings()
    spark = events.sparkSession
    stored = materialise(profiles(events, scenarios, settings), "profiles")
    nodes = lineage.node_frame(spark, E.PARENTS)
    edge = lineage.edges(nodes)
    return Observed(
        columns=profile.column_profiles(stored),
        partitions=profile.partition_profiles(stored, settings),
        pairs=drift.run_pairs(spark, [(BASELINE, s.id) for s in scenarios]) if scenarios else None,
        nodes=nodes,
        edges=edge,
        hops=lineage.hops(edge),
        settings=settings,
    )


def scores(spark: SparkSession, seen: Observed, scenarios: Sequence[Scenario] | None = None) -> DataFrame:
    """One row per scenario: detected, root and column right, passed."""
    catalog = catalogue_frame(spark, list(scenarios) if scenarios else catalogue())
    counts = seen.signals.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_signals"))
    found = seen.incidents
    per_run = found.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_incidents"),
        F.min_by(F.struct("root", "columns"), "incident_rank").alias("top"),
        F.min_by("root", F.when(F.col("sev_rank") <= 1, F.col("incident_rank"))).alias("alert_root"),
        F.bool_or(F.col("sev_rank") <= 1).alias("alert"),
    )
    rows = catalog.join(counts, "run_id", "left").join(per_run, "run_id", "left")
    control = F.col("layer") == "control"
    alert = F.coalesce("alert", F.lit(False))
    detected = F.when(control, alert).otherwise(F.col("top").isNotNull())
    root = F.when(control, F.when(alert, F.col("alert_root"))).otherwise(F.col("top.root"))
    root_ok = F.when(control, ~alert).otherwise(F.coalesce(F.col("top.root") == F.col("expected_root"), F.lit(False)))
    named = F.exists(
        "expected_columns", lambda e: F.exists(F.coalesce(F.col("top.columns"), F.array()), lambda c: c.contains(e))
    )
    column_ok = (
        F.when(control, ~alert)
        .when(F.size("expected_columns") == 0, F.col("root_correct"))
        .otherwise(F.coalesce(named, F.lit(False)))
    )
    passed = F.when(control, ~F.col("detected")).otherwise(
        F.col("detected") & F.col("root_correct") & F.col("column_correct")
    )
    return (
        rows.withColumns({"detected": detected, "predicted_root": root, "root_correct": root_ok})
        .withColumn("column_correct", column_ok)
        .withColumn("passed", passed)
        .select(
            F.col("run_id").alias("scenario"), "layer", "magnitude", "window", "description", "detected",
            "predicted_root", "root_correct", "column_correct", "passed",
            F.coalesce("n_signals", F.lit(0)).alias("n_signals"),
            F.coalesce("n_incidents", F.lit(0)).alias("n_incidents"),
        )
    )


def summary(results: DataFrame) -> DataFrame:
    fault = F.col("layer") != "control"

    def count(flag):
        return F.count_if(fault & flag)

    total = F.count_if(fault)
    return results.agg(
        total.alias("total"),
        count(F.col("detected")).alias("detected"),
        X.safe_ratio(count(F.col("detected")), total).alias("detection_rate"),
        count(F.col("root_correct")).alias("root_correct"),
        count(F.col("column_correct")).alias("column_correct"),
        count(F.col("passed")).alias("passed"),
        X.safe_ratio(count(F.col("passed")), total).alias("pass_rate"),
        F.count_if(~fault).alias("controls"),
        F.count_if(~fault & F.col("detected")).alias("false_positives"),
    )


def breakdown(results: DataFrame) -> DataFrame:
    """Passed and total by magnitude, window and layer, in one aggregation."""
    dims = ["magnitude", "window", "layer"]
    sets = results.groupingSets([[d] for d in dims], *dims).agg(
        *[F.grouping(d).alias("g_" + d) for d in dims],
        F.count_if("passed").alias("passed"),
        F.count(F.lit(1)).alias("total"),
    )
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        here = F.col("g_" + d) == 0
        name, value = F.when(here, d).otherwise(name), F.when(here, F.col(d)).otherwise(value)
    return sets.select(name.alias("dimension"), value.alias("value"), "passed", "total")


def misses(results: DataFrame) -> DataFrame:
    return results.where(~F.col("passed")).select("scenario", "description", "detected", "predicted_root")
