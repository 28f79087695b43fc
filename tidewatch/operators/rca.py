"""Root-cause analysis: where drift starts, and what it was carried into.

A node is a root if it drifted and none of its ancestors did.  The search starts at the drifted
nodes and walks down by hops; every step is a join keyed by run_id, so any number of runs is
analysed in one plan, whose rows are runs x drifted nodes and what they reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..session import materialise
from .lineage import Hops, below
from .ranking import positions


def affected(signals: DataFrame) -> DataFrame:
    return signals.select("run_id", "model_name").distinct()


def roots(signals: DataFrame, over: Hops) -> DataFrame:
    """(run, root): affected nodes that are downstream of no affected node."""
    hit = affected(signals)
    tainted = below(hit.withColumnRenamed("model_name", "node"), over).withColumnRenamed("node", "model_name")
    return hit.join(tainted, ["run_id", "model_name"], "left_anti").select("run_id", F.col("model_name").alias("root"))


def blast_radius(signals: DataFrame, root: DataFrame, over: Hops) -> DataFrame:
    """(run, root, node): drifted nodes downstream of a root, through nodes that did not drift too."""
    reached = below(root.select("run_id", "root", F.col("root").alias("node")), over)
    return reached.join(affected(signals).withColumnRenamed("model_name", "node"), ["run_id", "node"])


def evidence(signals: DataFrame, root: DataFrame) -> DataFrame:
    """The signals at the root of each incident."""
    return root.join(
        signals.withColumnRenamed("model_name", "root"), ["run_id", "root"]
    ).withColumn("partitions", F.coalesce("partitions", F.lit(0)))


EVIDENCE_FIELDS = [
    "sev_rank", "order_change", "column_name", "metric", "partitions", "baseline_value",
    "current_value", "change", "severity", "baseline_text", "current_text", "first_partition",
]


def ordered_evidence(rows: DataFrame) -> DataFrame:
    """Evidence with its sort keys first, so that sorting the structs sorts the lines."""
    return rows.withColumns(
        {
            "sev_rank": X.severity_rank(F.col("severity")),
            "order_change": -X.settled(F.col("change")),
        }
    )


def incidents(signals: DataFrame, over: Hops, nodes: DataFrame) -> DataFrame:
    """One row per run and root, with columns, blast radius and evidence.

    The arrays are bounded by the shape of the lineage graph (nodes x columns x
    metrics), not by data volume.
    """
    root = materialise(roots(signals, over), "roots")
    per_root = (
        ordered_evidence(evidence(signals, root))
        .groupBy("run_id", "root")
        .agg(
            F.min("sev_rank").alias("sev_rank"),
            F.array_sort(F.collect_set("column_name")).alias("columns"),
            F.array_sort(F.collect_list(F.struct(*EVIDENCE_FIELDS))).alias("evidence"),
            F.count(F.lit(1)).cast("int").alias("signal_count"),
        )
    )
    columns = signals.groupBy("run_id", F.col("model_name").alias("node")).agg(
        F.array_sort(F.collect_set("column_name")).alias("columns")
    )
    down = (
        blast_radius(signals, root, over)
        .join(columns, ["run_id", "node"])
        .groupBy("run_id", "root")
        .agg(F.array_sort(F.collect_list(F.struct("node", "columns"))).alias("downstream"))
    )
    known = nodes.select(F.col("name").alias("root"), "is_source").distinct()
    joined = per_root.join(down, ["run_id", "root"], "left").join(known, "root", "left")
    downstream = F.coalesce(
        "downstream", F.array().cast("array<struct<node:string,columns:array<string>>>")
    )
    return joined.select(
        "run_id", "root",
        F.coalesce("is_source", F.lit(False)).alias("is_source"),
        X.severity_name(F.col("sev_rank")).alias("severity"),
        "columns",
        F.transform(downstream, lambda d: d["node"]).alias("blast_radius"),
        F.map_from_entries(downstream).alias("downstream_columns"),
        "evidence", "signal_count", "sev_rank",
    )


def ranked(found: DataFrame) -> DataFrame:
    """Incidents of a run in order: severity, then blast size, then name."""
    return positions(found, ["run_id"], [F.col("sev_rank"), F.desc(F.size("blast_radius")), F.col("root")], "incident_rank")


def flattened(found: DataFrame) -> DataFrame:
    """Lists as text, the shape of the incidents table."""
    return found.select(
        "run_id", "root", "is_source", "severity",
        F.concat_ws(", ", "columns").alias("columns"),
        F.concat_ws(", ", "blast_radius").alias("blast_radius"),
        "signal_count",
    )


def listed(text) -> Column:
    """A stored list text as an array again, without empty entries."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ", "), lambda v: v != "")


def totals(found: DataFrame) -> DataFrame:
    """Root causes per run and the nodes they explain; overlaps count twice."""
    return found.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("root_causes"),
        F.sum(1 + F.size("blast_radius")).alias("affected_nodes"),
    )
