"""The lineage graph as DataFrames: edges, hops, closure, depth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import NODE
from ..session import materialise


def node_frame(spark: SparkSession, parents: Mapping[str, Sequence[str]]) -> DataFrame:
    """Nodes from a {name: [parents]} declaration; a node without parents is a source."""
    def uid(n: str) -> str:
        return f"model.{n}" if parents.get(n) else f"source.{n}"

    rows = [
        (uid(n), n, n, "table" if ps else "source", [uid(p) for p in ps], not ps)
        for n, ps in parents.items()
    ]
    return spark.createDataFrame(rows, NODE)


def edges(nodes: DataFrame) -> DataFrame:
    """(child, parent) by name; dependencies outside the known nodes are dropped."""
    wanted = nodes.select(
        F.col("name").alias("child"), F.posexplode("depends_on").alias("position", "parent_id")
    )
    known = nodes.select(F.col("unique_id").alias("parent_id"), F.col("name").alias("parent"))
    return wanted.join(known, "parent_id").select("child", "parent", "position")


def children(edge: DataFrame) -> DataFrame:
    return edge.groupBy("parent").agg(F.array_sort(F.collect_set("child")).alias("children"))


def closure(edge: DataFrame) -> DataFrame:
    """(descendant, ancestor) pairs; a node on a cycle is its own ancestor.

    All pairs, for who wants to list them; root causes and depths are found by `hops`.

    Known paths are joined with themselves, so a chain of n nodes takes log2(n)
    rounds instead of n; cycles end because a round without new pairs stops.
    Each round is written out, which keeps the plan flat.
    """
    reach = materialise(
        edge.select(F.col("child").alias("descendant"), F.col("parent").alias("ancestor")).distinct(),
        "closure",
    )
    size = reach.count()
    while True:
        left = reach.select("descendant", F.col("ancestor").alias("_via"))
        right = reach.select(F.col("descendant").alias("_via"), "ancestor")
        grown = materialise(
            reach.unionByName(left.join(right, "_via").drop("_via")).distinct(), "closure"
        )
        now = grown.count()
        if now == size:
            return reach
        reach, size = grown, now


@dataclass(frozen=True)
class Hops:
    """Walks of 1, 2, 4, ... edges as tables of (descendant, ancestor), and whether there are cycles.

    A walk of any length is a sequence of hops of falling powers of two, so what lies below a set of
    nodes is found with one join per table, log2(depth) of them, and no table of all pairs.
    """

    levels: list[DataFrame]
    cyclic: bool


def hops(edge: DataFrame) -> Hops:
    """The hop tables of a graph; each is written out, so that the next one starts from it."""
    level = materialise(
        edge.select(F.col("child").alias("descendant"), F.col("parent").alias("ancestor")).distinct(), "hops"
    )
    longest = level.select("descendant").distinct().count()  # of a walk that visits no node twice
    levels = [level]
    while True:
        upper = level.select(F.col("descendant").alias("_via"), "ancestor")
        lower = level.select("descendant", F.col("ancestor").alias("_via"))
        level = materialise(lower.join(upper, "_via").select("descendant", "ancestor").distinct(), "hops")
        if level.isEmpty():
            return Hops(levels, False)
        if 1 << len(levels) > longest:
            return Hops(levels, True)
        levels.append(level)


def below(seeds: DataFrame, over: Hops) -> DataFrame:
    """The nodes strictly downstream of each seed.  seeds: any keys, and a column `node`."""
    keys = [c for c in seeds.columns if c != "node"]
    first = over.levels[0].withColumnRenamed("ancestor", "node")
    found = seeds.join(first, "node").select(*keys, F.col("descendant").alias("node")).distinct()
    for level in reversed(over.levels):
        onward = found.join(level.withColumnRenamed("ancestor", "node"), "node", "left")
        found = onward.select(*keys, F.explode(F.array_compact(F.array("node", "descendant"))).alias("node")).distinct()
    return found


def on_cycles(over: Hops) -> DataFrame:
    """Nodes that are their own ancestors: all pairs, but of those alone that long walks both reach and leave."""
    core = over.levels[-1]
    both = core.select(F.col("descendant").alias("node")).intersect(core.select(F.col("ancestor").alias("node")))
    edge = over.levels[0]
    for side in ("descendant", "ancestor"):
        edge = edge.join(both.withColumnRenamed("node", side), side, "left_semi")
    reach = closure(edge.select(F.col("descendant").alias("child"), F.col("ancestor").alias("parent")))
    return reach.where(F.col("descendant") == F.col("ancestor")).select(F.col("descendant").alias("node"))


def depth(nodes: DataFrame, over: Hops) -> DataFrame:
    """Longest path from a source; nodes on a cycle count as depth 0."""
    if over.cyclic:
        steps = over.levels[0].join(on_cycles(over).withColumnRenamed("node", "descendant"), "descendant", "left_anti")
        over = hops(steps.select(F.col("descendant").alias("child"), F.col("ancestor").alias("parent")))
    known = nodes.select("name", F.lit(0).alias("depth"))
    for i in range(len(over.levels) - 1, -1, -1):
        onward = known.join(over.levels[i].withColumnRenamed("ancestor", "name"), "name", "left")
        deeper = F.when(
            F.col("descendant").isNotNull(), F.struct(F.col("descendant").alias("name"), (F.col("depth") + (1 << i)).alias("depth"))
        )
        each = onward.select(F.explode(F.array_compact(F.array(F.struct("name", "depth"), deeper))).alias("at"))
        known = each.groupBy("at.name").agg(F.max("at.depth").alias("depth"))
    return known
