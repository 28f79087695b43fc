import json
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import drift
from tidewatch.operators import lineage as L
from tidewatch.operators import rca as R
from tidewatch.operators.drift import SIGNAL_COLUMNS
from tidewatch.operators.ranking import positions
from tidewatch.sources.manifest import listing, read_manifest

SIGNALS = (
    "run_id string, baseline_run_id string, model_name string, column_name string, metric string, baseline_value double, "
    "current_value double, change double, severity string, partitions int, baseline_text string, current_text string, first_partition string"
)


def signals(spark, *rows):
    """(run, node, severity) triples as signals."""
    data = [(run, "b", node, "c", "mean_value", 1.0, 2.0, 1.0, sev, 0, None, None, None) for run, node, sev in rows]
    assert len(SIGNAL_COLUMNS) == len(data[0])
    return spark.createDataFrame(data, SIGNALS)


def graph(spark, parents):
    nodes = L.node_frame(spark, parents)
    edges = L.edges(nodes)
    return nodes, edges, L.hops(edges)


def ancestors(parents, node):
    seen, queue = set(), list(parents.get(node, []))
    while queue:
        n = queue.pop()
        if n not in seen:
            seen.add(n)
            queue += parents.get(n, [])
    return seen


def test_diamond_and_depth(spark):
    parents = {"a": [], "b": ["a"], "c": ["a", "b"], "d": ["b", "c"], "z": []}
    nodes, edges, hops = graph(spark, parents)
    got = {(r.descendant, r.ancestor) for r in L.closure(edges).collect()}
    assert got == {(n, a) for n in parents for a in ancestors(parents, n)}
    assert {r.name: r.depth for r in L.depth(nodes, hops).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "z": 0}
    kids = {r.parent: r.children for r in L.children(edges).collect()}
    assert kids == {"a": ["b", "c"], "b": ["c", "d"], "c": ["d"]}


def test_long_chain(spark):
    parents = {f"n{i}": [f"n{i - 1}"] if i else [] for i in range(21)}
    nodes, edges, hops = graph(spark, parents)
    assert L.closure(edges).count() == 21 * 20 // 2
    assert L.depth(nodes, hops).where("name = 'n20'").first().depth == 20


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_match_brute_force(spark, seed):
    """Reachability, roots, blast radius and depth of graphs with cycles and without."""
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    later = {n: names[:i] for i, n in enumerate(names)} if seed else {n: names for n in names}
    parents = {n: [p for p in later[n] if p != n and rng.random() < (0.25 if seed else 0.12)] for n in names}
    nodes, edges, hops = graph(spark, parents)
    got = {(r.descendant, r.ancestor) for r in L.closure(edges).collect()}
    assert got == {(n, a) for n in names for a in ancestors(parents, n)}
    hit = rng.sample(names, 7)
    s = signals(spark, *[("r", n, "high") for n in hit])
    root = R.roots(s, hops)
    want = {n for n in hit if not ancestors(parents, n) & set(hit)}
    assert {r.root for r in root.collect()} == want
    blast = {(r.root, r.node) for r in R.blast_radius(s, root, hops).collect()}
    assert blast == {(a, n) for n in hit for a in ancestors(parents, n) & want}

    def longest(n):
        return 0 if n in ancestors(parents, n) else max((1 + longest(p) for p in parents[n]), default=0)

    assert {r.name: r.depth for r in L.depth(nodes, hops).collect()} == {n: longest(n) for n in names}


def test_chain_of_ten_thousand_nodes(spark):
    """As many hop tables as the depth has binary digits, and no table of all pairs."""
    n = 10_000
    nodes, _, hops = graph(spark, {f"n{i}": [f"n{i - 1}"] if i else [] for i in range(n)})
    assert len(hops.levels) == 14 and all(t.count() < n for t in hops.levels)
    s = signals(spark, *[("r", f"n{i}", "high") for i in (17, 9_000, 9_999)], ("q", "n9999", "high"))
    root = R.roots(s, hops)
    assert {(r.run_id, r.root) for r in root.collect()} == {("r", "n17"), ("q", "n9999")}
    assert {r.node for r in R.blast_radius(s, root, hops).collect()} == {"n9000", "n9999"}
    assert L.depth(nodes, hops).agg(F.max("depth")).first()[0] == n - 1


@pytest.mark.parametrize("ranges", ["1", "7"])
def test_positions_equal_sorting(spark, ranges):
    """Groups of any size are numbered in ranges; a group of one run crosses all of them."""
    rng = random.Random(5)
    rows = [(rng.choice("aaaab"), rng.choice([None, *range(40)]), i) for i in range(900)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    got = positions(spark.createDataFrame(rows, "k string, v int, i int"), ["k"], [F.desc("v"), F.col("i")]).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for k in "ab":
        for at, row in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, -(r[1] or 0), r[2])), 1):
            want[row[2]] = at
    assert {r.i: r.position for r in got} == want


def test_no_window_over_a_whole_run(spark):
    s = signals(spark, ("r", "a", "high"), ("r", "b", "high"))
    plan = drift.numbered(s)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(run_id#" in plan and "_range" in plan.split("windowspecdefinition(")[1].split("specifiedwindowframe")[0]


def test_cycle_ends_and_has_no_root(spark):
    nodes, edges, hops = graph(spark, {"s": [], "a": ["b", "s"], "b": ["a"], "c": ["b"]})
    s = signals(spark, ("r", "a", "high"), ("r", "b", "high"), ("r", "c", "high"))
    assert R.roots(s, hops).count() == 0
    assert {r.name: r.depth for r in L.depth(nodes, hops).collect()} == {"s": 0, "a": 0, "b": 0, "c": 1}


def test_incidents_of_many_runs(spark):
    nodes, edges, hops = graph(spark, {"x": [], "y": [], "m": ["x"], "f": ["m", "y"], "o": ["f"]})
    s = signals(
        spark,
        ("two-roots", "x", "warning"), ("two-roots", "y", "critical"), ("two-roots", "f", "high"),
        ("gap", "x", "high"), ("gap", "o", "critical"),
        ("unknown", "not_in_manifest", "high"),
        ("same", "x", "high"), ("same", "y", "high"), ("same", "o", "warning"),
    )
    found = {(r.run_id, r.incident_rank): r for r in R.ranked(R.incidents(s, hops, nodes)).collect()}
    assert [found["two-roots", i].root for i in (1, 2)] == ["y", "x"]
    assert found["two-roots", 1].blast_radius == found["two-roots", 2].blast_radius == ["f"]
    assert found["gap", 1].root == "x" and found["gap", 1].blast_radius == ["o"] and found["gap", 1].severity == "high"
    assert found["unknown", 1].is_source is False and found["unknown", 1].blast_radius == []
    assert [found["same", i].root for i in (1, 2)] == ["x", "y"]
    totals = {r.run_id: (r.root_causes, r.affected_nodes) for r in R.totals(R.incidents(s, hops, nodes)).collect()}
    assert totals["two-roots"] == (2, 4) and totals["unknown"] == (1, 1)


def test_manifest(spark, tmp_path):
    doc = {
        "nodes": {
            "model.p.fct": {"resource_type": "model", "name": "fct", "relation_name": '"w"."fct"', "config": {"materialized": "table"},
                            "depends_on": {"nodes": ["model.p.stg", "model.other.gone"]}},
            "model.p.stg": {"resource_type": "model", "name": "stg", "relation_name": '"w"."stg"', "config": {"materialized": "view"},
                            "depends_on": {"nodes": ["source.p.raw.t"]}},
            "model.p.free": {"resource_type": "model", "name": "free", "relation_name": "free", "config": {"materialized": "view"}},
            "test.p.x": {"resource_type": "test", "name": "x", "config": {"materialized": "test"}, "depends_on": {"nodes": ["model.p.fct"]}},
        },
        "sources": {"source.p.raw.t": {"name": "t", "relation_name": '"raw"."t"'}},
    }
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps(doc, indent=2))
    nodes = read_manifest(spark, str(path))
    assert {(r.child, r.parent) for r in L.edges(nodes).collect()} == {("fct", "stg"), ("stg", "t")}
    assert [(r.name, r.kind, r.parents) for r in listing(nodes).collect()] == [
        ("t", "source", "-"), ("fct", "model", "stg, gone"), ("free", "model", "-"), ("stg", "model", "t"),
    ]


def test_list_text_round_trip(spark):
    df = spark.createDataFrame([("a, b",), ("",), (None,)], "t string")
    assert [r.v for r in df.select(R.listed(F.col("t")).alias("v")).collect()] == [["a", "b"], [], []]


@pytest.mark.parametrize(
    "raw, summary",
    [
        ('{"summary": "plain"}', "plain"),
        ('```json\n{"summary": "fenced"}\n```', "fenced"),
        ('Sure! {"summary": "prose", "likely_causes": [{"cause": "{x}"}]} Bye.', "prose"),
        ("no json here", None),
    ],
)
def test_answers_are_found_in_prose(spark, raw, summary):
    from tidewatch.operators.explain import parse

    got = spark.createDataFrame([(raw,)], "r string").select(parse(F.col("r")).alias("p")).first().p
    assert (got.summary if got else None) == summary
