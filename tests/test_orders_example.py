"""The worked example, from the seeded table to the alert, through the stored tables."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.api import Observatory
from tidewatch.operators import lineage as L
from tidewatch.operators import report as R
from tidewatch.plans import orders as O
from tidewatch.settings import Settings


@pytest.fixture(scope="module")
def watch(spark, tmp_path_factory):
    clean = O.seed(spark)
    nodes = L.node_frame(spark, O.PARENTS)
    store = str(tmp_path_factory.mktemp("store"))
    w = Observatory(spark, O.build(clean), nodes, store)
    w.profile("r1", at=datetime(2024, 4, 1))
    w.profile("r2", at=datetime(2024, 4, 2))
    w.tables = O.build(O.inflated(clean))
    w.profile("r3", at=datetime(2024, 4, 3))
    return w


@pytest.fixture(scope="module")
def signals(watch):
    return [r.asDict() for r in watch.detect("r3", "r2").collect()]


def test_seed_table(spark):
    row = O.seed(spark).where("order_id = 137").first()
    assert (str(row.order_date), row.customer_segment, row.amount, row.channel_id) == ("2024-02-17", 3, 10.0, 3)
    assert O.seed(spark).where("channel_id is null").count() == 90000 // 7


def test_identical_runs_are_silent(watch):
    assert watch.detect("r2", "r1").count() == 0
    watch.gate("r2", "warning")
    assert watch.analyse("r2").count() == 0


def test_latest_runs_are_the_default(watch, signals):
    assert watch.latest_runs(2) == ["r3", "r2"]
    assert watch._runs(None, None) == ("r3", "r2")


def test_signals(signals):
    per_node = {}
    for s in signals:
        per_node[s["model_name"]] = per_node.get(s["model_name"], 0) + 1
    assert per_node == {"orders": 4, "stg_orders": 4, "fct_orders": 8, "agg_daily_orders": 6}
    mine = {(s["metric"], s["partitions"]): s for s in signals if s["model_name"] == "orders"}
    distinct = mine["distinct_count", 0]
    assert (distinct["baseline_value"], distinct["current_value"], distinct["severity"]) == (137, 274, "critical")
    whole = mine["mean_value", 0]
    assert whole["change"] == pytest.approx(0.2000, abs=5e-5) and whole["severity"] == "high"
    daily = mine["mean_value", 30]
    assert daily["change"] == pytest.approx(0.6) and daily["first_partition"] == "2024-03-01"
    bound = mine["max_value", 0]
    assert (bound["baseline_text"], bound["current_text"], bound["severity"]) == ("60.320000", "96.512000", "warning")


def test_detection_is_stored_once(watch, signals):
    watch.detect("r3", "r2")
    assert watch.signals("r3").count() == 22


def test_gate(watch, signals):
    with pytest.raises(AssertionError, match=r"\d+ signal\(s\) at or above critical"):
        watch.gate("r3")
    watch.gate("r3", "none")


def test_incident(watch, signals):
    (found,) = watch.analyse("r3").collect()
    assert (found.root, found.is_source, found.severity, found.columns) == ("orders", True, "critical", ["amount"])
    assert found.blast_radius == ["agg_daily_orders", "fct_orders", "stg_orders"]
    assert found.downstream_columns["fct_orders"] == ["amount_usd", "fee_usd"]
    stored = watch.store.read("incidents").collect()
    assert [(r.root, r.columns, r.blast_radius, r.signal_count) for r in stored] == [
        ("orders", "amount", "agg_daily_orders, fct_orders, stg_orders", 4)
    ]


def test_feeds_of_the_latest_run(watch, signals):
    watch.analyse("r3")
    (root,) = watch.feed().collect()
    assert (root.run_id, root.root, root.signal_count) == ("r3", "orders", 4)
    at_root = watch.incident("orders").collect()
    assert len(at_root) == 4 and at_root[0].severity == "critical"
    assert watch.overview().first().incidents == 1


def test_a_quiet_run_loses_its_old_signals(watch, signals):
    """Replacing a run by nothing must not leave what was there before."""
    watch.detect("r3", "r3")
    assert watch.signals("r3").count() == 0
    watch.detect("r3", "r2")
    assert watch.signals("r3").count() == 22


def test_prompt_and_answers(watch, signals):
    (p,) = watch.prompts("r3").collect()
    assert "The change began at orders, a source, in: " in p.prompt
    assert "  amount.distinct_count: 137.0000 -> 274.0000  (100.0% change, severity critical, ratio x2.0000)" in p.prompt
    assert "  amount.max_value: '60.320000' -> '96.512000'" in p.prompt
    assert "  agg_daily_orders <- fct_orders" in p.prompt and "  orders <- (source)" in p.prompt
    (a,) = watch.explain("r3").collect()
    assert "stand-in" in json.loads(a.explanation)["summary"] and len(a.prompt_key) == 32
    cache = watch.spark.createDataFrame([(a.prompt_key, p.prompt, '{"summary": "kept"}')], "prompt_key string, prompt string, response string")

    def never(prompt):
        raise RuntimeError("must not be asked")

    (again,) = watch.explain("r3", call=never).collect()  # the first answer was kept in the store
    assert again.explanation == a.explanation
    (again,) = watch.explain("r3", cache, never).collect()
    assert again.prompt_key == a.prompt_key


def test_alert(watch, signals):
    (m,) = watch.alert("r3", report_url="http://reports.test/r3").collect()
    assert m.text == "Drift in tidewatch, worst critical: 22 signals from 1 origins"
    head, began, strongest, foot = json.loads(m.blocks)
    assert head["accessory"]["url"] == "http://reports.test/r3" and head["text"]["text"] == m.text
    assert began["text"]["text"].startswith("*Began at*\n") and "more" not in began["text"]["text"]
    lines = strongest["text"]["text"].split("\n")
    assert len(lines) == 8 and lines[1].startswith("[critical] ") and lines[-1] == "... and 16 more"
    assert foot["type"] == "context"
    assert watch.alert("r2").count() == 0


def test_report_parts_and_feeds(watch, signals):
    parts = watch.save_report("r3", "r2", watch.explain("r3"))
    count = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    assert (count["node"], count["signal"], count["incident"], count["explanation"]) == (4, 22, 1, 1)
    over = {r.metric: r.current for r in parts.where("part = 'overview'").collect()}
    assert over == {"nodes": 4, "rows_profiled": 270090, "signals": 22, "incidents": 1}
    assert watch.save_report("r3", "r2").where("part = 'signal'").count() == 22  # written again, not twice
    feed = watch.runs(2).collect()
    assert [r.run_id for r in feed][0] == watch.latest_runs(1)[0] and len(feed) == 2
    point = watch.store.read("report_parts", ["r3"]).where("part = 'point'").first()
    one = watch.one_series("r3", "r2", point.model_name, point.column_name, point.metric)
    assert one.where(f"cast(partition_value as string) = '{point.day}'").first().current == point.current
    with pytest.raises(ValueError):
        watch.one_series("r3", "r2", "orders", "amount", "median")


def test_report(watch, signals):
    doc = json.loads(watch.report("r3", "r2", watch.explain("r3")).first().payload)
    assert doc["overview"] == {"nodes": 4, "rows_profiled": 270090, "signals": 22, "incidents": 1}
    assert [n["status"] for n in doc["lineage"]["nodes"]].count("affected") == 3
    (incident,) = doc["incidents"]
    assert [c["column"] for c in incident["charts"]] == ["amount", "avg_amount_usd", "total_fee_usd"]
    assert [p["day"] for p in incident["charts"][0]["points"]] == sorted(p["day"] for p in incident["charts"][0]["points"])
    assert len(incident["charts"][0]["points"]) == 90
    assert json.loads(incident["explanation"])["who_is_affected"] == "unknown"


def test_history(watch, signals):
    rows = watch.history("orders", "amount").collect()
    assert [r.run_id for r in rows] == ["r1", "r2", "r3"]
    assert [r.distinct_count for r in rows] == [137, 137, 274]


def test_volume(watch, signals):
    assert watch.volume_mismatch("r3", "r2").count() == 0


def test_selection(watch):
    w = Observatory(watch.spark, watch.tables, watch.nodes, watch.store.root, Settings(exclude=("agg_*",), include=("*orders",)))
    assert sorted(w.selected()) == ["fct_orders", "orders", "stg_orders"]
    assert list(w.selected("agg_daily_orders")) == ["agg_daily_orders"]
    with pytest.raises(ValueError):
        w.selected("gone")


def test_rolling_mode_needs_no_baseline(watch, signals):
    w = Observatory(watch.spark, watch.tables, watch.nodes, watch.store.root, Settings(baseline_mode="rolling"))
    found = {(s.model_name, s.column_name, s.metric): s for s in w.detect("r3").collect()}
    mean = found["orders", "amount", "mean_value"]
    assert mean.baseline_run_id is None and mean.first_partition == "2024-03-01"
    w.settings = Settings()
    w.detect("r3", "r2")


def test_states_with_missing_days(watch):
    series = watch.series("r3", "r2", "full_outer").where("model_name = 'orders' and column_name = 'amount' and metric = 'mean_value'")
    assert series.where(R.diverges()).count() == 30
