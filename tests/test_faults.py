import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.overlay import Edit, Scope, apply_fault, apply_faults
from tidewatch.functions.runs import RUNS, run_names
from tidewatch.plans import evaluate as V
from tidewatch.plans import scenarios as S
from tidewatch.settings import Settings
from tidewatch.sources.store import MetricStore, conform, history
from tidewatch.sources.tables import read_parquet, sample_rows, write_sample
from tidewatch.schemas import DRIFT_SIGNALS


def test_catalogue_shape():
    all_ = S.catalogue()
    assert [sum(s.layer == layer for s in all_) for layer in ("source", "model", "control")] == [51, 5, 4]
    assert len({s.id for s in all_}) == 60


def test_benchmark_at_the_smallest_size(spark, small):
    scores = V.scores(spark, V.observe(read_parquet(spark, f"{small}/events.parquet", spread=True), S.catalogue()))
    stored = V.materialise(scores, "scores")
    s = V.summary(stored).first()
    assert (s.total, s.detected, s.passed, s.controls, s.false_positives) == (56, 54, 53, 4, 0)
    assert {r.scenario for r in V.misses(stored).collect()} == {f"inflation-small-{w}" for w in ("month", "week", "day")}


def test_batched_faults_equal_single_faults(spark, small):
    events = read_parquet(spark, f"{small}/events.parquet")
    chosen = S.by_id("row-drop-large-week", "null-spike-small-month", "case-change-large-day", "unit-change-small-month")
    names = ["clean", *[s.id for s in chosen]]
    tagged = events.withColumn(RUNS, F.lit(2 ** len(names) - 1).cast("bigint"))
    faults = [(i + 1, s.edit, s.scope.sql("ts", "event_id")) for i, s in enumerate(chosen)]
    batch = apply_faults(tagged, faults).withColumn("run", F.explode(run_names(RUNS, names))).drop(RUNS)
    for s in chosen:
        alone = apply_fault(events, s.edit, s.scope.where("ts", "event_id"))
        ours = batch.where(F.col("run") == s.id).drop("run").select(*events.columns)
        assert ours.exceptAll(alone).count() == 0 and alone.exceptAll(ours).count() == 0
    assert batch.where("run = 'clean'").drop("run").select(*events.columns).exceptAll(events).count() == 0


def test_more_runs_than_one_mask_holds(spark, small, monkeypatch):
    """Batches of runs give what one batch gives."""
    events = read_parquet(spark, f"{small}/events.parquet")
    chosen = S.by_id("row-drop-large-week", "null-spike-small-month", "case-change-large-day")
    keep = ["run_id", "grain", "model_name", "partition_value", "column_name", "row_count", "null_count", "distinct_count", "min_value", "max_value"]
    one = V.profiles(events, chosen, Settings()).select(*keep).collect()
    monkeypatch.setattr(V, "MAX_RUNS", 3)
    assert sorted(map(str, V.profiles(events, chosen, Settings()).select(*keep).collect())) == sorted(map(str, one))


def test_named_faults(spark, small):
    events = read_parquet(spark, f"{small}/events.parquet")
    for key, fault in S.FAULTS.items():
        changed = S.inject(events, key, "2024-01-20").exceptAll(events)
        assert changed.count() > 0 and changed.where("ts < timestamp_ntz'2024-01-20'").count() == 0, fault


def test_capitalise(spark):
    df = spark.createDataFrame([("casual",), ("",), (None,)], "s string")
    assert [r.s for r in apply_fault(df, Edit("capitalise", "s"), F.lit(True)).collect()] == ["Casual", "", None]


def test_sample_does_not_depend_on_splits(spark, small, tmp_path):
    events = read_parquet(spark, f"{small}/events.parquet")
    a = sample_rows(events.repartition(7), "event_id", 50, 3)
    b = sample_rows(events.coalesce(1), "event_id", 50, 3)
    assert sorted(r.event_id for r in a.collect()) == sorted(r.event_id for r in b.collect())
    assert sample_rows(events, "event_id", 50, 4).exceptAll(a).count() > 0
    write_sample(a, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 50


def test_large_sample_equals_small_one(spark, small, monkeypatch):
    from tidewatch.sources import tables

    events = read_parquet(spark, f"{small}/events.parquet").repartition(5)
    for n in (1, 77, 999, 5000):
        want = sorted(r.event_id for r in sample_rows(events, "event_id", n, 3).collect())
        monkeypatch.setattr(tables, "_SLICE_BITS", 25)
        assert sorted(r.event_id for r in sample_rows(events, "event_id", n, 3).collect()) == want
        monkeypatch.undo()


def test_scope_share_is_nested(spark, small):
    events = read_parquet(spark, f"{small}/events.parquet")
    counts = [events.where(Scope(percent=p).where("ts", "event_id")).count() for p in (5, 20, 50, 100)]
    assert counts == sorted(counts) and counts[-1] == events.count() and abs(counts[2] / counts[-1] - 0.5) < 0.1


def test_store_reads_rows_written_before_a_column_existed(spark, tmp_path):
    store = MetricStore(spark, str(tmp_path))
    assert store.read("drift_signals").count() == 0
    old = spark.createDataFrame([("r1", "m", 0.5)], "run_id string, model_name string, change double")
    old.write.partitionBy("run_id").parquet(store.path("drift_signals"))
    new = conform(old.withColumns({"run_id": F.lit("r2"), "partitions": F.lit(3)}), DRIFT_SIGNALS)
    store.replace_runs("drift_signals", new, ["r2"])
    rows = {r.run_id: r for r in store.read("drift_signals").collect()}
    assert rows["r1"].partitions is None and rows["r2"].partitions == 3 and rows["r1"].change == 0.5


def test_retried_append_does_not_duplicate(spark, tmp_path):
    store = MetricStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("r1", "m"), ("r1", "n")], "run_id string, model_name string")
    for _ in range(2):
        store.append("column_profiles", rows)
    store.append("column_profiles", rows.withColumn("run_id", F.lit("r2")))
    assert store.read("column_profiles").count() == 0  # no run is complete
    for run in ("r1", "r2"):
        store.commit(run, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), 1)
    assert store.read("column_profiles").groupBy("run_id").count().orderBy("run_id").collect() == [("r1", 2), ("r2", 2)]


def test_a_run_that_died_shows_nothing(spark, tmp_path, monkeypatch):
    """Neither a first writing nor a second one is seen before its last row."""
    store = MetricStore(spark, str(tmp_path))
    nodes, at = {"n": spark.range(5).withColumn("d", F.lit(dt.date(2024, 1, 1)))}, dt.datetime(2024, 1, 1)
    store.run_profile(nodes, "whole", at)

    def dies(table, rows):
        if table == "column_profiles":
            raise RuntimeError("lost")
        return append(table, rows)

    append = store.append
    for run, seen in (("half", {"whole"}), ("whole", set())):
        monkeypatch.setattr(store, "append", dies)
        with pytest.raises(RuntimeError):
            store.run_profile(nodes, run, at)
        monkeypatch.undo()
        for table in ("partition_profiles", "column_profiles"):
            assert {r.run_id for r in store.read(table).select("run_id").distinct().collect()} == seen
            assert store.read(table, [run]).count() == 0
        assert history(store.read("column_profiles"), "n", "id").count() == len(seen)
    store.run_profile(nodes, "whole", at)
    assert store.read("partition_profiles", ["whole"]).count() == 2
