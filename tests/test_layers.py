from pyspark.sql import functions as F

from tidewatch.functions.layers import derived
from tidewatch.functions.runs import RUNS, run_names
from tidewatch.operators import profile as P
from tidewatch.operators.overlay import DROP, Edit, add_faults, apply_fault
from tidewatch.plans import events as E
from tidewatch.plans import scenarios as S
from tidewatch.sources.tables import read_parquet

IDS = ("unit-change-small-week", "null-spike-small-month", "enum-drift-large-day", "row-drop-medium-month", "mart-null-large-month")


def test_columns_that_an_edit_leaves_alone_are_counted_once(spark, small):
    """The distinct values of a fact are made of one cell per column and event, and of those that edits change."""
    events = read_parquet(spark, f"{small}/events.parquet")
    fct = E.layers(events, S.by_id("unit-change-small-week", "unit-change-large-week"))["fct_events"]
    assert [sorted(x.differs) for x in fct.layers] == [["flag_low_purchase", "flag_negative_value", "is_clean", "value_usd"]]
    assert fct.base.count() == events.count()
    flat = fct.flat(["event_key", "event_date"])
    assert flat.count() == events.count() and flat.where(f"{RUNS} = 7").count() == events.count()


def test_layers_hold_what_each_run_holds(spark, small):
    events = read_parquet(spark, f"{small}/events.parquet").limit(400).cache()
    chosen = S.by_id(*IDS)
    for store in (False, True):
        nodes = E.layers(events, chosen, store)
        for node in ("events", "fct_events"):
            batch = nodes[node].flat().withColumn("run", F.explode(run_names(RUNS, E.run_ids(chosen)))).drop(RUNS)
            for s in chosen:
                raw = apply_fault(events, s.edit, s.scope.where("ts", "event_id")) if s.node == "events" else events
                alone = raw if node == "events" else E.fact(E.staging(raw))
                if s.node == node == "fct_events":
                    alone = apply_fault(alone, s.edit, s.scope.where("event_at", "event_id"))
                ours = batch.where(F.col("run") == s.id).select(*alone.columns)
                assert ours.exceptAll(alone).count() == 0 and alone.exceptAll(ours).count() == 0, (node, s.id)


def test_an_edited_axis_moves_whole_rows(spark):
    """A copy on another day is a row of that day in every column; a row that no run holds counts nowhere."""
    df = spark.range(30).select("id", F.expr("date_add(date'2024-01-01', cast(id % 3 as int))").alias("d"))
    faults = [(1, Edit("null", "d"), "id % 5 = 0"), (2, Edit(DROP), "id % 2 = 0"), (0, Edit(DROP), "id < 6"), (3, Edit(DROP), "id < 6")]
    runs = ["dropped", "undated", "even", "first"]
    got = P.profile(add_faults(df.withColumn(RUNS, F.lit(0b1111).cast("bigint")), faults), "n", runs=runs)
    keep = ["grain", "partition_value", "column_name", "row_count", "null_count", "distinct_count", "min_value", "max_value", "mean_value"]
    for index, edit, where in faults:
        alone = P.profile(apply_fault(df, edit, F.expr(where)), "n").select(*keep)
        ours = got.where(F.col("run_id") == runs[index]).select(*keep)
        assert sorted(map(str, ours.collect())) == sorted(map(str, alone.collect())), runs[index]


def test_what_a_plan_hides_counts_as_changed(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    out = df.select("a", (F.col("b") + 1).alias("x"), "c").where("c > 0").withColumn("y", F.col("x") * F.col("c"))
    assert derived(out, df, {"b"}) == {"x", "y"} and derived(out, df, {"a"}) == {"a"}
    assert derived(out, df, {"c"}) == set(out.columns)  # rows are chosen by it
    assert derived(df.distinct(), df, {"a"}) == set(df.columns)
