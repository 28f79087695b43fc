import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.runs import RUNS
from tidewatch.operators import drift
from tidewatch.operators import profile as P
from tidewatch.plans import events as E
from tidewatch.plans import scenarios as S
from tidewatch.settings import Settings
from tidewatch.sources.tables import read_parquet


def rows(profile, grain, **where):
    out = {}
    for r in profile.where(F.col("grain") == grain).collect():
        if all(getattr(r, k) == v for k, v in where.items()):
            out[r.column_name if grain == "table" else (r.column_name, r.partition_value)] = r
    return out


@pytest.fixture(scope="module")
def odd(spark):
    day = dt.date(2024, 1, 1)
    data = [
        (day, 1.0000001, 0.0, "a", Decimal("1.10"), [1.0], {"k": 1}, True),
        (day, 1.0000002, -0.0, "a" * 60, Decimal("1.10"), [1.0], {"k": 1}, False),
        (day, 1e300, math.nan, "a" * 60 + "b", Decimal("2.00"), [2.0], {"k": 2}, True),
        (None, 1e300, math.nan, None, None, None, None, None),
        (dt.date(2024, 1, 2), None, None, "z", Decimal("3.00"), [], {}, None),
    ]
    return spark.createDataFrame(
        data, "d date, x double, y double, s string, m decimal(9,2), l array<double>, mp map<string,int>, b boolean"
    )


def test_unusual_values(odd):
    got = rows(P.profile(odd, "odd"), "table")
    assert got["x"].distinct_count == 2  # equal to six decimals, then one huge value
    assert got["y"].distinct_count == 2  # both zeros are one value, both NaN are one
    assert got["s"].distinct_count == 4  # long texts that differ in their last letter
    assert (got["m"].distinct_count, got["m"].min_value, got["m"].max_value) == (3, "1.100000", "3.000000")
    assert got["m"].mean_value == pytest.approx(1.8)
    assert got["l"].distinct_count == 3 and got["l"].min_value == "[]"
    assert got["mp"].distinct_count == 3 and got["mp"].min_value is None
    assert (got["b"].min_value, got["b"].max_value, got["b"].null_count) == ("false", "true", 2)
    assert got["s"].mean_value is None and got["d"].null_count == 1
    assert got["x"].row_count == 5 and got["x"].null_rate == pytest.approx(0.2)


def test_rows_without_a_day_count_only_in_the_whole_table(odd):
    daily = rows(P.profile(odd, "odd"), "day")
    assert {d for _, d in daily} == {dt.date(2024, 1, 1), dt.date(2024, 1, 2)}
    assert daily["x", dt.date(2024, 1, 1)].row_count == 3
    assert daily["x", dt.date(2024, 1, 2)].distinct_count == 0


def test_empty_table_has_zero_rates(spark):
    got = P.profile(spark.createDataFrame([], "a int, d date"), "none").collect()
    assert all(r.row_count == 0 and r.null_rate == 0.0 for r in got)


def test_axis_rules(spark):
    df = spark.createDataFrame([], "t timestamp, n timestamp_ntz, d date, i int")
    assert P.partition_axis(df, "x", Settings()) == "d"
    assert P.partition_axis(df.drop("d"), "x", Settings()) == "t"
    assert P.partition_axis(df.select("i"), "x", Settings()) is None
    assert P.partition_axis(df, "x", Settings(partition_columns={"x": None})) is None
    assert P.partition_axis(df, "x", Settings(partition_columns={"x": "n"})) == "n"
    with pytest.raises(ValueError):
        P.partition_axis(df, "x", Settings(partition_columns={"x": "gone"}))


def test_guard_drops_the_daily_grain_only(spark):
    df = spark.range(10).select(F.expr("date_add(date'2024-01-01', cast(id as int))").alias("d"), "id")
    p = P.profile(df, "n", Settings(max_partitions=9))
    s = Settings(max_partitions=9)
    assert P.partition_profiles(p, s).count() == 0
    assert P.column_profiles(p).count() == 2
    assert P.partition_profiles(p, Settings(max_partitions=10)).count() == 20


def test_coarser_grains_equal_direct_profiles(spark):
    """A month merged from days equals a profile by month; the finest grain within the limit is taken."""
    df = spark.range(4000).select(
        F.expr("if(id % 50 = 0, null, date_add(date'2023-11-05', cast(id * 7 % 900 as int)))").alias("d"),
        (F.col("id") % 37).alias("v"), F.when(F.col("id") % 5 != 0, F.col("id") / 3).alias("x"),
    )
    wide = Settings(max_partitions=1, coarser=("month", "year"), partition_columns={"n": "d"})
    p = P.profile(df, "n", wide)
    for grain, part in (("month", "MM"), ("year", "YY")):
        direct = P.profile(df.withColumn("d", F.trunc("d", part)), "n", Settings(partition_columns={"n": "d"}))
        want = {(r.column_name, r.partition_value): r for r in direct.where("grain = 'day' and column_name <> 'd'").collect()}
        got = {(r.column_name, r.partition_value): r for r in p.where(f"grain = '{grain}' and column_name <> 'd'").collect()}
        assert got.keys() == want.keys()
        for key, r in got.items():
            w = want[key]
            assert (r.row_count, r.null_count, r.distinct_count, r.min_value, r.max_value) == (w.row_count, w.null_count, w.distinct_count, w.min_value, w.max_value)
            assert r.mean_value == (pytest.approx(w.mean_value) if w.mean_value is not None else None)
    for limit in (900, 40, 31, 30, 4, 3, 2):
        s = Settings(max_partitions=limit, coarser=("month", "year"))
        grains = {r.grain for r in P.partition_profiles(p, s).select("grain").distinct().collect()}
        (guard,) = P.partition_guard(p, s).collect()
        assert grains == ({guard.grain} if guard.kept else set())
        sizes = {g: df.select(F.count_distinct(F.trunc("d", t) if t else F.col("d"))).first()[0] for g, t in (("day", None), ("month", "MM"), ("year", "YY"))}
        assert guard.partitions == sizes["day"]
        assert guard.grain == next((g for g, n in sizes.items() if n <= limit), None)
    with pytest.raises(ValueError):
        P.profile(df, "n", Settings(coarser=("week",)))


def test_months_are_not_compared_with_days(spark):
    """A run that fell back to months has no days in common with one by day."""
    df = spark.range(100).select(F.expr("date_add(date'2024-01-01', cast(id % 60 as int))").alias("d"), "id")
    s = Settings(max_partitions=10, coarser=("month",))
    month = P.partition_profiles(P.profile(df, "n", s, ["coarse"]), s)
    day = P.partition_profiles(P.profile(df, "n", runs=["fine"]))
    pairs = drift.run_pairs(spark, [("fine", "coarse"), ("coarse", "coarse")])
    both = drift.daily_checks(month.unionByName(day), pairs)
    assert both.where("baseline_run_id = 'fine'").count() == 0 < both.where("baseline_run_id = 'coarse'").count()


def test_sketches_of_spans(spark):
    """Sketches stand beside exact counts, are near them, and unite over any span."""
    df = spark.range(60_000).select(
        F.expr("date_add(date'2024-01-01', cast(id % 40 as int))").alias("d"), (F.col("id") * 7919 % 20_011).alias("v"),
        F.concat(F.lit("t"), (F.col("id") % 9).cast("string")).alias("t"), F.lit(None).cast("double").alias("none"),
    )
    assert P.profile(df, "n").where("distinct_sketch is not null").count() == 0
    p = P.profile(df, "n", Settings(sketches=True))
    near = p.select("distinct_count", F.hll_sketch_estimate("distinct_sketch").alias("guess")).collect()
    assert all(abs(r.guess - r.distinct_count) <= 0.05 * r.distinct_count for r in near)
    spans = spark.sql("select 'a' as span, date'2024-01-03' as first_day, date'2024-01-20' as last_day union all select 'b', date'2024-01-01', date'2024-01-02'")
    got = {(r.span, r.column_name): r.distinct_estimate for r in P.distinct_over(P.partition_profiles(p), spans).collect()}
    for span, low, high in (("a", 3, 20), ("b", 1, 2)):
        rows = df.where(F.dayofyear("d").between(low, high))
        for c in ("v", "t", "none"):
            exact = rows.select(F.count_distinct(c)).first()[0]
            assert abs(got[span, c] - exact) <= 0.05 * exact


def test_skewed_value_and_day_match_brute_force(spark):
    """A third of the rows share one value and one day."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("v"),
        F.expr("date_add(date'2024-01-01', cast(if(id % 3 = 0, 0, id % 11) as int))").alias("d"),
    ).repartition(6)
    local = [(r.v, r.d) for r in df.collect()]
    p = P.profile(df, "n")
    assert rows(p, "table")["v"].distinct_count == len({v for v, _ in local})
    for (column, day), r in rows(p, "day").items():
        if column == "v":
            mine = [v for v, d in local if d == day]
            assert (r.row_count, r.distinct_count, r.mean_value) == (len(mine), len(set(mine)), pytest.approx(sum(mine) / len(mine)))


def test_batched_runs_equal_separate_runs(spark, small):
    """Rows shared between runs give the same profiles as one copy of the tables per run."""
    events = read_parquet(spark, f"{small}/events.parquet")
    chosen = S.by_id("row-drop-large-week", "null-spike-medium-month", "mart-scaling-small-month", "control-subthreshold-tip")
    keep = ["grain", "model_name", "partition_value", "column_name", "row_count", "null_count", "distinct_count", "min_value", "max_value",
            F.round(F.col("mean_value") * 1.000000000001, 6).alias("mean_value")]  # off rounding ties
    batch = P.profile_nodes(E.build(events, chosen), None, E.run_ids(chosen))
    for s in chosen:
        alone = P.profile_nodes(E.build(events, [s]), None, E.run_ids([s])).where(F.col("run_id") == s.id)
        ours = batch.where(F.col("run_id") == s.id)
        assert sorted(map(str, ours.select(*keep).collect())) == sorted(map(str, alone.select(*keep).collect()))


def test_untouched_rows_are_not_copied(spark, small):
    events = read_parquet(spark, f"{small}/events.parquet")
    raw = E.build(events, S.by_id("unit-change-large-day"))["events"]
    touched = events.where("ts >= '2024-01-20' and ts < '2024-01-21'").count()
    assert raw.count() == events.count() + touched
    assert raw.where(f"{RUNS} = 3").count() == events.count() - touched
