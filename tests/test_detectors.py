import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import drift as D
from tidewatch.operators import rolling as W
from tidewatch.settings import Settings

START = dt.date(2024, 1, 1)
COLUMNS = (
    "run_id string, model_name string, column_name string, partition_value date, row_count bigint, null_rate double, "
    "distinct_count bigint, mean_value double"
)


def series(spark, values, rows=None, name="s"):
    data = [
        ("r", name, "c", START + dt.timedelta(days=i), (rows or [300] * len(values))[i], 0.0, 5, v) for i, v in enumerate(values)
    ]
    return spark.createDataFrame(data, COLUMNS)


def found(spark, values, rows=None, **settings):
    return {(s.column_name, s.metric): s for s in W.rolling(series(spark, values, rows), Settings(**settings)).collect()}


def test_flat_series_is_silent(spark):
    assert found(spark, [10.0] * 20) == {}


def test_small_step_after_flat_history_is_not_unusual(spark):
    assert found(spark, [10.0] * 20 + [13.0]) == {}


def test_one_unusual_day_is_a_warning(spark):
    s = found(spark, [10.0] * 20 + [15.0])["c", "mean_value"]
    assert (s.severity, s.partitions, s.baseline_value, s.current_value, s.first_partition) == ("warning", 1, 10.0, 15.0, "2024-01-21")


def test_two_days_are_graded(spark):
    assert found(spark, [10.0] * 20 + [15.0, 15.0])["c", "mean_value"].severity == "warning"
    assert found(spark, [10.0] * 20 + [18.0, 18.0])["c", "mean_value"].severity == "high"
    assert found(spark, [10.0] * 20 + [40.0, 40.0])["c", "mean_value"].severity == "critical"


def test_short_series_are_skipped(spark):
    assert found(spark, [10.0] * 13 + [99.0]) == {}
    assert found(spark, [10.0] * 14 + [99.0]) != {}


def test_missing_values_do_not_count_as_history(spark):
    assert found(spark, [None] * 10 + [10.0] * 13 + [99.0]) == {}
    assert found(spark, [None] * 10 + [10.0] * 14 + [99.0]) != {}


def test_sparse_day_leaves_column_series_only(spark):
    values = [10.0 + i % 3 for i in range(30)]
    values[20] = 900.0
    rows = [300 + i % 5 for i in range(30)]
    rows[20] = 2
    got = found(spark, values, rows)
    assert ("c", "mean_value") not in got
    assert got["(table)", "row_count"].current_value == 2.0


def test_unusual_but_tiny_moves_are_ignored(spark):
    values = [100.0 + 0.001 * (i % 2) for i in range(20)] + [101.3, 101.3]
    assert found(spark, values) == {}


def test_worst_day_is_the_earliest_of_ties(spark):
    s = found(spark, [10.0] * 20 + [15.0, 10.0, 15.0])["c", "mean_value"]
    assert s.partitions == 2 and s.first_partition == "2024-01-21"


def test_scores_match_brute_force(spark):
    rng = random.Random(7)
    values = [None if rng.random() < 0.1 else round(rng.uniform(0, 9), 2) for _ in range(80)]
    points = W.column_series(series(spark, values), Settings()).where("metric = 'mean_value'")
    rows = W.scored(points, Settings(window=9)).orderBy("partition_value").collect()
    for i, r in enumerate(rows):
        history = [v for v in values[max(0, i - 9) : i] if v is not None]
        if not history:
            assert r.median is None
            continue
        med = statistics.median(history)
        assert r.median == pytest.approx(med)
        assert r.mad == pytest.approx(statistics.median(abs(v - med) for v in history))


# ---------------------------------------------------------------- previous run


def columns(spark, run, **cells):
    base = {"row_count": 100, "null_rate": 0.0, "distinct_count": 10, "mean_value": 5.0, "min_value": "a", "max_value": "z"}
    row = {**base, **cells}
    schema = (
        "run_id string, model_name string, column_name string, row_count bigint, null_rate double, distinct_count bigint, "
        "mean_value double, min_value string, max_value string"
    )
    return spark.createDataFrame([(run, "m", "c", *row.values())], schema)


def whole(spark, settings=None, **cells):
    both = columns(spark, "a").unionByName(columns(spark, "b", **cells))
    pairs = D.run_pairs(spark, [("a", "b")])
    got = D.whole_table_signals(both, pairs, settings).unionByName(D.bound_signals(both, pairs, settings))
    return {s.metric: s for s in got.collect()}


def test_limits_are_inclusive(spark):
    assert whole(spark, mean_value=5.25)["mean_value"].severity == "warning"
    assert whole(spark, mean_value=5.2499) == {}
    assert whole(spark, null_rate=0.01)["null_rate"].change == pytest.approx(0.01)
    assert whole(spark, row_count=110)["row_count"].severity == "critical"


def test_vanished_mean_and_bounds(spark):
    got = whole(spark, mean_value=None, min_value=None)
    assert got["mean_value"].change == 1.0 and got["min_value"].current_text is None
    assert got["min_value"].severity == "warning" and got["min_value"].baseline_value is None


def test_columns_in_one_run_only_say_nothing(spark):
    both = columns(spark, "a").unionByName(columns(spark, "b").withColumn("column_name", F.lit("renamed")))
    assert D.whole_table_signals(both, D.run_pairs(spark, [("a", "b")])).count() == 0


def test_zero_limit_reports_unmoved_days_without_values(spark):
    days = series(spark, [1.0, 1.0]).unionByName(series(spark, [1.0, 1.0]).withColumn("run_id", F.lit("q")))
    s = Settings(thresholds={"row_count": 9.0, "null_rate": 9.0, "distinct_count": 9.0, "mean_value": 0.0})
    (got,) = D.per_day_signals(days, D.run_pairs(spark, [("q", "r")]), s).collect()
    assert (got.partitions, got.baseline_value, got.change, got.severity) == (2, None, 0.0, "critical")


def test_volume_mismatch(spark):
    both = columns(spark, "a", row_count=100).unionByName(columns(spark, "b", row_count=151)).unionByName(columns(spark, "e", row_count=0))
    pairs = D.run_pairs(spark, [("a", "b"), ("b", "a"), ("a", "e")])
    got = {(r.baseline_run_id, r.run_id) for r in D.volume_mismatch(both, pairs).collect()}
    assert got == {("a", "b"), ("b", "a")}


def profiled(spark, rows):
    """rows: (run, node, column, day or None)."""
    data = [(r, n, c, START + dt.timedelta(days=d) if d is not None else None, 10, 0.0, 5, 1.0) for r, n, c, d in rows]
    df = spark.createDataFrame(data, COLUMNS).withColumns({"min_value": F.lit("a"), "max_value": F.lit("b")})
    return df.where("partition_value is null").drop("partition_value"), df.where("partition_value is not null")


def test_what_is_gone_is_a_signal_if_asked_for(spark):
    rows = [("a", "t", c, None) for c in "xyz"] + [("b", "t", c, None) for c in "xw"] + [("a", "u", c, None) for c in "xy"]
    rows += [("b", "new", "x", None)]
    rows += [("a", "t", "x", d) for d in range(10)] + [("b", "t", "x", d) for d in (0, 1, 4, 5, 6, 7, 8, 9, 10, 11)]
    columns, days = profiled(spark, rows)
    pairs = D.run_pairs(spark, [("a", "b")])
    got = {(s.model_name, s.column_name, s.metric): s for s in D.missing_signals(columns, days, pairs).collect()}
    assert {k: s.severity for k, s in got.items()} == {
        ("t", "y", "vanished_column"): "high", ("t", "z", "vanished_column"): "high",
        ("u", "(table)", "vanished_table"): "critical", ("t", "(table)", "vanished_days"): "critical",
    }
    s = got["t", "(table)", "vanished_days"]
    assert (s.partitions, s.first_partition, s.baseline_value, s.current_value, s.change) == (2, "2024-01-03", 10.0, 8.0, 0.2)
    assert got["u", "(table)", "vanished_table"].baseline_value == 10.0
    plain = D.previous_run(columns, days, pairs).collect()
    assert not [r for r in plain if r.metric.startswith("vanished")]
    assert len(D.previous_run(columns, days, pairs, Settings(report_missing=True)).collect()) == len(plain) + 4


def test_a_coarser_grain_or_a_run_without_profiles_has_lost_nothing(spark):
    rows = [(r, "t", "x", None) for r in "ab"] + [("a", "t", "x", d) for d in range(5)]
    columns, days = profiled(spark, rows)
    _, months = profiled(spark, [("b", "t", "x", 0)])
    both = days.withColumn("grain", F.lit("day")).unionByName(months.withColumn("grain", F.lit("month")))
    assert D.missing_signals(columns, both, D.run_pairs(spark, [("a", "b")])).collect() == []
    assert D.missing_signals(columns, both, D.run_pairs(spark, [("a", "never")])).collect() == []
    assert D.missing_signals(columns.where("false"), both.where("false"), D.run_pairs(spark, [("a", "b")])).collect() == []
