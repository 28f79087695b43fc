"""NaN, infinite and null values, ties of rounding, and answers that are asked for once."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import expr as X
from tidewatch.operators import drift as D
from tidewatch.operators import explain as E
from tidewatch.operators import overlay as V
from tidewatch.operators import profile as P
from tidewatch.operators import rolling as W
from tidewatch.queries.base import rounded
from tidewatch.settings import Settings
from tidewatch.sources.store import MetricStore


@pytest.fixture(scope="module")
def odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, f"2024-01-{i % 20 + 1:02d}", [1.5, nan, inf, None, -inf, 2.0][i % 6]) for i in range(120)] + [(200, None, 3.0)]
    return spark.createDataFrame(rows, "id long, day string, x double").withColumn("day", F.to_date("day"))


def test_identical_odd_data_has_no_drift(spark, odd):
    profiles = P.profile(odd, "n", runs=["a"]).unionByName(P.profile(odd, "n", runs=["b"])).cache()
    pairs = D.run_pairs(spark, [("a", "b")])
    assert D.previous_run(P.column_profiles(profiles), P.partition_profiles(profiles), pairs).collect() == []
    flagged = W.rolling(P.partition_profiles(profiles), Settings(min_history=3)).where("column_name = 'x' and metric = 'mean_value'")
    assert all(not F_is_nan(r.change) for r in flagged.collect())


def F_is_nan(x):
    return x != x


@pytest.mark.parametrize("before, after, change", [
    (float("nan"), float("nan"), 0.0), (float("inf"), float("inf"), 0.0), (1.0, float("nan"), 1.0), (float("nan"), 1.0, 1.0),
    (float("inf"), 1.0, 1.0), (2.0, 3.0, 0.5), (None, None, 0.0), (0.0, None, 0.0), (None, 1.0, 1.0),
])
def test_change_of_odd_values(spark, before, after, change):
    got = spark.range(1).select(X.relative_change(F.lit(before).cast("double"), F.lit(after).cast("double"))).first()[0]
    assert got == change


@pytest.mark.parametrize("value, digits, want", [
    (12345678.5, 6, 12345678.5), (1e12, 6, 1e12), (0.0078125, 6, 0.007813), (1e300, 6, 1e300), (float("inf"), 4, float("inf")), (2.5e-7, 6, 0.0),
])
def test_rounding_alters_nothing(spark, value, digits, want):
    assert spark.range(1).select(rounded(F.lit(value), digits)).first()[0] == want


def test_sums_lose_nothing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1e21), ("b", 0.1), ("b", 0.2), ("c", float("inf")), ("d", None)], "k string, v double")
    sums = X.exact_sums(total=F.col("v"))
    got = X.exact_totals(df.groupBy("k").agg(*[c.alias(n) for n, c in sums.items()]), "total")
    assert {r.k: r.total for r in got.collect()} == {"a": 1e21 + 1, "b": 0.3, "c": float("inf"), "d": None}


def test_dropping_rows_spares_unknown_times(spark):
    df = spark.sql("select * from values (1, timestamp_ntz'2024-01-25'), (2, null) as t(id, ts)")
    where = V.Scope("2024-01-20").where("ts", "id")
    assert [r.id for r in V.apply_fault(df, V.Edit(V.DROP), where).collect()] == [2]


def test_one_edit_per_run(spark):
    df = spark.sql("select 1 as id, 1 as v")
    with pytest.raises(ValueError):
        V.apply_faults(df, [(1, V.Edit("null", "v"), "true"), (1, V.Edit("null", "id"), "true")])


def test_each_prompt_is_asked_once(spark, tmp_path):
    log = tmp_path / "calls"

    def call(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        return '{"summary": "' + prompt + '"}'

    store = MetricStore(spark, str(tmp_path / "store"))
    wanted = spark.createDataFrame([("r1", "a", "p1"), ("r1", "b", "p2"), ("r2", "a", "p1")], "run_id string, root string, prompt string")
    for _ in range(2):
        answers, fresh = E.resolve(wanted, store.read("answers"), call)
        store.add_answers(fresh)
        assert {(r.prompt, r.response) for r in answers.collect()} == {(p, '{"summary": "' + p + '"}') for p in ("p1", "p2")}
    assert sorted(log.read_text().split()) == ["p1", "p2"]
    assert store.read("answers").count() == 2


def test_skipped_nodes_are_recorded(spark, odd, tmp_path):
    store = MetricStore(spark, str(tmp_path / "store"))
    at = datetime(2024, 2, 1)
    store.run_profile({"n": odd}, "tight", at, Settings(max_partitions=5))
    store.run_profile({"n": odd}, "free", at)
    skipped = store.read("skipped_nodes").collect()
    assert [(r.run_id, r.model_name, r.partitions, r.partition_limit) for r in skipped] == [("tight", "n", 20, 5)]
    assert store.read("partition_profiles", ["tight"]).count() == 0 < store.read("partition_profiles", ["free"]).count()
    assert store.read("column_profiles", ["tight"]).count() == 3
