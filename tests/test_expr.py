import fnmatch
import math

import pytest
from hypothesis import given, settings as hyp
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.functions import expr as X
from tidewatch.functions import text as T
from tidewatch.settings import Settings, glob_regex
import re


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "before, after, change",
    [
        (None, None, 0.0), (None, 0.0, 0.0), (0.0, None, 0.0), (0.0, 0.0, 0.0),
        (None, 3.0, 1.0), (0.0, 3.0, 1.0), (2.0, None, 1.0), (2.0, 0.0, 1.0),
        (2.0, 3.0, 0.5), (-2.0, -3.0, 0.5), (2.0, -2.0, 2.0), (5.0, 5.0, 0.0),
    ],
)
def test_relative_change(spark, before, after, change):
    lit = [F.lit(v).cast("double") for v in (before, after)]
    assert one(spark, X.relative_change(*lit)) == change


def test_rate_change_counts_missing_as_zero(spark):
    assert one(spark, X.rate_change(F.lit(None).cast("double"), F.lit(0.25))) == 0.25


@pytest.mark.parametrize("times, severity", [(1, "warning"), (1.99, "warning"), (2, "high"), (4.99, "high"), (5, "critical"), (90, "critical")])
def test_grade(spark, times, severity):
    assert one(spark, Settings().grade(F.lit(0.1 * times), F.lit(0.1))) == severity


@pytest.mark.parametrize(
    "value, text",
    [(60.32, "60.320000"), (-0.0000004, "0.000000"), (1e12, "1000000000000.000000"), (math.nan, "NaN"), (1e40, "1.0E40"), (None, None)],
)
def test_bound_text_of_doubles(spark, value, text):
    df = spark.createDataFrame([(value,)], "x double")
    got = df.selectExpr(X.text_of("x", df.schema["x"].dataType) + " as v").first().v
    assert got in (text, "-" + (text or "")) if value == -0.0000004 else got == text


def test_masking_is_case_insensitive_and_keeps_null(spark):
    s = Settings(mask_values=("*EMAIL*", "ssn"))
    shown = [
        one(spark, X.shown_bound(F.lit(c), F.lit(v).cast("string"), s))
        for c, v in (("user_Email", "a@b"), ("SSN", "1"), ("ssn", None), ("city", "x"), ("city", "y" * 121), ("city", "y" * 120))
    ]
    assert shown == ["<masked>", "<masked>", None, "x", "y" * 117 + "...", "y" * 120]


@given(st.text("ab_.*?[]!", max_size=8), st.text("ab_.", max_size=6))
@hyp(max_examples=300, deadline=None)
def test_globs_match_like_file_names(glob, name):
    assert bool(re.match(glob_regex(glob).replace("(?s)^", "(?s)^"), name)) == fnmatch.fnmatchcase(name, glob)


def test_later_override_wins_and_exclude_beats_include(spark):
    s = Settings(
        include=("fct_*", "dim"), exclude=("*_tmp",),
        overrides={"*": {"row_count": 0.5, "null_rate": 0.2}, "fct_*": {"row_count": 0.9}, "fct_a": {"null_rate": 0.3}},
    )
    rows = spark.createDataFrame([("fct_a",), ("fct_tmp",), ("dim",), ("other",)], "n string")
    got = {
        r.n: (r.keep, r.rows, r.nulls, r.mean)
        for r in rows.select(
            "n", s.selected(F.col("n")).alias("keep"), s.limit(F.col("n"), F.lit("row_count")).alias("rows"),
            s.limit(F.col("n"), F.lit("null_rate")).alias("nulls"), s.limit(F.col("n"), F.lit("mean_value")).alias("mean"),
        ).collect()
    }
    assert got == {
        "fct_a": (True, 0.9, 0.3, 0.05), "fct_tmp": (False, 0.9, 0.2, 0.05),
        "dim": (True, 0.5, 0.2, 0.05), "other": (False, 0.5, 0.2, 0.05),
    }


@pytest.mark.parametrize("key", [0, 1, 65535, 65536, 2**31, 2**32 + 7, 10**15, 2**62, -5])
def test_mixed_key_never_overflows(spark, key):
    got = spark.createDataFrame([(key,)], "k bigint").select(F.expr(X.mixed("k")).alias("v")).first().v
    assert got == key * 2654435761 % 2**32


@pytest.mark.parametrize(
    "values, median", [([], None), ([3.0], 3.0), ([4.0, 1.0], 2.5), ([5.0, 1.0, 3.0], 3.0), ([4.0, 1.0, 3.0, 2.0], 2.5)]
)
def test_middle(spark, values, median):
    df = spark.createDataFrame([(values,)], "h array<double>")
    assert df.select(X.middle(F.col("h")).alias("v")).first().v == median


def test_robust_z(spark):
    rows = [(10.0, 10.0, 0.0, 0.0), (13.0, 10.0, 0.0, 3.0), (15.0, 10.0, 0.0, 5.0), (12.0, 10.0, 0.6745, 2.0), (1.0, 0.0, 0.0, 1e10)]
    df = spark.createDataFrame(rows, "v double, med double, mad double, want double")
    for r in df.withColumn("z", X.robust_z(F.col("v"), F.col("med"), F.col("mad"))).collect():
        assert r.z == pytest.approx(r.want)


@pytest.mark.parametrize("value, text", [(None, "—"), (1234.0, "1,234"), (999.0, "999"), (1234.5, "1,234.5"), (0.12345, "0.1235"), (100.0, "100")])
def test_compact_numbers(spark, value, text):
    assert one(spark, T.compact(F.lit(value).cast("double"))) == text


def test_settings_from_mapping():
    s = Settings.from_mapping(
        {"project": "p", "profile": {"exclude": ["tmp_*"], "max_partitions": 9, "partition_column": {"a": None}},
         "thresholds": {"default": {"row_count": 0.5}, "overrides": {"x": {"mean_value": 1}}}, "baseline": {"mode": "rolling", "z": 4}}
    )
    assert (s.project, s.exclude, s.max_partitions, s.baseline_mode, s.z, s.window) == ("p", ("tmp_*",), 9, "rolling", 4.0, 28)
    assert s.thresholds["row_count"] == 0.5 and s.thresholds["mean_value"] == 0.05
    assert s.partition_columns == {"a": None}
