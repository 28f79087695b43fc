"""Drift between runs: previous-run comparison, whole table and per day."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..settings import METRICS, Settings
from .ranking import positions

SIGNAL_COLUMNS = [
    "run_id", "baseline_run_id", "model_name", "column_name", "metric",
    "baseline_value", "current_value", "change", "severity", "partitions",
    "baseline_text", "current_text", "first_partition",
]


def run_pairs(spark: SparkSession, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """Which run is compared with which: (baseline, current) pairs.

    A literal table, whose size Catalyst knows, so that joins with it need no shuffle.
    """
    rows = ", ".join(f"({X.literal(b)}, {X.literal(c)})" for b, c in pairs)
    return spark.sql(f"select * from values {rows} as t(baseline_run_id, run_id)")


def paired(profiles: DataFrame, pairs: DataFrame, keys: list[str], values: list[str], how: str = "inner") -> DataFrame:
    """Each current profile row next to the baseline row with the same keys.

    Inner by default: a column or a day that exists in one run only says nothing
    about drift.  Both sides are joined to the run pairs first, so only the runs
    asked for are read from the history.
    """
    on = ["baseline_run_id", "run_id", *keys]

    def side(run: str, prefix: str) -> DataFrame:
        renamed = profiles.withColumnRenamed("run_id", run) if run != "run_id" else profiles
        return renamed.join(pairs, run).select(*on, *[F.col(v).alias(prefix + v) for v in values])

    return side("baseline_run_id", "b_").join(side("run_id", "c_"), on, how)


def checks(pair: DataFrame, keep: list[str]) -> DataFrame:
    """One row per metric; a mean is compared only where one side has one."""
    def entry(metric: str) -> Column:
        b, c = F.col("b_" + metric).cast("double"), F.col("c_" + metric).cast("double")
        change = X.rate_change(b, c) if metric == "null_rate" else X.relative_change(b, c)
        return F.struct(
            F.lit(metric).alias("metric"), b.alias("baseline_value"),
            c.alias("current_value"), change.alias("change"),
        )

    rows = pair.select(*keep, F.inline(F.array(*[entry(m) for m in METRICS])))
    has_mean = F.col("baseline_value").isNotNull() | F.col("current_value").isNotNull()
    return rows.where((F.col("metric") != "mean_value") | has_mean)


_KEYS = ["model_name", "column_name"]
_RUN_KEYS = ["baseline_run_id", "run_id"]


def _signals(df: DataFrame, **columns: Column) -> DataFrame:
    defaults = {
        "baseline_value": F.lit(None).cast("double"), "current_value": F.lit(None).cast("double"),
        "partitions": F.lit(0), "baseline_text": F.lit(None).cast("string"),
        "current_text": F.lit(None).cast("string"), "first_partition": F.lit(None).cast("string"),
    }
    have = set(df.columns)
    return df.select(
        *[
            (columns.get(c, F.col(c) if c in have else defaults.get(c))).alias(c)
            for c in SIGNAL_COLUMNS
        ]
    )


def _limit(settings: Settings) -> Column:
    return settings.limit(F.col("model_name"), F.col("metric"))


def whole_table_signals(profiles: DataFrame, pairs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Metrics of a column that moved at least as far as their limit."""
    settings = settings or Settings()
    pair = paired(profiles, pairs, _KEYS, list(METRICS))
    over = checks(pair, _RUN_KEYS + _KEYS).where(X.settled(F.col("change")) >= _limit(settings))
    return _signals(over, severity=settings.grade(X.settled(F.col("change")), _limit(settings)))


def bound_signals(profiles: DataFrame, pairs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Any change of a minimum or maximum: always a warning, values as text."""
    settings = settings or Settings()
    pair = paired(profiles, pairs, _KEYS, ["min_value", "max_value"])
    bounds = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col("b_" + m).alias("before"), F.col("c_" + m).alias("after"))
            for m in ("min_value", "max_value")
        ]
    )
    moved = pair.select(*_RUN_KEYS, *_KEYS, F.inline(bounds)).where(
        ~F.col("before").eqNullSafe(F.col("after"))
    )
    name = F.col("column_name")
    return _signals(
        moved,
        change=F.lit(1.0),
        severity=F.lit("warning"),
        baseline_text=X.masked_bound(name, F.col("before"), settings),
        current_text=X.masked_bound(name, F.col("after"), settings),
    )


def daily_checks(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every metric of every day next to the same day of the baseline run.

    A month is compared with the same month only: rows without a grain are days.
    """
    keys = [*_KEYS, "partition_value"]
    return checks(paired(with_grain(profiles), pairs, [*keys, "grain"], list(METRICS)), _RUN_KEYS + keys)


def with_grain(profiles: DataFrame) -> DataFrame:
    """Profiles written before there were coarser grains are of days."""
    known = F.col("grain") if "grain" in profiles.columns else F.lit(None)
    return profiles.withColumn("grain", F.coalesce(known.cast("string"), F.lit("day")))


def per_day_signals(profiles: DataFrame, pairs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Worst day, number of days and first day over the limit, per metric."""
    settings = settings or Settings()
    over = daily_checks(profiles, pairs).where(X.settled(F.col("change")) >= _limit(settings))
    worst_first = F.struct(X.settled(F.col("change")), -F.unix_date("partition_value"))
    found = over.groupBy(*_RUN_KEYS, *_KEYS, "metric").agg(
        F.max_by(F.struct("baseline_value", "current_value", "change"), worst_first).alias("worst"),
        F.count(F.lit(1)).cast("int").alias("partitions"),
        F.min("partition_value").cast("string").alias("first_partition"),
    )
    # With a limit of zero an unmoved day passes, but it has no worst values.
    change = F.col("worst.change")
    return _signals(
        found,
        baseline_value=F.when(change > 0, F.col("worst.baseline_value")),
        current_value=F.when(change > 0, F.col("worst.current_value")),
        change=change,
        severity=settings.grade(X.settled(change), _limit(settings)),
    )


# ---------------------------------------------------------------- what is gone


def presence(profiles: DataFrame, pairs: DataFrame, keys: list[str], *values: Column) -> DataFrame:
    """Which of the two runs of a pair holds each key: `before` and `after`, one row per key.

    Both sides are grouped together, so nothing is joined key by key.  The values are those of
    the baseline run.
    """
    def side(run: str, before: bool) -> DataFrame:
        renamed = profiles.withColumnRenamed("run_id", run) if run != "run_id" else profiles
        flags = F.lit(before).alias("before"), F.lit(not before).alias("after")
        return renamed.join(pairs, run).select(*_RUN_KEYS, *keys, *values, *flags)

    both = side("baseline_run_id", True).unionByName(side("run_id", False))
    names = [c for c in both.columns if c not in {*_RUN_KEYS, *keys, "before", "after"}]
    return both.groupBy(*_RUN_KEYS, *keys).agg(
        F.max("before").alias("before"), F.max("after").alias("after"),
        *[F.max(F.when(F.col("before"), F.col(c))).alias(c) for c in names],
    )


def missing_signals(columns: DataFrame, partitions: DataFrame, pairs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Tables, columns and days of the baseline run that the current run no longer has.

    A table that is gone is one critical signal, not one per column; a column of a table that is
    still there is a high one.  Days are a property of the table: one signal with their number, the
    first of them, and the share of the baseline's days that is gone as change, graded like rows.
    Only a grain that both runs hold of a table is compared, so a table that went from days to
    months, or is profiled without days now, has lost none.  A run without any profile tells
    nothing.  New tables, columns and days are growth and no signal.
    """
    settings = settings or Settings()
    seen = columns.select("run_id").distinct()
    pairs = pairs.join(seen, "run_id", "left_semi")
    nodes = presence(columns, pairs, ["model_name"], F.col("row_count").alias("baseline_value"))
    node_keys = [*_RUN_KEYS, "model_name"]
    tables = nodes.where("before and not after").withColumns(
        {"column_name": F.lit("(table)"), "metric": F.lit("vanished_table"), "severity": F.lit("critical")}
    )
    lost = presence(columns, pairs, _KEYS, F.col("row_count").alias("baseline_value")).where("before and not after")
    fields = lost.join(nodes.where("before and after").select(*node_keys), node_keys, "left_semi").withColumns(
        {"metric": F.lit("vanished_column"), "severity": F.lit("high")}
    )
    days = presence(with_grain(partitions), pairs, ["model_name", "grain", "partition_value"])
    gone = F.col("before") & ~F.col("after")
    by_table = days.groupBy(*node_keys, "grain").agg(
        F.count_if("before").alias("n_before"), F.count_if(F.col("before") & F.col("after")).alias("n_left"),
        F.count_if("after").alias("n_after"), F.count_if(gone).cast("int").alias("partitions"),
        F.min(F.when(gone, F.col("partition_value"))).cast("string").alias("first_partition"),
    ).where("n_after > 0 and partitions > 0")
    share = F.col("partitions") / F.col("n_before")
    limit = settings.limit(F.col("model_name"), F.lit("row_count"))
    periods = by_table.select(
        *node_keys, F.lit("(table)").alias("column_name"), F.concat(F.lit("vanished_"), "grain", F.lit("s")).alias("metric"),
        F.col("n_before").cast("double").alias("baseline_value"), F.col("n_left").cast("double").alias("current_value"),
        share.alias("change"), settings.grade(X.settled(share), limit).alias("severity"), "partitions", "first_partition",
    )
    whole = [_signals(df.withColumn("baseline_value", F.col("baseline_value").cast("double")), change=F.lit(1.0)) for df in (tables, fields)]
    return whole[0].unionByName(whole[1]).unionByName(_signals(periods))


def previous_run(columns: DataFrame, partitions: DataFrame, pairs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """All signals of the paired runs, for any number of pairs in one plan.

    What is gone is told with `report_missing` only.
    """
    found = (
        whole_table_signals(columns, pairs, settings)
        .unionByName(bound_signals(columns, pairs, settings))
        .unionByName(per_day_signals(partitions, pairs, settings))
    )
    if settings is None or not settings.report_missing:
        return found
    return found.unionByName(missing_signals(columns, partitions, pairs, settings))


def grain_of(first_partition: Column) -> Column:
    return F.when(first_partition.isNull(), "table").otherwise("day")


# Worst first, with a total order so that ties never depend on scheduling.
def _worst_first() -> list[Column]:
    return [
        X.severity_rank(F.col("severity")), F.desc(X.settled(F.col("change"))),
        *[F.col(c) for c in ("model_name", "column_name", "metric", "partitions")],
    ]


def ranked(signals: DataFrame, *extra: Column) -> DataFrame:
    """Signals by run, worst first."""
    return signals.orderBy("run_id", *_worst_first(), *extra)


def numbered(signals: DataFrame) -> DataFrame:
    """Signals with their position in their run, worst first."""
    return positions(signals, ["run_id"], _worst_first())


def assert_no_drift(signals: DataFrame, level: str = "critical") -> None:
    """Fail a job when signals at or above a severity exist."""
    if level == "none":
        return
    breaching = signals.where(X.at_or_above(F.col("severity"), level)).count()
    if breaching:
        raise AssertionError(f"{breaching} signal(s) at or above {level}")


# ---------------------------------------------------------------- volume


def run_volume(columns: DataFrame) -> DataFrame:
    """Rows measured per run: every column of a node repeats the node's count."""
    per_node = columns.groupBy("run_id", "model_name").agg(F.max("row_count").alias("rows"))
    return per_node.groupBy("run_id").agg(F.sum("rows").alias("volume"))


def volume_mismatch(columns: DataFrame, pairs: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Pairs whose two runs measured very different amounts of data."""
    volume = run_volume(columns)
    base = volume.select(F.col("run_id").alias("baseline_run_id"), F.col("volume").alias("baseline_rows"))
    cur = volume.select("run_id", F.col("volume").alias("current_rows"))
    both = pairs.join(base, "baseline_run_id").join(cur, "run_id")
    ratio = F.try_divide(F.col("current_rows"), F.col("baseline_rows"))
    known = (F.col("baseline_rows") > 0) & (F.col("current_rows") > 0)
    far = (ratio > 1 + tolerance) | (ratio < 1 / (1 + tolerance))
    return both.where(known & far).select("baseline_run_id", "run_id", "baseline_rows", "current_rows")
