"""Column expressions shared by the operators.  Everything here stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import SEVERITIES, Settings

# Changes are compared after rounding: a factor of exactly 1.05 meets a 5% limit
# only up to float noise, and parallel sums are not associative.
CHANGE_DIGITS = 9


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def relative_change(before: Column, after: Column) -> Column:
    """|after - before| / |before|; appearing or vanishing counts as 1.

    Two values that are equal, NaN or infinite ones included, have not moved; a value
    that became NaN or infinite, or is no longer, has moved by 1.
    """
    none_before = before.isNull() | (before == 0)
    none_after = after.isNull() | (after == 0)
    return (
        F.when((none_before & none_after) | (before == after), 0.0)
        .when(none_before | after.isNull() | ~is_finite(before) | ~is_finite(after), 1.0)
        .otherwise(F.abs(after - before) / F.abs(before))
    )


def is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def rate_change(before: Column, after: Column) -> Column:
    """Movement of a rate in points; a missing rate counts as 0."""
    zero = F.lit(0.0)
    return F.abs(F.coalesce(after, zero) - F.coalesce(before, zero))


def metric_change(metric: Column, before: Column, after: Column) -> Column:
    return F.when(metric == "null_rate", rate_change(before, after)).otherwise(
        relative_change(before, after)
    )


def settled(change: Column) -> Column:
    return F.round(change, CHANGE_DIGITS)


def severity_rank(severity: Column) -> Column:
    return (
        F.when(severity == "critical", 0)
        .when(severity == "high", 1)
        .when(severity.isNull() | (severity == "warning"), 2)
        .otherwise(99)
    )


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)


def at_or_above(severity: Column, level: str) -> Column:
    return severity_rank(F.lower(severity)) <= SEVERITIES.index(level)


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType))


def literal(text: str) -> str:
    """A string as SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def text_of(value: str, dtype: T.DataType) -> str:
    """SQL text for a min or max as text; fractional numbers with six decimals."""
    if is_fractional(dtype):
        fixed = f"cast(try_cast(round({value}, 6) as decimal(38,6)) as string)"
        return f"coalesce({fixed}, cast({value} as string))"
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return f"to_json({value})"
    return f"cast({value} as string)"


def masked_bound(column_name: Column, text: Column, settings: Settings) -> Column:
    """A bound that may be stored: withheld if the column is masked."""
    return F.when(text.isNotNull() & settings.masked(column_name), "<masked>").otherwise(text)


def shortened(text: Column) -> Column:
    """A text as messages show it; longer ones say that they go on."""
    return F.when(F.length(text) > 120, F.concat(F.substring(text, 1, 117), F.lit("..."))).otherwise(text)


def shown_bound(column_name: Column, text: Column, settings: Settings) -> Column:
    """A bound fit for messages: withheld if the column is masked, cut if long."""
    return shortened(masked_bound(column_name, text, settings))


def mixed(key: str) -> str:
    """SQL text for (key * 2654435761) mod 2**32 on a bigint key.

    Taken in 16-bit halves, so that no key overflows.
    """
    # Fixed value: the multiplier, shared with the oracle SQL.
    k, factor = f"pmod(cast({key} as bigint), 4294967296L)", "2654435761L"
    return f"(({k} & 65535L) * {factor} + ((shiftright({k}, 16) * {factor}) & 65535L) * 65536L) % 4294967296L"


def row_share(key: str, percent: int) -> str:
    """SQL text for a fixed share of rows chosen by key: the same rows on every run."""
    return f"({mixed(key)}) % 100 < {percent}"


def row_order(key: str, seed: int) -> Column:
    """A seeded pseudo-random rank for repeatable samples."""
    return F.expr(mixed(f"({key} + {seed})"))


def exact_sums(**values: Column) -> dict[str, Column]:
    """Sums that do not depend on the order in which parts are added: two aggregates per name.

    Sums of doubles differ in their last bits from run to run, which would show as
    changed bounds of a mart; fixed-point sums do not.  Values without a fixed-point
    form (NaN, infinite, from 1e20 up) are summed beside, as doubles, so that none
    is lost; `exact_totals` puts both together when the last parts are added.
    """
    out = {}
    for label, value in values.items():
        fixed = value.try_cast("decimal(28,8)")
        out[label] = F.sum(fixed)
        out[f"_rest_{label}"] = F.sum(F.when(fixed.isNull(), value.cast("double")))
    return out


def exact_totals(df: DataFrame, *labels: str) -> DataFrame:
    """The sums of `exact_sums` as doubles."""
    def total(label: str) -> Column:
        fixed, rest = F.col(label).cast("double"), F.col(f"_rest_{label}")
        return F.when(rest.isNull(), fixed).otherwise(F.coalesce(fixed, F.lit(0.0)) + rest)

    return df.withColumns({x: total(x) for x in labels}).drop(*[f"_rest_{x}" for x in labels])


def any_of(predicates) -> Column:
    return reduce(lambda a, b: a | b, predicates)


def robust_z(value: Column, median: Column, mad: Column) -> Column:
    """How unusual a value is against the median and MAD of its own history."""
    distance = F.abs(value - median)
    scale = F.greatest(F.abs(median), F.lit(1e-9))
    flat = F.when(distance <= scale * 1e-6, 0.0).otherwise(distance / scale * 10)
    # A value like its history is usual, NaN in a history of NaN too; one that became or ceased
    # to be NaN or infinite is as far off as twice a flat history.
    odd = F.when(value == median, 0.0).when(~is_finite(value) | ~is_finite(median), 10.0)
    return odd.when((mad == 0) | ~is_finite(mad), flat).otherwise(F.abs((value - median) * 0.6745 / mad))


def middle(values: Column) -> Column:
    """Median of an array of doubles without nulls; null when it is empty."""
    ordered = F.array_sort(values)
    n = F.size(values)
    half = F.greatest(F.floor(n / 2).cast("int"), F.lit(1))
    return F.when(n % 2 == 1, F.try_element_at(ordered, F.floor(n / 2).cast("int") + 1)).otherwise(
        (F.try_element_at(ordered, half) + F.try_element_at(ordered, half + 1)) / 2
    )
