"""Number and line formatting for prompts and alerts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import shortened

def grouped(value: Column, digits: int) -> Column:
    """1234.5 -> 1,234.5000; rounded first so that every engine agrees on ties."""
    return F.format_number(F.round(value, digits), digits)


def percent(value: Column) -> Column:
    """0.609 -> 60.9%"""
    return F.concat(F.format_string("%.1f", F.round(value * 100, 1)), F.lit("%"))


def compact(value: Column) -> Column:
    """Thousands grouped, no trailing zeros; a dash when there is no number."""
    whole = (F.abs(value) >= 1000) & (value == F.floor(value))
    trimmed = F.regexp_replace(F.regexp_replace(grouped(value, 4), "0+$", ""), "\\.$", "")
    return F.when(value.isNull(), "—").when(whole, F.format_number(value, 0)).otherwise(trimmed)


def is_bound(metric: Column) -> Column:
    return metric.isin("min_value", "max_value")


def quoted(text: Column) -> Column:
    return F.when(text.isNull(), "None").otherwise(F.concat(F.lit("'"), shortened(text), F.lit("'")))


def evidence_line(e) -> Column:
    """One evidence line; numbers for metrics, the quoted values for bounds."""
    metric, before, after = e["metric"], e["baseline_value"], e["current_value"]
    head = F.concat(F.lit("  "), e["column_name"], F.lit("."), metric, F.lit(": "))
    no_text = e["baseline_text"].isNull() & e["current_text"].isNull()
    bound = F.when(no_text, F.concat(head, F.lit("changed"))).otherwise(
        F.concat(head, quoted(e["baseline_text"]), F.lit(" -> "), quoted(e["current_text"]))
    )
    ratio = F.when(
        before.isNotNull() & (before != 0) & after.isNotNull(),
        F.concat(F.lit(", ratio x"), F.format_string("%.4f", F.round(F.try_divide(after, before), 4))),
    ).otherwise("")
    number = F.concat(
        head, F.coalesce(grouped(before, 4), F.lit("-")), F.lit(" -> "), F.coalesce(grouped(after, 4), F.lit("-")),
        F.lit("  ("), percent(e["change"]), F.lit(" change, severity "), e["severity"], ratio, F.lit(")"),
    )
    return F.when(is_bound(metric), bound).otherwise(number)
