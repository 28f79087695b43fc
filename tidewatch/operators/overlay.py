"""Faults as pure DataFrame transformations.

A fault never changes stored data: it is a projection or a filter over it.  One
fault can be applied on its own, or many at once, in which case only the rows a
fault really changes are added to the table, next to the shared clean rows.  Those
rows can be kept apart in layers, so that what an edit leaves as it was is not
looked at again (see functions.layers).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.layers import HIT, Layer, Layers, as_layers
from ..functions.runs import RUNS, bit
from ..session import materialise

DROP = "drop"


@dataclass(frozen=True)
class Edit:
    """What happens to a column: scale, scale_cents, null, set, upper, lower, round, or rows drop."""

    op: str
    column: str | None = None
    arg: float | str | bool | None = None

    def value(self, dtype: str) -> Column:
        c = F.col(self.column)
        if self.op == "scale":
            return (c * F.lit(self.arg)).cast(dtype)
        if self.op == "scale_cents":
            return F.round(c * F.lit(self.arg), 2).cast(dtype)
        if self.op == "null":
            return F.lit(None).cast(dtype)
        if self.op == "set":
            return F.lit(self.arg).cast(dtype)
        if self.op == "upper":
            return F.upper(c)
        if self.op == "lower":
            return F.lower(c)
        if self.op == "capitalise":
            return F.concat(F.upper(F.substring(c, 1, 1)), F.expr(f"substring({self.column}, 2)"))
        if self.op == "round":
            return F.round(c, int(self.arg or 0)).cast(dtype)
        raise ValueError(f"unknown edit {self.op!r}")


@dataclass(frozen=True)
class Scope:
    """Which rows a fault touches: a half-open time range and a share of the keys."""

    since: str | None = None
    until: str | None = None
    percent: int = 100

    def sql(self, time_column: str, key_column: str) -> str:
        parts = []
        if self.since:
            parts.append(f"{time_column} >= timestamp_ntz'{self.since}'")
        if self.until:
            parts.append(f"{time_column} < timestamp_ntz'{self.until}'")
        if self.percent < 100:
            parts.append(X.row_share(key_column, self.percent))
        return " and ".join(parts) or "true"

    def where(self, time_column: str, key_column: str) -> Column:
        return F.expr(self.sql(time_column, key_column))


def apply_fault(df: DataFrame, edit: Edit, where: Column) -> DataFrame:
    """One fault over one table."""
    if edit.op == DROP:
        return df.where(~F.coalesce(where, F.lit(False)))
    c = edit.column
    return df.withColumn(c, F.when(where, edit.value(dict(df.dtypes)[c])).otherwise(F.col(c)))


def apply_faults(df: DataFrame, faults: Sequence[tuple[int, Edit, str]]) -> DataFrame:
    """Many runs at once: each fault is (bit index, edit, SQL condition of the rows it touches).

    A row is emitted once for the runs it is unchanged in, and once per distinct
    edit for the runs that edit it; faults that differ only in their rows share
    an edit, so the fan-out is bounded by the edits, not by the runs.
    """
    if not faults:
        return df
    if len({index for index, _, _ in faults}) < len(faults):
        raise ValueError("a run takes one edit; chain apply_fault for several")
    types = dict(df.dtypes)
    by_edit: dict[Edit, list[tuple[int, str]]] = {}
    for index, edit, where in faults:
        by_edit.setdefault(edit, []).append((index, where))

    def bits(members: Sequence[tuple[int, str]]) -> Column:
        parts = [f"(case when {where} then {bit(index)}L else 0L end)" for index, where in members]
        return F.expr(f"({' | '.join(parts)}) & {RUNS}")

    edits = list(by_edit)
    masked = df.withColumns({f"_hit{i}": bits(by_edit[e]) for i, e in enumerate(edits)})
    changed = " | ".join(f"_hit{i}" for i in range(len(edits)))
    touched = list(dict.fromkeys(e.column for e in edits if e.op != DROP))

    def variant(mask: str, edit: Edit | None) -> Column:
        cells = [
            (edit.value(types[c]) if edit and edit.column == c else F.col(c)).alias(c) for c in touched
        ]
        return F.struct(F.expr(mask).alias(RUNS), *cells)

    variants = [variant(f"{RUNS} & ~({changed})", None)] + [
        variant(f"_hit{i}", e) for i, e in enumerate(edits) if e.op != DROP
    ]
    rest = [c for c in df.columns if c not in touched and c != RUNS]
    # Built in a projection, which is compiled; empty variants are dropped after the fan-out.
    fanned = masked.select(*rest, F.array(*variants).alias("_variants")).select(*rest, F.inline("_variants"))
    return fanned.where(F.col(RUNS) != 0).select(*df.columns)


def add_faults(table: DataFrame | Layers, faults: Sequence[tuple[int, Edit, str]], store: bool = False) -> Layers:
    """The rows of `apply_faults` as layers: one per edited column, beside the rows as they were.

    Layers that are there already keep their rows, so a run takes its edit at one of the nodes.
    With store, the base is written with its masks and conditions: what is made of many runs then
    starts from columns, where dozens of conditions would be planned and generated for each use.
    """
    table = as_layers(table)
    if not faults:
        return table
    bits = [bit(index) for index, _, _ in faults]
    if len(set(bits)) < len(faults) or any(x.bits & sum(bits) for x in table.layers):
        raise ValueError("a run takes one edit; chain apply_fault for several")
    base, types = table.base, dict(table.base.dtypes)
    # Many runs share a condition: each is evaluated once per row.
    wheres = list(dict.fromkeys(where for _, _, where in faults))
    marked = [f"_where{i}" for i in range(len(wheres))]
    held = base.withColumns({m: F.expr(w) for m, w in zip(marked, wheres)})

    def mask(members: Sequence[tuple[int, Edit, str]], runs: str = RUNS) -> str:
        by_where: dict[int, int] = {}
        for index, _, where in members:
            i = wheres.index(where)
            by_where[i] = by_where.get(i, 0) | bit(index)
        parts = [f"(case when _where{i} then {b}L else 0L end)" for i, b in by_where.items()]
        return f"(({' | '.join(parts)}) & {runs})"

    columns = list(dict.fromkeys(e.column for _, e, _ in faults if e.op != DROP))
    of = {c: [f for f in faults if f[1].op != DROP and f[1].column == c] for c in columns}
    start = len(table.layers)
    hits = {c: f"{HIT}{start + i}" for i, c in enumerate(columns)}
    held = held.select(
        *table.columns, F.expr(f"{RUNS} & ~{mask(faults)}").alias(RUNS), F.col(RUNS).alias("_all"),
        *[x.hit for x in table.layers], *[F.expr(mask(of[c])).alias(h) for c, h in hits.items()], *marked,
    )
    if store:
        held = materialise(held, "marked")
    layers = []
    for c in columns:
        edits = list(dict.fromkeys(e for _, e, _ in of[c]))
        variants = [
            F.struct(F.expr(mask([f for f in of[c] if f[1] == e], "_all")).alias(RUNS), e.value(types[c]).alias(c)) for e in edits
        ]
        rest = [x for x in table.columns if x != c]
        # Not a filter below: its condition would be carried upwards through every alias as a constraint.
        rows = held.select(*rest, F.when(F.col(hits[c]) != 0, F.array(*variants)).alias("_variants"))
        rows = rows.select(*rest, F.inline("_variants")).where(F.col(RUNS) != 0).select(*table.columns, RUNS)
        layers.append(Layer(hits[c], rows, frozenset([c]), sum(bit(index) for index, _, _ in of[c])))
    return replace(table, base=held.drop("_all", *marked), layers=(*table.layers, *layers))
