"""A table of many runs in layers: every row once, and beside it the rows that edits made of it.

A row that ten runs have edited in one column is ten rows of a flat table (see functions.runs),
equal in all columns but that one and what is derived from it.  In layers the row is kept once,
in the base, with the runs it is unchanged in and, per layer, the runs whose copy lies there.  A
layer holds the copies, and the names of the columns in which they may differ.  Any other column
is counted from the base alone, for the runs of both; nothing derives it again for each copy.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .expr import name
from .runs import RUNS, has_runs, mask_of

HIT = "_hit_"


@dataclass(frozen=True)
class Layer:
    hit: str  # the column of the base that holds the runs of a row's copies in this layer
    rows: DataFrame
    differs: frozenset[str]  # the columns that may hold another value than the row of the base
    bits: int = 0  # all runs that the layer may hold


@dataclass(frozen=True)
class Layers:
    base: DataFrame
    layers: tuple[Layer, ...] = ()

    @property
    def columns(self) -> list[str]:
        marks = {RUNS, *[x.hit for x in self.layers]}
        return [c for c in self.base.columns if c not in marks]

    def mask(self, differing: Collection[Layer] = ()) -> str:
        """SQL for the runs that a row of the base stands for, apart from those in the given layers."""
        return " | ".join([RUNS, *[x.hit for x in self.layers if x not in differing]])

    def differing(self, column: str) -> tuple[Layer, ...]:
        return tuple(x for x in self.layers if column in x.differs)

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> Layers:
        """A row-by-row transformation of every layer; it has to carry the columns of `marks`."""
        return Layers(
            fn(self.base),
            tuple(Layer(x.hit, out, derived(out, x.rows, x.differs), x.bits) for x in self.layers for out in (fn(x.rows),)),
        )

    def flat(self, columns: Sequence[str] | None = None) -> DataFrame:
        """One table of tagged rows; with columns, copies that are equal in all of these are one row.

        A row that no run holds is kept with an empty mask, which counts nowhere.
        """
        if not has_runs(self.base):
            return self.base.select(*(columns or self.columns))
        names = list(columns or self.columns)
        apart = tuple(x for x in self.layers if x.differs.intersection(names))
        out = self.base.selectExpr(*map(name, names), f"{self.mask(apart)} as {RUNS}")
        for x in apart:
            out = out.unionByName(x.rows.select(*names, RUNS))
        return out


def as_layers(table: DataFrame | Layers) -> Layers:
    if isinstance(table, Layers):
        return table if has_runs(table.base) else Layers(table.base.withColumn(RUNS, mask_of(table.base)))
    return Layers(table.withColumn(RUNS, mask_of(table)))


def marks(df: DataFrame) -> list[str]:
    """The columns that a transformation of tagged rows carries along."""
    return [c for c in df.columns if c == RUNS or c.startswith(HIT)]


def derived(out: DataFrame, source: DataFrame, columns: Collection[str]) -> frozenset[str]:
    """The columns of `out`, made of `source`, that depend on some of its columns.

    Told from the analysed plan: projections are followed, filters if they do not depend on the
    columns.  Behind anything else every column counts as dependent, which is right but slower.
    """
    def ids(attributes) -> list[int]:
        items = attributes.toSeq() if hasattr(attributes, "toSeq") else attributes
        return [items.apply(i).exprId().id() for i in range(items.size())]

    if not hasattr(out, "_jdf"):
        return frozenset(out.columns)
    top, bottom = (df._jdf.queryExecution().analyzed() for df in (out, source))

    def follow(plan) -> set[int] | None:
        if plan.equals(bottom):
            return {i for i, c in zip(ids(plan.output()), source.columns) if c in columns}
        if plan.nodeName() not in ("Project", "Filter"):
            return None
        below = follow(plan.child())
        if below is None:
            return None
        if plan.nodeName() == "Filter":
            return None if below.intersection(ids(plan.condition().references())) else below
        made = plan.projectList()
        entries = [made.apply(i) for i in range(made.size())]
        return {e.exprId().id() for e in entries if below.intersection(ids(e.references()))}

    found = follow(top)
    if found is None:
        return frozenset(out.columns)
    return frozenset(c for i, c in zip(ids(top.output()), out.columns) if i in found)
