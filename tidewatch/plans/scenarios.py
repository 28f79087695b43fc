"""The fault catalogue over the events nodes: what is broken, and the right answer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.overlay import DROP, Edit, Scope, apply_fault

# Windows, factors and shares of the benchmark.
WINDOWS = {
    "month": ("2024-01-20", None),
    "week": ("2024-01-20", "2024-01-27"),
    "day": ("2024-01-20", "2024-01-21"),
}
SCALES = {
    "unit-change": {"large": 1.609, "medium": 1.25, "small": 1.05},
    "inflation": {"large": 1.5, "medium": 1.2, "small": 1.03},
}
MART_SCALES = {"large": 1.5, "medium": 1.2, "small": 1.05}
SHARES = {"large": 100, "medium": 50, "small": 10}
DROPS = {"large": 50, "medium": 20, "small": 5}
CONTROLS = {"tip": 1.03, "extra": 1.02, "tip-near-limit": 1.045}

BASELINE = "baseline"


@dataclass(frozen=True)
class Fault:
    """A single break to try by hand, from a given day onwards."""

    key: str
    description: str
    edit: Edit
    only: str = "true"
    percent: int = 100


FAULTS = {
    f.key: f
    for f in (
        Fault("unit-change", "value silently switches its unit", Edit("scale_cents", "value", 1.60934)),
        Fault("null-spike", "half of the users stop sending user_id", Edit("null", "user_id"), "user_id % 2 = 0"),
        Fault("enum-drift", "an undocumented event_type starts to appear", Edit("set", "event_type", "unknown"), "event_type = 'view'", 10),
        Fault("case-change", "event_type starts with a capital letter", Edit("capitalise", "event_type")),
    )
}


def inject(events: DataFrame, key: str, since: str) -> DataFrame:
    """The events with one named fault from a day onwards; the stored table stays clean."""
    if key not in FAULTS:
        raise ValueError(f"no fault is called {key!r}, only {sorted(FAULTS)}")
    fault = FAULTS[key]
    scope = Scope(since, None, fault.percent).sql("ts", "event_id")
    return apply_fault(events, fault.edit, F.expr(f"({scope}) and ({fault.only})"))


@dataclass(frozen=True)
class Scenario:
    id: str
    layer: str
    node: str
    edit: Edit | None
    scope: Scope
    expected_root: str | None
    expected_columns: tuple[str, ...]
    magnitude: str
    window: str
    description: str = ""


# Families of breaks: name, layer, node, the columns a finding should name, the edit of a
# level, the levels by magnitude, and the windows.  A level is a factor or a share in percent.
def _scale(k: float) -> tuple[Edit, int]:
    return Edit("scale", "value", k), 100


def _share(edit: Edit):
    return lambda percent: (edit, percent)


def _whole(edit: Edit):
    return lambda _: (edit, 100)


EVERY, MONTH, ALL = tuple(WINDOWS), ("month",), ("all",)
FAMILIES = [
    *((name, "source", "events", ("value",), _scale, levels, EVERY) for name, levels in SCALES.items()),
    ("null-spike", "source", "events", ("user_id",), _share(Edit("null", "user_id")), SHARES, EVERY),
    ("enum-drift", "source", "events", ("event_type",), _share(Edit("set", "event_type", "unknown")), SHARES, EVERY),
    ("row-drop", "source", "events", (), _share(Edit(DROP)), DROPS, EVERY),
    ("case-change", "source", "events", ("event_type",), _whole(Edit("upper", "event_type")), {"large": None}, EVERY),
    ("precision-loss", "source", "events", ("value",), _whole(Edit("round", "value", 0)), {"medium": None}, EVERY),
    ("flag-logic-break", "model", "fct_events", ("is_clean",), _whole(Edit("set", "is_clean", True)), {"large": None}, ALL),
    ("mart-scaling", "model", "fct_events", ("value_usd",), lambda k: (Edit("scale", "value_usd", k), 100), MART_SCALES, MONTH),
    ("mart-null", "model", "fct_events", ("user_id",), _whole(Edit("null", "user_id")), {"large": None}, MONTH),
]
CONTROL = "control"


def told(edit: Edit | None, percent: int, window: str) -> str:
    """What an edit does, in words."""
    if edit is None:
        return "no change"
    argument = "" if edit.arg is None else f" {edit.arg}"
    what = "drop" if edit.op == DROP else f"{edit.op} {edit.column}{argument}"
    return f"{what}; {percent}% of rows; window: {window}"


def _broken() -> Iterator[Scenario]:
    for name, layer, node, columns, make, levels, windows in FAMILIES:
        for window, (magnitude, level) in product(windows, levels.items()):
            edit, percent = make(level)
            scope = Scope(*WINDOWS.get(window, (None, None)), percent)
            label = "month" if window == "all" else window  # fixed value: so the id is known
            yield Scenario(
                f"{name}-{magnitude}-{label}", layer, node, edit, scope, node, columns, magnitude, window, told(edit, percent, window)
            )


def _silent() -> Iterator[Scenario]:
    """Changes below every limit, and none at all: nothing may be found."""
    edits = {f"{CONTROL}-null": None} | {
        f"{CONTROL}-subthreshold-{name}": Edit("scale_cents", "value", k) for name, k in CONTROLS.items()
    }
    for key, edit in edits.items():
        yield Scenario(key, CONTROL, "events", edit, Scope(), None, (), "none", "none", told(edit, 100, "all"))


def catalogue() -> list[Scenario]:
    return [*_broken(), *_silent()]


def by_id(*ids: str) -> list[Scenario]:
    known = {s.id: s for s in catalogue()}
    return [known[i] for i in ids]


def catalogue_frame(spark: SparkSession, scenarios: list[Scenario] | None = None) -> DataFrame:
    rows = [
        (
            s.id, s.layer, s.node, s.edit.op if s.edit else "none", s.edit.column if s.edit else None,
            s.scope.percent, s.scope.since, s.scope.until, s.expected_root, list(s.expected_columns),
            s.magnitude, s.window, s.description,
        )
        for s in (scenarios or catalogue())
    ]
    return spark.createDataFrame(
        rows,
        "run_id string, layer string, node string, op string, column_name string, percent int, since string, "
        "until string, expected_root string, expected_columns array<string>, magnitude string, window string, "
        "description string",
    )
