"""Every named query with its oracle."""

from . import causes, drifting, faults, profiling, reporting  # noqa: F401
from .base import ORACLES, QUERIES, forget

__all__ = ["ORACLES", "QUERIES", "forget"]
