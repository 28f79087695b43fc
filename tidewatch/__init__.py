"""Data-drift and root-cause analytics on Spark."""

from .settings import Settings

__all__ = ["Settings"]
