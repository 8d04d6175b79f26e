"""Importing this package registers every query."""

from quantloom.plans import books, ingest, joining, misc, panels, records, scoring  # noqa: F401
from quantloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
