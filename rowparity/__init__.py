"""Comparing two tables with Spark: row differences, counts, statistics, tolerances and reports."""

from .functions.kinds import KINDS, Kind, Settings
from .functions.tolerance import Tolerance, parse
from .plans.compare import Comparison
from .plans.result import ColumnFound, SideCounts, Summary
from .sources.schema import Column, Intersection, KeyColumnError, describe, intersect

__all__ = [
    "KINDS",
    "Column",
    "ColumnFound",
    "Comparison",
    "Intersection",
    "KeyColumnError",
    "Kind",
    "Settings",
    "SideCounts",
    "Summary",
    "Tolerance",
    "describe",
    "intersect",
    "parse",
]
