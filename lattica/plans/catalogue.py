"""All queries on the driver tables and the SQL that gives the same rows."""

from lattica.plans import lines, panels, scans, spaces, texts  # noqa: F401
from lattica.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
