"""All queries of the library by name, and SQL for those that SQL can express."""

from driftlane.plans import prepare, protocol, scoring  # noqa: F401  (they register)
from driftlane.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
