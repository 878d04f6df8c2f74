"""The corpus pipeline at the place where the driver looks for it; its stages are in `driftlane.llm.corpus`."""

from driftlane.llm.corpus import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
