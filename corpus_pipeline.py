"""The corpus pipeline: its stages, their run and its SQL (none)."""

from loadcast.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
