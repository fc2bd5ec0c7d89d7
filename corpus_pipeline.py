"""The corpus pipeline of traceloom.llm.pipeline: its stages, and their run over the table documents."""

from traceloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
