"""The corpus pipeline, counted as part of the subpackage that holds it: see nearkin/llm/pipeline.py."""

from nearkin.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
