"""The corpus pipeline over documents; its stages are in tidemark/llm/pipeline.py."""

from __future__ import annotations

from tidemark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
