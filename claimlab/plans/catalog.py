"""All registered queries of the engine."""

from __future__ import annotations

from . import case_queries, composite_queries, inference_queries, panel_queries, study_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
