"""Every query of the library by name, and its SQL."""

from __future__ import annotations

from . import command_queries, detail_queries, export_queries, image_queries, media_queries, planner_queries, scalar_queries, sequence_queries, vector_queries  # noqa: F401  they register
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
