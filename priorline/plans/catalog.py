"""Importing this module registers every query."""

from priorline.plans import effect_queries, evaluation_queries, league_queries, lifecycle_queries, player_queries, scalar_queries, source_queries, table_queries, window_queries  # noqa: F401
from priorline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
