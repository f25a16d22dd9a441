"""Registered queries and their SQL."""

from heapscope.plans import q_access, q_functions, q_history, q_index, q_listing, q_more, q_rest, q_search, q_streams, q_views  # noqa: F401
from heapscope.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
