"""Queries over the given tables, one per operator, each with an SQL statement of the same result."""

from workloads import data_queries, flow_queries, state_queries  # noqa: F401
from workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
