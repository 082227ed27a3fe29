"""Queries that show the operators on the star schema."""

from . import claims, cleanup, commitments, graph, metrics, more, resolution, rollup, search, sinks  # noqa: F401
from .registry import QUERIES as ALL_QUERIES
from .registry import SQL as ALL_SQL

__all__ = ["ALL_QUERIES", "ALL_SQL"]
