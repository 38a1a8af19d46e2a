"""Imports every module of queries, which registers them."""

from gaugebook.catalog import (
    aggregates,
    expressions,
    filters,
    joins,
    ordering,
    reports,
    sources_and_tables,
    stateful,
)
from gaugebook.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
