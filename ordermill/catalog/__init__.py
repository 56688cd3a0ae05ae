"""Registered queries over the given tables, each with its SQL check where one exists."""

from ordermill.catalog import mart_checks, operator_checks, quality_checks, table_checks
from ordermill.catalog.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "mart_checks",
    "operator_checks",
    "quality_checks",
    "table_checks",
]
