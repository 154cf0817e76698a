"""Registered queries over the driver tables and the SQL that DuckDB checks them with."""

from __future__ import annotations

from . import array_queries, metric_queries, more_queries, text_queries  # noqa: F401
from ._registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
