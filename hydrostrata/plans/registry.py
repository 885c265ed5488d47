"""Queries of the domain operators by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import flow_queries, model_queries, series_queries, spatial_queries, table_queries, variogram_queries

_MODULES = (series_queries, spatial_queries, table_queries, flow_queries, model_queries, variogram_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
