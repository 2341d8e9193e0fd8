"""The queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import exports, flows, market, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = market.QUERIES | records.QUERIES | flows.QUERIES | exports.QUERIES
ORACLE_SQL: dict[str, str] = market.SQL | records.SQL | flows.SQL | exports.SQL
