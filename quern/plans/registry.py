"""All registered queries of the core, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import catalog_queries, ingest_queries, interval_queries, lexical_queries, more_queries, source_queries, stream_queries, vector_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (interval_queries, catalog_queries, source_queries, lexical_queries, vector_queries, stream_queries, more_queries, ingest_queries)
FLAGSHIP: Query = vector_queries.plan_smart


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
