"""All registered queries of the engine and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import detail_queries, graph_queries, output_queries, source_queries, stage_queries, upkeep_queries

_PARTS = (graph_queries, stage_queries, upkeep_queries, source_queries, output_queries, detail_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
SQL: dict[str, str] = {name: text for part in _PARTS for name, text in part.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where to start reading: entry points over the graph of the standard tables."""
    return QUERIES["nv_entry_points"](spark, sf_dir)
