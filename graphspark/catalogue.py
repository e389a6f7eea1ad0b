"""The queries over the synthetic tables, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphspark.queries import graph, indexing, upkeep

FLAGSHIP = "explore_d2"
_FAMILIES = (graph, indexing, upkeep)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for family in _FAMILIES for k, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for family in _FAMILIES for k, s in family.SQL.items()}
