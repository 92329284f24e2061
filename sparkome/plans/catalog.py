"""Registry of the library's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import file_queries, graph_queries, load_queries, phenotype_queries, plot_queries, surface_queries

_MODULES = (phenotype_queries, graph_queries, plot_queries, load_queries, file_queries, surface_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in _MODULES for name, text in m.SQL.items()}
