"""Named queries by category, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import aggregates, collections, more, relational, scalars, session_info, sql_surface, tables, udfs, windows

MODULES = (relational, scalars, aggregates, windows, collections, sql_surface, session_info, udfs, tables, more)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """name -> query over (spark, sf_dir), of all categories."""
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """name -> DuckDB SQL, of the queries that have one."""
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
