"""How catalog modules read tables and register queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory; scans stay lazy, so Catalyst prunes and pushes down."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry(dict):
    """name -> (query, DuckDB SQL or None)."""

    def query(self, sql: str | None = None) -> Callable:
        """Register the decorated function of (spark, sf_dir) under its own name."""

        def add(run):
            self[run.__name__] = (run, sql)
            return run

        return add

    def projection(self, name: str, table: str, keys: list[str], rows: list[tuple], where: tuple[str, str] | None = None) -> None:
        """Register a projection of one table.

        rows: (alias, Spark expression[, DuckDB expression]); without the
        third, both engines read the same text.  where: the filter for each.
        A DuckDB expression of None leaves the whole query without SQL.
        """

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = read(spark, sf_dir, table)
            if where:
                df = df.filter(where[0])
            return df.select(*keys, *[F.expr(r[1]).alias(r[0]) for r in rows])

        run.__name__ = name
        run.__doc__ = f"{', '.join(r[0] for r in rows)} of {table}."
        duck = [r[-1] if len(r) > 2 else r[1] for r in rows]
        sql = None
        if None not in duck:
            sql = f"SELECT {', '.join([*keys, *[f'{d} AS {r[0]}' for d, r in zip(duck, rows)]])} FROM {table}" + (f" WHERE {where[1]}" if where else "")
        self[name] = (run, sql)
