"""Comparison of results without regard to the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalised(df: DataFrame, digits: int = 6) -> DataFrame:
    """Columns by name, doubles rounded, so that equal results are equal rows."""
    cols = []
    for c, t in sorted(df.dtypes):
        q = F.col(f"`{c}`")
        cols.append((F.round(q.cast("double"), digits) + F.lit(0.0) if t in ("float", "double") else F.to_json(F.struct(q)) if t.startswith(("map", "array", "struct")) else q).alias(c))
    return df.select(*cols)


def difference(a: DataFrame, b: DataFrame, digits: int = 6) -> DataFrame:
    """Rows that one side has more often, with the numbers of times; empty for equal results.

    One aggregation over both sides: nothing is sorted or gathered.
    """
    a, b = normalised(a, digits), normalised(b, digits)
    if a.columns != b.columns:
        raise ValueError(f"columns differ: {a.columns} and {b.columns}")
    both = a.withColumn("__a", F.lit(1)).withColumn("__b", F.lit(0)).union(b.withColumn("__a", F.lit(0)).withColumn("__b", F.lit(1)))
    return both.groupBy(*a.columns).agg(F.sum("__a").alias("left_rows"), F.sum("__b").alias("right_rows")).filter("left_rows <> right_rows")


def equal(a: DataFrame, b: DataFrame, digits: int = 6) -> bool:
    """Whether two results have the same rows as often."""
    return difference(a, b, digits).isEmpty()
