"""A DataFrame from a list of steps, for callers that keep their queries as data.

Each step is a dict with `op` and its arguments, and becomes one DataFrame
call; expressions are Spark SQL text, so Spark does all parsing and planning.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sort(keys: list) -> list[Column]:
    out = []
    for k in keys:
        name, down = (k, False) if isinstance(k, str) else (k["expr"], k.get("desc", False))
        out.append(F.expr(name).desc() if down else F.expr(name).asc())
    return out


def _join(df: DataFrame, s: Mapping, frames: Mapping[str, DataFrame]) -> DataFrame:
    on = s["on"] if isinstance(s.get("on"), list) else F.expr(s["on"])
    return df.join(frames[s["with"]], on, s.get("how", "inner"))


def _window(df: DataFrame, s: Mapping, frames: Mapping[str, DataFrame]) -> DataFrame:
    w = Window.partitionBy(*map(F.expr, s.get("partition_by", []))).orderBy(*_sort(s.get("order_by", [])))
    if "rows" in s:
        w = w.rowsBetween(*[Window.unboundedPreceding if x == "-inf" else Window.unboundedFollowing if x == "inf" else x for x in s["rows"]])
    return df.withColumn(s["name"], F.expr(s["expr"]).over(w))


def _group(df: DataFrame, s: Mapping, frames: Mapping[str, DataFrame]) -> DataFrame:
    grouped = getattr(df, {"groupBy": "groupBy", "cube": "cube", "rollup": "rollup"}[s.get("kind", "groupBy")])(*map(F.expr, s.get("by", [])))
    if "pivot" in s:
        grouped = grouped.pivot(s["pivot"], s["values"])
    return grouped.agg(*[F.expr(e).alias(n) for n, e in s["aggs"].items()])


STEPS: dict[str, Callable[[DataFrame, Mapping, Mapping[str, DataFrame]], DataFrame]] = {
    "select": lambda df, s, f: df.selectExpr(*s["exprs"]),
    "filter": lambda df, s, f: df.filter(s["expr"]),
    "withColumn": lambda df, s, f: df.withColumn(s["name"], F.expr(s["expr"])),
    "rename": lambda df, s, f: df.withColumnsRenamed(s["names"]),
    "drop": lambda df, s, f: df.drop(*s["columns"]),
    "orderBy": lambda df, s, f: df.orderBy(*_sort(s["keys"])),
    "limit": lambda df, s, f: df.limit(s["n"]),
    "offset": lambda df, s, f: df.offset(s["n"]),
    "distinct": lambda df, s, f: df.dropDuplicates(s["subset"]) if s.get("subset") else df.distinct(),
    "group": _group,
    "window": _window,
    "join": _join,
    "crossJoin": lambda df, s, f: df.crossJoin(f[s["with"]]),
    "union": lambda df, s, f: df.union(f[s["with"]]),
    "unionByName": lambda df, s, f: df.unionByName(f[s["with"]], s.get("allow_missing", False)),
    "intersect": lambda df, s, f: df.intersect(f[s["with"]]),
    "subtract": lambda df, s, f: df.subtract(f[s["with"]]),
    "fillna": lambda df, s, f: df.na.fill(s["values"]),
    "dropna": lambda df, s, f: df.na.drop(s.get("how", "any"), s.get("thresh"), s.get("subset")),
    "replace": lambda df, s, f: df.na.replace(s["values"], subset=s.get("subset")),
    "unpivot": lambda df, s, f: df.unpivot(s["ids"], s["values"], s.get("variable", "variable"), s.get("value", "value")),
    "explode": lambda df, s, f: df.withColumn(s["name"], (F.explode_outer if s.get("outer") else F.explode)(F.expr(s["expr"]))),
    "sample": lambda df, s, f: df.sample(s.get("replace", False), s["fraction"], s.get("seed")),
    "describe": lambda df, s, f: df.describe(*s.get("columns", [])),
    "crosstab": lambda df, s, f: df.crosstab(s["a"], s["b"]),
}


def apply(df: DataFrame, steps: list[Mapping], frames: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Apply steps in order; `frames` are the other inputs, by name.  An unknown step is an error that names it."""
    for k, step in enumerate(steps):
        if step.get("op") not in STEPS:
            raise ValueError(f"step {k}: unknown operation {step.get('op')!r}")
        try:
            df = STEPS[step["op"]](df, step, frames or {})
        except KeyError as e:
            raise ValueError(f"step {k} ({step['op']}): missing {e}") from e
    return df
