"""Frame operations beyond Spark's own methods."""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a join without an equality may have to look at.
CROSS_BUDGET = 10_000_000


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """Names of the columns that match a whole pattern, in order."""
    return [c for c in df.columns if re.fullmatch(pattern, c)]


def check_cross_budget(left: DataFrame, right: DataFrame, budget: int = CROSS_BUDGET) -> None:
    """Refuse a pair of inputs whose row product is over the budget; counts stop as soon as that is known.

    The optimizer's sizes can't tell: files hold rows of less than a byte.
    """
    n = left.limit(budget + 1).count()
    m = right.limit(budget // max(n, 1) + 1).count() if n <= budget else budget + 1
    if n * m > budget:
        raise ValueError(f"a join without equalities would look at more than {budget} pairs of rows; add an equality or raise the budget")


def cross_join(left: DataFrame, right: DataFrame, budget: int = CROSS_BUDGET) -> DataFrame:
    """Cartesian product within the budget."""
    check_cross_budget(left, right, budget)
    return left.crossJoin(right)


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner", budget: int = CROSS_BUDGET) -> DataFrame:
    """Join on any condition, within the budget; outer, semi and anti forms keep their meaning."""
    check_cross_budget(left, right, budget)
    return left.join(right, condition, how)


def bytes_of(df: DataFrame) -> int:
    """The size that the optimizer expects of a frame, from file sizes and statistics; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_within(df: DataFrame, most_bytes: int = 64 << 20, most_rows: int = 1_000_000) -> DataFrame:
    """Mark a side for broadcast if it is expected to be small and has few rows; else leave it to be dealt by key.

    Files may be far smaller than their rows, so these are counted too, up to the bound.
    """
    if bytes_of(df) <= most_bytes and df.limit(most_rows + 1).count() <= most_rows:
        return F.broadcast(df)
    return df


def join_typed(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on a key whose types differ; both become text if one is, else the wider number.

    Text that differs from a number only in how it is written (leading zeros,
    spaces) is not equal to it.
    """
    a, b = left.schema[key].dataType, right.schema[key].dataType
    if a != b:
        order = ["tinyint", "smallint", "int", "bigint", "float", "double"]
        kinds = {a.simpleString(), b.simpleString()}
        to = max(kinds, key=order.index) if kinds <= set(order) else "string"
        left, right = (df.withColumn(key, F.col(key).cast(to)) for df in (left, right))
    return left.join(right, key, how)


def join_with_keys(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], how: str = "inner", suffix: str = "_right") -> DataFrame:
    """Equi join on keys of different names; other names on both sides get a suffix on the right."""
    taken, names = set(left.columns), {}
    for c in right.columns:
        new = c
        while new in taken:
            new += suffix
        names[c] = new
        taken.add(new)
    renamed = right.withColumnsRenamed({a: b for a, b in names.items() if a != b})
    on = [left[a] == renamed[names[b]] for a, b in zip(left_on, right_on, strict=True)]
    return left.join(renamed, on, how)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """For each left row the latest time of the right rows of its key that isn't later; null without one.

    Both sides go through one shuffle by key and one window, so no pair of
    rows is ever formed.  Of equal times the right row counts as earlier.
    """
    rows = left.withColumn("__left", F.lit(True)).unionByName(right.select(key, at).withColumn("__left", F.lit(False)), allowMissingColumns=True)
    seen = Window.partitionBy(key).orderBy(F.col(at), F.col("__left")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last(F.when(~F.col("__left"), F.col(at)), ignorenulls=True).over(seen)
    return rows.withColumn(name, found).filter("__left").drop("__left")


def union_aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name if both have the same names, else by position."""
    return a.unionByName(b) if set(a.columns) == set(b.columns) else a.union(b)


def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of pairs, a row each, so that the number of distinct values isn't bounded."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("count"))


def numeric(df: DataFrame) -> list[str]:
    """Names of numeric columns."""
    return [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]


def correlations(df: DataFrame) -> DataFrame:
    """(a, b, corr) of all pairs of numeric columns, each with itself too, in one aggregation."""
    names = numeric(df)
    pairs = [*combinations(names, 2)]
    one = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs) for x, y in ((a, b), (b, a))]
    rows += [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("corr")) for c in names]
    return one.select(F.inline(F.array(*rows)))


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float], parts: int = 64) -> DataFrame:
    """(p, value): exact interpolated quantiles of the values that aren't null; null values where there are none.

    Values are counted first.  A sketch gives bounds of about equal parts; ranks
    are running sums within a part plus what the parts before it hold, so no
    task sorts more than its part and no state grows with the distinct values.
    """
    values = df.select(F.col(column).cast("double").alias("value")).filter("value IS NOT NULL")
    bounds = values.agg(F.percentile_approx("value", [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))).cast("array<double>"), lambda b: b < F.col("value")))
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("part", part)
    sizes = counts.groupBy("part").agg(F.sum("n").alias("m"))
    # One row a part: at most `parts` of them.
    before = sizes.select("part", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("skip"), F.sum("m").over(Window.partitionBy()).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    ranked = counts.withColumn("upto", upto).join(F.broadcast(before), "part").withColumn("last", F.col("skip") + F.col("upto") - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    wanted = F.explode(F.array(*map(F.lit, probabilities))).alias("p")
    at = ranked.select("value", "first", "last", "total", wanted).withColumn("at", F.col("p") * (F.col("total") - 1))
    near = at.filter("first <= ceil(at) AND last >= floor(at)")
    low = F.max(F.when(F.expr("floor(at) BETWEEN first AND last"), F.col("value")))
    high = F.max(F.when(F.expr("ceil(at) BETWEEN first AND last"), F.col("value")))
    found = near.groupBy("p").agg((low + (high - low) * F.max(F.expr("at - floor(at)"))).alias("value"))
    asked = df.sparkSession.createDataFrame([(p,) for p in probabilities], "p double")
    return asked.join(found, "p", "left")


def frequent(df: DataFrame, column: str, support: float) -> DataFrame:
    """Values with at least a share `support` of all rows, exactly; at most 1 / support rows."""
    total = df.count()
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= support * total).select("value")


def describe_rounded(df: DataFrame, *columns: str, digits: int = 1) -> DataFrame:
    """describe() with mean and stddev to a number of digits."""
    out = df.describe(*columns)
    names = [c for c in out.columns if c != "summary"]
    cut = lambda c: F.when(F.col("summary").isin("mean", "stddev"), F.format_string(f"%.{digits}f", F.expr(f"try_cast(`{c}` AS double)"))).otherwise(F.col(c))
    return out.select("summary", *[cut(c).alias(c) for c in names])


def sample_exact(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Exactly round(n * fraction) rows, by the least hashes of a row with the seed, repeated rows in any order.

    The hash at the wanted rank is found by narrowing its range in counting
    passes, so nothing is sorted; rows below it are taken as they are read, and
    only rows of that one hash are limited.
    """
    n = round(df.count() * fraction)
    rows = df.withColumn("__h", F.xxhash64(F.lit(seed), *df.columns))
    low, high = -(1 << 63), 1 << 63  # the rank lies in [low, high)
    taken = 0
    while n and high - low > 1:
        step = max(1, (high - low) // 256)
        part = F.floor((F.col("__h").cast("decimal(38,0)") - F.lit(low).cast("decimal(38,0)")) / F.lit(step).cast("decimal(38,0)")).alias("k")
        inside = F.col("__h").cast("decimal(38,0)").between(F.lit(low).cast("decimal(38,0)"), F.lit(high - 1).cast("decimal(38,0)"))
        counts = sorted((int(r["k"]), r["count"]) for r in rows.filter(inside).groupBy(part).count().collect())
        if not counts:
            break
        k = counts[-1][0]
        for k, m in counts:
            if taken + m >= n:
                break
            taken += m
        low, high = low + k * step, min(high, low + (k + 1) * step)
        if m == n - taken or m <= 10_000:
            break
    if not n:
        return df.limit(0)
    at = F.col("__h").cast("decimal(38,0)")
    sure = rows.filter(at < F.lit(low).cast("decimal(38,0)"))
    rest = rows.filter(at.between(F.lit(low).cast("decimal(38,0)"), F.lit(high - 1).cast("decimal(38,0)"))).orderBy("__h").limit(n - taken)
    return sure.union(rest).drop("__h")
