"""Grouped aggregation: every aggregate, cube, rollup, grouping sets and pivot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Registry, read

QUERIES = Registry()
query = QUERIES.query


def _grouped(name: str, table: str, keys: list[str], rows: list[tuple], where: str | None = None) -> None:
    """Register one groupBy with many aggregates: (alias, Spark expression[, DuckDB expression])."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, table)
        df = df.filter(where) if where else df
        aggs = [F.expr(r[1]).alias(r[0]) for r in rows]
        return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)

    run.__doc__ = f"{', '.join(r[0] for r in rows)} of {table} by {', '.join(keys) or 'nothing'}."
    duck = [r[-1] if len(r) > 2 else r[1] for r in rows]
    sql = None
    if None not in duck:
        sql = f"SELECT {', '.join([*keys, *[f'{d} AS {r[0]}' for d, r in zip(duck, rows)]])} FROM {table}" + (f" WHERE {where}" if where else "") + (f" GROUP BY {', '.join(keys)}" if keys else "")
    QUERIES[name] = (run, sql)


R = lambda x, n=6: f"round({x}, {n})"
_grouped("agg_basic", "lineitem", ["l_returnflag", "l_linestatus"], [
    ("n", "count(*)"), ("n_q", "count(l_quantity)"), ("total", R("sum(l_quantity)", 2)), ("mean", R("avg(l_quantity)")), ("mean2", R("mean(l_tax)")), ("hi", "max(l_extendedprice)"), ("lo", "min(l_extendedprice)"),
    ("si", "sum(l_linenumber)", "cast(sum(l_linenumber) as bigint)"), ("cif", "count_if(l_quantity > 25)", "cast(count_if(l_quantity > 25) as bigint)"), ("ts", "try_sum(l_orderkey)", "cast(sum(l_orderkey) as bigint)"), ("ta", R("try_avg(l_quantity)"), R("avg(l_quantity)")),
    ("flt", "count(*) FILTER (WHERE l_tax > 0.04)"),
])
_grouped("agg_distinct", "orders", ["o_orderstatus"], [
    ("cd", "count(DISTINCT o_custkey)"), ("cd2", "count(DISTINCT o_custkey, o_orderpriority)", "count(DISTINCT (o_custkey, o_orderpriority))"), ("sd", "sum(DISTINCT o_custkey)", "cast(sum(DISTINCT o_custkey) as bigint)"),
    ("cs", "size(collect_set(o_orderpriority))", "cast(len(list(DISTINCT o_orderpriority)) as int)"), ("set_", "array_join(sort_array(collect_set(o_orderpriority)), ',')", "array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',')"),
])
# Lists are of small groups: a customer's orders.
_grouped("agg_by_order", "orders", ["o_custkey"], [
    ("mxb", "max_by(o_orderkey, struct(o_totalprice, o_orderkey))", "arg_max(o_orderkey, (o_totalprice, o_orderkey))"), ("mnb", "min_by(o_orderkey, struct(o_totalprice, o_orderkey))", "arg_min(o_orderkey, (o_totalprice, o_orderkey))"),
    ("mode_", "mode(o_custkey % 3 + o_orderkey * 0)", "mode(o_custkey % 3 + o_orderkey * 0)"), ("lst", "size(collect_list(o_orderkey))", "cast(len(list(o_orderkey)) as int)"), ("lst_", "array_join(slice(sort_array(collect_list(o_orderkey)), 1, 3), ',')", "array_to_string(list_sort(list(o_orderkey))[1:3], ',')"),
    ("agg_", "array_max(array_agg(o_orderkey))", "max(o_orderkey)"), ("la", "array_join(array_sort(transform(array_distinct(collect_list(o_orderstatus)), x -> lower(x))), '')", "array_to_string(list_sort(list(DISTINCT lower(o_orderstatus))), '')"),
])
_grouped("agg_bool_bits", "lineitem", ["l_linestatus"], [
    ("all_", "bool_and(l_quantity > 0)"), ("any_", "bool_or(l_tax > 0.079)"), ("ev", "every(l_quantity < 50)", "bool_and(l_quantity < 50)"), ("sm", "some(l_quantity < 2)", "bool_or(l_quantity < 2)"),
    ("ba", "bit_and(l_orderkey)"), ("bo", "bit_or(l_orderkey)"), ("bx", "bit_xor(l_orderkey)"),
    ("bm", "bitmap_count(bitmap_construct_agg(bitmap_bit_position(l_orderkey % 1000 + 1)))", "count(DISTINCT l_orderkey % 1000)"),
])
_grouped("agg_statistics", "lineitem", ["l_returnflag"], [
    ("sd", R("stddev(l_quantity)")), ("sds", R("stddev_samp(l_quantity)")), ("sdp", R("stddev_pop(l_quantity)")), ("st", R("std(l_quantity)"), R("stddev(l_quantity)")), ("va", R("variance(l_quantity)")), ("vs", R("var_samp(l_quantity)")), ("vp", R("var_pop(l_quantity)")),
    ("med", "median(l_quantity)"), ("p25", R("percentile(l_extendedprice, 0.25)"), R("quantile_cont(l_extendedprice, 0.25)")), ("ku", R("kurtosis(l_quantity)"), R("kurtosis_pop(l_quantity)")),
    ("sk", R("skewness(l_quantity)"), R("(avg(l_quantity * l_quantity * l_quantity) - 3 * avg(l_quantity) * avg(l_quantity * l_quantity) + 2 * avg(l_quantity) ** 3) / var_pop(l_quantity) ** 1.5")),
])
_grouped("agg_two_columns", "lineitem", ["l_returnflag"], [
    ("cp", R("covar_pop(l_quantity, l_extendedprice)", 3)), ("cs", R("covar_samp(l_quantity, l_extendedprice)", 3)), ("co", R("corr(l_quantity, l_extendedprice)")), ("rc", "regr_count(l_tax, l_quantity)", "cast(regr_count(l_tax, l_quantity) as bigint)"), ("rax", R("regr_avgx(l_tax, l_quantity)")), ("ray", R("regr_avgy(l_tax, l_quantity)")),
    ("rsx", R("regr_sxx(l_tax, l_quantity)", 3)), ("rsy", R("regr_syy(l_tax, l_quantity)", 3)), ("rxy", R("regr_sxy(l_tax, l_quantity)", 3)), ("rs", R("regr_slope(l_extendedprice, l_quantity)", 4)), ("ri", R("regr_intercept(l_extendedprice, l_quantity)", 4)), ("r2", R("regr_r2(l_extendedprice, l_quantity)")),
])
_grouped("agg_product", "lineitem", ["l_linenumber"], [("pr", R("exp(sum(ln(1 + l_tax)))", 4), R("exp(sum(ln(1 + l_tax)))", 4)), ("small", R("product(1 + l_tax / 1000)", 4), R("product(1 + l_tax / 1000)", 4))])
_grouped("agg_global", "orders", [], [("n", "count(*)"), ("total", R("sum(o_totalprice)", 2)), ("a", "any_value(1)", "1"), ("f", "min(o_orderdate)"), ("lt", "max(o_orderdate)"), ("none", "sum(CASE WHEN false THEN 1D END)", "cast(NULL as double)")])
_grouped("agg_null_groups", "customer", ["c_mktsegment"], [("n", "count(nullif(c_nationkey, 3))"), ("first_", "min(nullif(c_nationkey, 3))"), ("gone", "max(CASE WHEN false THEN c_name END)", "cast(NULL as varchar)")])
# Sketches: bounds are tested, not equal values.
_grouped("agg_approximate", "orders", ["o_orderstatus"], [("acd", "approx_count_distinct(o_custkey)", None), ("ap", "approx_percentile(o_totalprice, 0.5)"), ("pa", "percentile_approx(o_totalprice, array(0.25, 0.75))"), ("fi", "first(o_orderkey, true)"), ("la", "last(o_orderkey)"), ("hist", "histogram_numeric(o_totalprice, 5)")])
QUERIES["agg_product"] = ((lambda spark, sf_dir: read(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.round(F.exp(F.sum(F.log(1 + F.col("l_tax")))), 4).alias("pr"), F.round(F.product(1 + F.col("l_tax") / 1000), 4).alias("small"))), QUERIES["agg_product"][1])


@query("SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS gid, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All subsets of two keys."""
    return read(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_mktsegment, c_nationkey, grouping(c_nationkey)::TINYINT AS g, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes of two keys."""
    return read(spark, sf_dir, "customer").rollup("c_mktsegment", "c_nationkey").agg(F.grouping("c_nationkey").alias("g"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen subsets of keys."""
    df = read(spark, sf_dir, "lineitem")
    return df.groupingSets([[df.l_returnflag], [df.l_linestatus], []], df.l_returnflag, df.l_linestatus).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS "F", round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS "O" FROM orders GROUP BY 1""")
def agg_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivot on given values, so that no pass is needed to find them."""
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.round(F.sum("o_totalprice"), 2))


@query("""SELECT c_mktsegment, count(DISTINCT c_nationkey) FILTER (r = 0) AS "0_nations", max(c_acctbal) FILTER (r = 0) AS "0_best", count(DISTINCT c_nationkey) FILTER (r = 1) AS "1_nations", max(c_acctbal) FILTER (r = 1) AS "1_best"
    FROM (SELECT *, c_custkey % 2 AS r FROM customer) GROUP BY 1""")
def agg_pivot_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivot with several aggregates."""
    df = read(spark, sf_dir, "customer").withColumn("r", F.col("c_custkey") % 2)
    return df.groupBy("c_mktsegment").pivot("r", [0, 1]).agg(F.countDistinct("c_nationkey").alias("nations"), F.max("c_acctbal").alias("best"))


@query("SELECT year(o_orderdate)::INT AS y, o_totalprice > 100000 AS big, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 5")
def agg_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group by expressions, then filter groups."""
    return read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), (F.col("o_totalprice") > 100000).alias("big")).agg(F.count(F.lit(1)).alias("n")).filter("n > 5")


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def agg_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-step aggregation: a hot customer's rows are first summed in sixteen parts."""
    salted = read(spark, sf_dir, "orders").groupBy("o_custkey", F.pmod(F.xxhash64("o_orderkey"), F.lit(16)).alias("salt")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    return salted.groupBy("o_custkey").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("total"))
