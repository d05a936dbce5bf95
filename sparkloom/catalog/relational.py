"""Projections, filters, joins and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frame
from .common import Registry, read

QUERIES = Registry()
query = QUERIES.query


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
    round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
    round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty,
    round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by return flag and line status."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    total = lambda c: F.round(F.sum(c), 2)
    return (
        read(spark, sf_dir, "lineitem")
        .filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(total(F.col("l_quantity")).alias("sum_qty"), total(F.col("l_extendedprice")).alias("sum_base_price"), total(net).alias("sum_disc_price"), total(net * (1 + F.col("l_tax"))).alias("sum_charge"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 6).alias("avg_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"))
    )


@query("""SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer
    JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def shipping_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten unshipped orders of most revenue."""
    at = F.lit("1995-03-15").cast("timestamp_ntz")
    customer = read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = read(spark, sf_dir, "orders").filter(F.col("o_orderdate") < at).select("o_orderkey", "o_custkey", "o_orderdate")
    items = read(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") > at)
    joined = customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).join(items, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer
    JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def local_supplier_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation where customer and supplier share it."""
    t = lambda n: read(spark, sf_dir, n)
    nations = t("nation").join(t("region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    supplier = t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    joined = t("lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07
    AND l_quantity < 24 AND year(l_shipdate) = 1994""")
def forecast_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of a year's discounted small orders."""
    kept = read(spark, sf_dir, "lineitem").filter("l_discount BETWEEN 0.05D AND 0.07D AND l_quantity < 24 AND l_shipdate >= TIMESTAMP_NTZ '1994-01-01' AND l_shipdate < TIMESTAMP_NTZ '1995-01-01'")
    return kept.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem
    WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority""")
def order_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a large item, by priority."""
    large = read(spark, sf_dir, "lineitem").filter("l_quantity > 45")
    return read(spark, sf_dir, "orders").join(large, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT o_custkey % 1000 AS grp, o_orderkey AS id, o_totalprice AS value FROM orders),
    a AS (SELECT grp, count(*) AS cnt, round(sum(value), 2) AS total, round(avg(value), 6) AS mean FROM g GROUP BY grp)
    SELECT grp, id, value, cnt, total, mean FROM g JOIN a USING (grp)""")
def grouped_join_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published five-step workload: aggregate by group, join back, sort."""
    g = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 1000).alias("grp"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    a = g.groupBy("grp").agg(F.count(F.lit(1)).alias("cnt"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 6).alias("mean"))
    return g.join(a, "grp").orderBy("grp", "id")


# ---- projections and filters
@query("SELECT c_custkey, c_name, c_acctbal * 2 AS doubled, 'x' AS tag, c_mktsegment AS segment FROM customer WHERE c_acctbal > 1000 AND (c_nationkey = 3 OR c_mktsegment LIKE 'B%') AND NOT c_custkey % 2 = 0")
def select_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, expressions, renames and a compound predicate."""
    df = read(spark, sf_dir, "customer").filter((F.col("c_acctbal") > 1000) & ((F.col("c_nationkey") == 3) | F.col("c_mktsegment").like("B%")) & ~(F.col("c_custkey") % 2 == 0))
    return df.select("c_custkey", "c_name", (F.col("c_acctbal") * 2).alias("doubled"), F.lit("x").alias("tag"), "c_mktsegment").withColumnRenamed("c_mktsegment", "segment")


@query("SELECT c_custkey AS id, upper(c_name) AS nm, c_nationkey + 1 AS nk, round(c_acctbal, 0) AS bal FROM customer")
def with_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """withColumns, withColumnsRenamed, drop and selectExpr in one chain."""
    df = read(spark, sf_dir, "customer").withColumns({"nm": F.upper("c_name"), "nk": F.col("c_nationkey") + 1}).drop("c_name", "c_nationkey", "absent")
    return df.withColumnsRenamed({"c_custkey": "id"}).selectExpr("id", "nm", "nk", "round(c_acctbal, 0) AS bal")


@query("SELECT p_name AS a, p_brand AS b FROM part")
def to_df_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by name pattern, then all renamed."""
    return read(spark, sf_dir, "part").select(*frame.columns_like(read(spark, sf_dir, "part"), "p_(name|brand)")).toDF("a", "b")


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'n/a') AS status, coalesce(CASE WHEN o_totalprice > 100000 THEN o_totalprice END, 0) AS price FROM orders")
def fill_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """na.fill with a value for each column."""
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("status"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"))
    return df.na.fill({"status": "n/a", "price": 0.0})


@query("SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status FROM orders WHERE o_orderstatus <> 'O'")
def drop_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """na.drop over a subset."""
    return read(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("status")).na.drop(how="any", subset=["status"])


@query("""WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS a, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS b FROM customer)
    SELECT * FROM t WHERE (c_custkey IS NOT NULL)::INT + (a IS NOT NULL)::INT + (b IS NOT NULL)::INT >= 2""")
def drop_nulls_thresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """na.drop with a least number of values."""
    df = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("a"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("b"))
    return df.na.drop(thresh=2)


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' ELSE o_orderstatus END AS status FROM orders")
def replace_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """na.replace of several values."""
    return read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")).na.replace({"O": "open", "F": "final"}, subset=["status"])


@query("SELECT s_suppkey, s.name AS name, s.nation + 1 AS next_nation, s.name AS nm2 FROM (SELECT s_suppkey, {'name': s_name, 'nation': s_nationkey} AS s FROM supplier)")
def struct_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Struct fields by dotted name, getField and withField."""
    df = read(spark, sf_dir, "supplier").select("s_suppkey", F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).alias("s"))
    df = df.withColumn("s", F.col("s").withField("next", F.col("s.nation") + 1))
    return df.select("s_suppkey", "s.name", F.col("s.next").alias("next_nation"), F.col("s").getField("name").alias("nm2"))


# ---- joins
SIDES = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}


def _outer(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = read(spark, sf_dir, "customer").filter("c_nationkey < 15").select("c_custkey", "c_nationkey")
        n = read(spark, sf_dir, "nation").filter("n_nationkey > 5").select("n_nationkey", "n_name")
        return c.join(n, c.c_nationkey == n.n_nationkey, how)

    run.__doc__ = f"{how} join on keys of different names; unmatched rows have nulls."
    sql = f"SELECT c_custkey, c_nationkey, n_nationkey, n_name FROM (SELECT * FROM customer WHERE c_nationkey < 15) {SIDES[how]} (SELECT * FROM nation WHERE n_nationkey > 5) ON c_nationkey = n_nationkey"
    QUERIES[f"join_{how}"] = (run, sql)


for _how in SIDES:
    _outer(_how)


@query("SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left semi join."""
    n = read(spark, sf_dir, "nation").filter("n_regionkey = 1")
    c = read(spark, sf_dir, "customer")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left_semi")


@query("SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left anti join."""
    o = read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross join of two tables of fixed size, within the row-product budget."""
    return frame.cross_join(read(spark, sf_dir, "region").select("r_name"), read(spark, sf_dir, "nation").select("n_name"))


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linenumber = o_orderkey % 7")
def join_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join on two keys, one of them computed."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 7).cast("int").alias("l_linenumber"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(o, ["l_orderkey", "l_linenumber"])


@query("""SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 48""")
def join_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join with a residual condition; unmatched orders stay."""
    o, i = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return o.join(i, (o.o_orderkey == i.l_orderkey) & (i.l_quantity > 48), "left").select("o_orderkey", "l_linenumber")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
def join_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self join with aliases, an equality and an inequality."""
    n = read(spark, sf_dir, "nation")
    return n.alias("a").join(n.alias("b"), (F.col("a.n_nationkey") < F.col("b.n_nationkey")) & (F.col("a.n_regionkey") == F.col("b.n_regionkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("SELECT r_name, n_name FROM region LEFT JOIN nation ON n_nationkey > r_regionkey * 6")
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join without an equality, refused beyond the row-product budget."""
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    return frame.theta_join(r, n, n.n_nationkey > r.r_regionkey * 6, "left").select("r_name", "n_name")


@query("SELECT a.c_custkey AS a, b.s_suppkey AS b FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer WHERE c_custkey < 100) a JOIN (SELECT s_suppkey, nullif(s_nationkey, 3) AS k FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null keys that match each other."""
    a = read(spark, sf_dir, "customer").filter("c_custkey < 100").selectExpr("c_custkey AS a", "nullif(c_nationkey, 3) AS k")
    b = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS b", "nullif(s_nationkey, 3) AS k")
    return a.join(b, a.k.eqNullSafe(b.k)).select("a", "b")


@query("SELECT c_custkey, name, name_right FROM (SELECT c_custkey, c_nationkey AS k, c_name AS name FROM customer) JOIN (SELECT n_nationkey, n_name AS name_right FROM nation) ON k = n_nationkey")
def join_suffixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of different names, and a name on both sides."""
    c = read(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey AS k", "c_name AS name")
    n = read(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_name AS name")
    return frame.join_with_keys(c, n, ["k"], ["n_nationkey"]).select("c_custkey", "name", "name_right")


@query("""SELECT event_id, user_id, ts, (SELECT max(ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'click' AND p.ts <= e.ts) AS last_click FROM events e WHERE event_type = 'purchase'""")
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click at or before each purchase of a user."""
    e = read(spark, sf_dir, "events")
    return frame.as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'click'").select("user_id", "ts"), "user_id", "ts", "last_click")


# ---- set operations
A, B = "SELECT n_regionkey AS k FROM nation WHERE n_nationkey < 18", "SELECT n_regionkey AS k FROM nation WHERE n_nationkey > 10 AND n_regionkey <> 2"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = read(spark, sf_dir, "nation")
    return n.filter("n_nationkey < 18").selectExpr("n_regionkey AS k"), n.filter("n_nationkey > 10 AND n_regionkey <> 2").selectExpr("n_regionkey AS k")


for _name, _sql, _call in (
    ("set_union", f"{A} UNION ALL {B}", lambda a, b: a.union(b)),
    ("set_union_distinct", f"{A} UNION {B}", lambda a, b: a.union(b).distinct()),
    ("set_subtract", f"{A} EXCEPT {B}", lambda a, b: a.subtract(b)),
    ("set_except_all", f"{A} EXCEPT ALL {B}", lambda a, b: a.exceptAll(b)),
    ("set_intersect", f"{A} INTERSECT {B}", lambda a, b: a.intersect(b)),
    ("set_intersect_all", f"{A} INTERSECT ALL {B}", lambda a, b: a.intersectAll(b)),
):
    QUERIES[_name] = ((lambda call: lambda spark, sf_dir: call(*_sides(spark, sf_dir)))(_call), _sql)


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal, NULL::BIGINT AS extra FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_suppkey * 2 FROM supplier")
def set_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union by name with columns that one side lacks."""
    a = read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS bal")
    b = read(spark, sf_dir, "supplier").selectExpr("s_name AS name", "s_suppkey AS id", "s_suppkey * 2 AS extra")
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def set_union_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union that aligns equal sets of names."""
    return frame.union_aligned(read(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "n_name AS name"), read(spark, sf_dir, "region").selectExpr("r_name AS name", "r_regionkey AS id"))


# ---- sort, limit, top-k, dedupe
@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest orders."""
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 5 LIMIT 7")
def offset_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skip, then take."""
    return read(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").offset(5).limit(7)


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer ORDER BY seg DESC NULLS FIRST, c_custkey LIMIT 15")
def sort_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descending with nulls first."""
    return read(spark, sf_dir, "customer").selectExpr("c_custkey", "nullif(c_mktsegment, 'BUILDING') AS seg").orderBy(F.desc_nulls_first("seg"), "c_custkey").limit(15)


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer ORDER BY seg ASC NULLS LAST, c_custkey DESC LIMIT 15")
def sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ascending with nulls last."""
    return read(spark, sf_dir, "customer").selectExpr("c_custkey", "nullif(c_mktsegment, 'BUILDING') AS seg").orderBy(F.asc_nulls_last("seg"), F.desc("c_custkey")).limit(15)


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs."""
    return read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT c_nationkey, min(c_custkey) AS first_key FROM customer GROUP BY c_nationkey")
def dedupe_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One defined row per key: a window would do too, but the least key needs no sort."""
    return read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("first_key"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)")
def drop_duplicates_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dropDuplicates over a subset, counted."""
    return read(spark, sf_dir, "customer").dropDuplicates(["c_nationkey", "c_mktsegment"]).agg(F.count(F.lit(1)).alias("n"))


# ---- shape and statistics
@query("SELECT c_custkey, 'c_nationkey' AS variable, c_nationkey::DOUBLE AS value FROM customer UNION ALL SELECT c_custkey, 'c_acctbal', c_acctbal FROM customer")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide to long."""
    df = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("c_nationkey"), "c_acctbal")
    return df.unpivot(["c_custkey"], ["c_nationkey", "c_acctbal"], "variable", "value")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY 1, 2")
def crosstab_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of pairs, a row each."""
    return frame.crosstab_long(read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("""SELECT o_orderstatus AS o_orderstatus_o_orderpriority, count(*) FILTER (o_orderpriority = '1-URGENT') AS "1-URGENT", count(*) FILTER (o_orderpriority = '2-HIGH') AS "2-HIGH",
    count(*) FILTER (o_orderpriority = '3-MEDIUM') AS "3-MEDIUM", count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS "4-NOT SPECIFIED", count(*) FILTER (o_orderpriority = '5-LOW') AS "5-LOW" FROM orders GROUP BY 1""")
def crosstab_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of pairs as a matrix."""
    return read(spark, sf_dir, "orders").crosstab("o_orderstatus", "o_orderpriority")


@query("""SELECT 'l_quantity' AS a, 'l_tax' AS b, round(corr(l_quantity, l_tax), 6) AS corr FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_quantity', round(corr(l_extendedprice, l_quantity), 6) FROM lineitem
    UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6) FROM lineitem""")
def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation matrix of numeric columns in one pass, upper half."""
    df = read(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", "l_tax")
    return frame.correlations(df).filter("a < b").withColumn("corr", F.round("corr", 6))


@query("""SELECT 0.1::DOUBLE AS p, quantile_cont(l_quantity, 0.1) AS value FROM lineitem UNION ALL
    SELECT 0.5::DOUBLE, quantile_cont(l_quantity, 0.5) FROM lineitem UNION ALL SELECT 0.9::DOUBLE, quantile_cont(l_quantity, 0.9) FROM lineitem""")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated quantiles, as rows."""
    return frame.exact_quantiles(read(spark, sf_dir, "lineitem"), "l_quantity", [0.1, 0.5, 0.9])


@query("SELECT l_linenumber AS value FROM lineitem GROUP BY l_linenumber HAVING count(*) >= 0.15 * (SELECT count(*) FROM lineitem)")
def frequent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that make up a share of all rows, exactly."""
    return frame.frequent(read(spark, sf_dir, "lineitem"), "l_linenumber", 0.15)


@query("""SELECT 'count' AS summary, cast(count(c_nationkey) AS VARCHAR) AS c_nationkey, cast(count(c_name) AS VARCHAR) AS c_name FROM customer
    UNION ALL SELECT 'min', cast(min(c_nationkey) AS VARCHAR), min(c_name) FROM customer UNION ALL SELECT 'max', cast(max(c_nationkey) AS VARCHAR), max(c_name) FROM customer""")
def describe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """describe(), without the rows whose digits depend on summation order."""
    return read(spark, sf_dir, "customer").describe("c_nationkey", "c_name").filter("summary IN ('count', 'min', 'max')")


@query()
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded Bernoulli sample."""
    return read(spark, sf_dir, "lineitem").sample(False, 0.1, seed=7)


@query()
def sample_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded stratified sample."""
    return read(spark, sf_dir, "orders").sampleBy("o_orderstatus", {"F": 0.2, "O": 0.1}, seed=7)


@query()
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of a seeded split; they add up to the table."""
    parts = read(spark, sf_dir, "orders").randomSplit([0.7, 0.3], seed=7)
    sizes = [p.agg(F.lit(k).alias("part"), F.count(F.lit(1)).alias("n")) for k, p in enumerate(parts)]
    return sizes[0].union(sizes[1])
