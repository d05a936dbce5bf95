"""Spark SQL text over temporary views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .common import Registry, read

QUERIES = Registry()
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def text(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    """Register a statement; both engines read the same text unless a second one is given.

    Views get names of their own for each run, so that queries over different
    directories don't meet.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        mark, sql = uuid.uuid4().hex[:8], spark_sql
        for t in TABLES:
            if f"{{{t}}}" in sql:
                read(spark, sf_dir, t).createOrReplaceTempView(f"{t}_{mark}")
                sql = sql.replace(f"{{{t}}}", f"{t}_{mark}")
        return spark.sql(sql)

    run.__doc__ = f"SQL: {spark_sql}"
    duck = duck_sql or spark_sql
    for t in TABLES:
        duck = duck.replace(f"{{{t}}}", t)
    QUERIES[name] = (run, duck)


text("sql_select", "SELECT c_custkey, upper(c_name) AS nm, c_acctbal * 2 AS twice FROM {customer} WHERE c_acctbal BETWEEN 0 AND 5000 AND c_mktsegment LIKE 'B%' AND c_nationkey IN (1, 2, 3)")
text("sql_no_from", "SELECT 1 AS a, 'x' AS b")
text("sql_distinct", "SELECT DISTINCT o_orderstatus FROM {orders}")
text("sql_derived", "SELECT t.k, count(*) AS n FROM (SELECT c_nationkey % 5 AS k FROM {customer}) t GROUP BY t.k")
text("sql_comma_join", "SELECT n.n_name, r.r_name FROM {nation} n, {region} r WHERE n.n_regionkey = r.r_regionkey")
text("sql_cte", "WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 200000), c AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT o_custkey, n FROM c WHERE n > 1")
text("sql_joins", "SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 100000 WHERE c.c_nationkey < 5")
text("sql_using", "SELECT a.n_nationkey, b.n_name FROM {nation} a JOIN {nation} b USING (n_nationkey)")
text("sql_semi", "SELECT c_custkey FROM {customer} LEFT SEMI JOIN {orders} ON c_custkey = o_custkey", "SELECT c_custkey FROM {customer} SEMI JOIN {orders} ON c_custkey = o_custkey")
text("sql_anti", "SELECT c_custkey FROM {customer} LEFT ANTI JOIN {orders} ON c_custkey = o_custkey", "SELECT c_custkey FROM {customer} ANTI JOIN {orders} ON c_custkey = o_custkey")
text("sql_scalar_subquery", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})")
text("sql_in_subquery", "SELECT c_custkey FROM {customer} WHERE c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 2)")
text("sql_exists", "SELECT s_suppkey FROM {supplier} s WHERE EXISTS (SELECT 1 FROM {customer} c WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal > 9000)")
text("sql_correlated", "SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders} WHERE o_custkey = c_custkey) AS best FROM {customer}")
text("sql_group_having", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS best FROM {orders} GROUP BY o_custkey HAVING count(*) > 10")
text("sql_group_ordinal", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY 1, 2")
text("sql_group_all", "SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY ALL")
text("sql_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
text("sql_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
text("sql_count_distinct", "SELECT count(DISTINCT o_custkey) AS n, count(o_custkey) AS m FROM {orders}")
text("sql_order_limit", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10 OFFSET 3")
text("sql_union", "SELECT n_regionkey AS k FROM {nation} UNION SELECT r_regionkey FROM {region} UNION ALL SELECT 99")
text("sql_except", "SELECT n_regionkey FROM {nation} EXCEPT SELECT r_regionkey FROM {region} WHERE r_regionkey > 2")
text("sql_intersect", "SELECT n_regionkey FROM {nation} INTERSECT SELECT r_regionkey FROM {region} WHERE r_regionkey > 2")
text("sql_window", "SELECT o_orderkey, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS int) AS rn, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS s FROM {orders}")
text("sql_case_cast", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'ok' END AS st, CAST(c_nationkey AS BIGINT) AS nk, TRY_CAST(c_name AS INT) AS bad FROM {customer}")
text("sql_strings", "SELECT p_partkey, substring(p_name, 1, 3) AS a, trim(p_brand) AS b, p_brand || '-' || p_type AS c, length(p_name) % 3 AS d FROM {part}", "SELECT p_partkey, substring(p_name, 1, 3) AS a, trim(p_brand) AS b, p_brand || '-' || p_type AS c, cast(length(p_name) % 3 AS int) AS d FROM {part}")
text("sql_interval", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL '3' MONTH AS DATE) AS later FROM {orders}")
text("sql_lateral", "SELECT n.n_nationkey, t.v FROM {nation} n, LATERAL (SELECT n.n_regionkey * 2 AS v) t")
text("sql_values", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y')) AS t(a, b)")
text("sql_pivot", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM {orders}) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o))", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM {orders} GROUP BY 1")
# Whole cents and hundredths add up exactly, in whatever order.
text("sql_tpch_q10", "SELECT c_custkey, c_name, n_name, cast(sum(cast(round(l_extendedprice * 100) AS bigint) * cast(round((1 - l_discount) * 100) AS bigint)) AS double) / 10000 AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {nation} ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name")
text("sql_tpch_q12", "SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY l_linestatus", "SELECT l_linestatus, cast(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS bigint) AS high, cast(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS bigint) AS low FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY l_linestatus")
text("sql_tpch_q14", "SELECT round(100.0D * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0D END) / sum(l_extendedprice * (1 - l_discount)), 4) AS promo FROM {lineitem} JOIN {part} ON l_partkey = p_partkey", "SELECT round(100.0::DOUBLE * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 4) AS promo FROM {lineitem} JOIN {part} ON l_partkey = p_partkey")
text("sql_tpch_q18", "SELECT o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS q FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 180) GROUP BY o_orderkey, o_totalprice")
