"""Window functions: ranking, analytic, running and framed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Registry, read

QUERIES = Registry()
query = QUERIES.query


def _by_customer():
    """A customer's orders by date; made when a session is there."""
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


@query("""SELECT o_orderkey, cast(row_number() OVER w AS int) AS rn, cast(rank() OVER v AS int) AS rk, cast(dense_rank() OVER v AS int) AS dr, round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd, cast(ntile(3) OVER w AS int) AS nt
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def window_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking functions, with ties in the second window."""
    ties = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(_by_customer()).alias("rn"), F.rank().over(ties).alias("rk"), F.dense_rank().over(ties).alias("dr"), F.round(F.percent_rank().over(ties), 6).alias("pr"), F.round(F.cume_dist().over(ties), 6).alias("cd"), F.ntile(3).over(_by_customer()).alias("nt"))


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS lg, lag(o_orderkey, 2, -1) OVER w AS lg2, lead(o_orderkey) OVER w AS ld, lead(o_orderkey, 1, 0) OVER w AS ld0,
    first_value(o_orderkey) OVER w AS fv, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv, nth_value(o_orderkey, 2) OVER w AS nv
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_analytic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours, first, last and nth values."""
    w, all_ = _by_customer(), _by_customer().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k = "o_orderkey"
    return read(spark, sf_dir, "orders").select(k, F.lag(k).over(w).alias("lg"), F.lag(k, 2, -1).over(w).alias("lg2"), F.lead(k).over(w).alias("ld"), F.lead(k, 1, 0).over(w).alias("ld0"), F.first(k).over(w).alias("fv"), F.last(k).over(all_).alias("lv"), F.nth_value(k, 2).over(w).alias("nv"))


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS s, count(*) OVER w AS n, round(avg(o_totalprice) OVER w, 4) AS a, min(o_totalprice) OVER w AS lo, max(o_totalprice) OVER w AS hi FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running aggregates."""
    p = "o_totalprice"
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sum(p).over(_by_customer()), 2).alias("s"), F.count(F.lit(1)).over(_by_customer()).alias("n"), F.round(F.avg(p).over(_by_customer()), 4).alias("a"), F.min(p).over(_by_customer()).alias("lo"), F.max(p).over(_by_customer()).alias("hi"))


@query("""SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS n, cast(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS bigint) AS s FROM orders""")
def window_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default frame takes in the peers of a tie."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.count(F.lit(1)).over(w).alias("n"), F.sum("o_orderkey").over(w).alias("s"))


@query("""SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS back, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 3 FOLLOWING) AS around,
    count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS ahead, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS near FROM orders""")
def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROWS frames to both sides and a RANGE frame."""
    w = _by_customer()
    near = Window.partitionBy("o_custkey").orderBy("o_orderkey").rangeBetween(-500, 500)
    p = "o_totalprice"
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(F.avg(p).over(w.rowsBetween(-2, 0)), 4).alias("back"), F.max(p).over(w.rowsBetween(-1, 3)).alias("around"), F.count(F.lit(1)).over(w.rowsBetween(1, 2)).alias("ahead"), F.count(F.lit(1)).over(near).alias("near"))


@query("SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS n, round(c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS share FROM customer")
def window_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-partition aggregates and a ratio to them, as an aggregation and a join.

    A window would deal a nation's rows to one task; there are only a few nations.
    """
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    sums = rows.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("total"))
    same = rows.c_nationkey.eqNullSafe(sums.c_nationkey)
    return rows.join(sums, same).select("c_custkey", "n", F.round(F.col("c_acctbal") / F.col("total"), 6).alias("share"))


@query("SELECT s_suppkey, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier")
def window_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a window without an order."""
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.count(F.lit(1)).over(Window.partitionBy("s_nationkey")).alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2")
def window_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two largest orders of each customer; Spark limits groups before the shuffle."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).filter("rn <= 2").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_click FROM events")
def window_ignore_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value that isn't null."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w).alias("last_click"))


@query("""WITH t AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM t) SELECT user_id, cast(session AS bigint) AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2""")
def window_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by gaps of more than thirty minutes, in one shuffle by user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce((F.col("ts") - F.lag("ts").over(w)) <= F.expr("INTERVAL '30' MINUTE"), F.lit(False))
    rows = read(spark, sf_dir, "events").withColumn("new", F.when(gap, 0).otherwise(1)).withColumn("session", F.sum("new").over(w))
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows by type."""
    return read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
