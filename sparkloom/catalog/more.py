"""Functions and plan forms beyond the other modules: dates and times, rounding, null orderings, hints, windows, SQL forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import plans
from ..operators.frame import broadcast_within, join_typed
from .common import Registry, read

QUERIES = Registry()
query = QUERIES.query
P = QUERIES.projection

TS = "cast(o_orderdate as timestamp)"
P("datetime_parse", "orders", ["o_orderkey"], [
    ("ts", "cast(to_timestamp(date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')) as timestamp_ntz)", "cast(o_orderdate as timestamp)"),
    ("ts_f", "cast(to_timestamp(date_format(o_orderdate, 'dd/MM/yyyy HH.mm'), 'dd/MM/yyyy HH.mm') as timestamp_ntz)", "cast(o_orderdate as timestamp)"),
    ("ltz", "cast(to_timestamp_ltz(date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')) as timestamp_ntz)", "cast(o_orderdate as timestamp)"),
    ("tryts", "cast(try_to_timestamp(concat(o_orderstatus, date_format(o_orderdate, 'yyyy-MM-dd'))) as timestamp_ntz)", "try_cast(concat(o_orderstatus, strftime(o_orderdate, '%Y-%m-%d')) as timestamp)"),
    ("td", "to_date(date_format(o_orderdate, 'yyyy-MM-dd'))", "cast(o_orderdate as date)"),
    ("td_f", "to_date(date_format(o_orderdate, 'dd.MM.yyyy'), 'dd.MM.yyyy')", "cast(o_orderdate as date)"),
    ("ux", "to_unix_timestamp(date_format(o_orderdate, 'yyyy-MM-dd'), 'yyyy-MM-dd')", "cast(epoch(o_orderdate) as bigint)"),
])
P("datetime_make", "orders", ["o_orderkey"], [
    ("mts", "cast(make_timestamp(1990 + cast(o_orderkey % 10 as int), 1 + cast(o_orderkey % 12 as int), 3, 4, 5, 6.5) as timestamp_ntz)", "make_timestamp(1990 + o_orderkey % 10, 1 + o_orderkey % 12, 3, 4, 5, 6.5)"),
    ("mntz", "make_timestamp_ntz(1990 + cast(o_orderkey % 10 as int), 2, 3, cast(o_orderkey % 24 as int), 5, 6.0)", "make_timestamp(1990 + o_orderkey % 10, 2, 3, o_orderkey % 24, 5, 6.0)"),
    ("iv", f"cast({TS} + make_interval(0, cast(o_orderkey % 5 as int), 0, 2, 3, 0, 0) as timestamp_ntz)", "cast(o_orderdate as timestamp) + to_months(cast(o_orderkey % 5 as int)) + INTERVAL 2 DAY + INTERVAL 3 HOUR"),
    ("dti", f"cast({TS} + make_dt_interval(1, cast(o_orderkey % 24 as int), 0, 0) as timestamp_ntz)", "cast(o_orderdate as timestamp) + INTERVAL 1 DAY + to_hours(cast(o_orderkey % 24 as int))"),
    ("ymi", "cast(o_orderdate as date) + make_ym_interval(1, cast(o_orderkey % 12 as int))", "cast(cast(o_orderdate as date) + to_months(cast(12 + o_orderkey % 12 as int)) as date)"),
    ("da", "dateadd(cast(o_orderdate as date), cast(o_orderkey % 30 as int))", "cast(o_orderdate as date) + cast(o_orderkey % 30 as int)"),
    ("dp", "datepart('DAY', o_orderdate)", "cast(day(o_orderdate) as int)"),
    ("hrs", f"cast({TS} + make_interval(0, 0, 0, 0, cast(o_orderkey % 7 as int), cast(o_orderkey % 50 as int)) as timestamp_ntz)", "cast(o_orderdate as timestamp) + to_hours(cast(o_orderkey % 7 as int)) + to_minutes(cast(o_orderkey % 50 as int))"),
])
P("datetime_zones", "events", ["event_id"], [
    ("tokyo", "cast(from_utc_timestamp(ts, 'Asia/Tokyo') as timestamp_ntz)", "ts + INTERVAL 9 HOUR"), ("utc", "cast(to_utc_timestamp(ts, 'Asia/Tokyo') as timestamp_ntz)", "ts - INTERVAL 9 HOUR"),
    ("conv", "convert_timezone('UTC', 'Asia/Tokyo', cast(ts as timestamp_ntz))", "ts + INTERVAL 9 HOUR"),
    ("mb", "cast(round(months_between(add_months(cast(ts as date), 7), cast(ts as date))) as int)", "7"),
])
P("rounding", "lineitem", ["l_orderkey", "l_linenumber"], [
    ("br", "bround(l_linenumber / 2D, 0)", "round_even(l_linenumber / 2, 0)"), ("rh", "round(l_linenumber / 2D, 0)", "round(l_linenumber / 2, 0)"),
    ("cg", "ceiling(l_quantity / 3)", "cast(ceil(l_quantity / 3) as bigint)"), ("ch", "char(65 + l_linenumber)", "chr(cast(65 + l_linenumber as int))"),
])
P("string_columns", "part", ["p_partkey"], [
    ("idx", "substring_index(p_type, ' ', 2)", "array_to_string(string_split(p_type, ' ')[1:2], ' ')"), ("idx_neg", "substring_index(p_type, ' ', -1)", "string_split(p_type, ' ')[-1]"),
    ("in_set", "find_in_set(p_brand, concat('Brand#11,', p_brand))", "CASE WHEN p_brand = 'Brand#11' THEN 1 ELSE 2 END"),
    ("q", "parse_url(concat('http://h/p?q=', p_partkey, '&r=', p_size), 'QUERY', 'r')", "cast(p_size as varchar)"),
    ("ud", "url_decode(concat(replace(p_type, ' ', '%20'), '%2F'))", "concat(p_type, '/')"), ("ue", "url_encode(p_type)", "replace(url_encode(p_type), '%20', '+')"),
    ("cap", "initcap(p_type)", "array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"),
    ("msk", "mask(p_brand)", "regexp_replace(regexp_replace(regexp_replace(p_brand, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g')"),
    ("cnv", "conv(cast(p_partkey as string), 10, 16)", "to_hex(p_partkey)"), ("num", "format_number(p_retailprice, 2)", "format('{:,.2f}', p_retailprice)"),
    ("ri", "regexp_instr(p_name, 'e')", "cast(instr(p_name, 'e') as int)"), ("rs", "regexp_substr(p_name, 'e.')", "nullif(regexp_extract(p_name, 'e.', 0), '')"),
    ("aes", "cast(aes_decrypt(aes_encrypt(p_name, '0123456789abcdef'), '0123456789abcdef') as string)", "p_name"),
    ("tn", "to_number(cast(p_size as string), '99')", "cast(p_size as decimal(2,0))"), ("tc", "trim(to_char(p_size, '999'))", "cast(p_size as varchar)"),
    ("ttn", "try_to_number(p_brand, '99')", "cast(NULL as decimal(2,0))"), ("tb", "cast(to_binary(p_name, 'utf-8') as string)", "p_name"), ("ttb", "try_to_binary(p_brand, 'hex')", "cast(NULL as blob)"),
])


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE <= current_date")
def clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clock's functions agree with each other within a statement."""
    now = F.current_timestamp()
    same = (F.curdate() == F.to_date(now)) & (F.localtimestamp() == now.cast("timestamp_ntz")) & (F.unix_timestamp() == now.cast("long")) & (F.current_user() == F.user()) & (F.length(F.version()) > 0)
    return read(spark, sf_dir, "orders").filter(same & (F.to_date("o_orderdate") <= F.curdate())).select("o_orderkey")


_NULLED = "CASE WHEN c_acctbal > 5000 THEN NULL ELSE c_acctbal END"


@query(f"SELECT c_custkey, row_number() OVER (ORDER BY {_NULLED} ASC NULLS FIRST, c_custkey)::INT AS rn FROM customer QUALIFY rn <= 50")
def sort_asc_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty, nulls ahead, as a limit that keeps fifty rows a task."""
    top = read(spark, sf_dir, "customer").select("c_custkey", F.expr(_NULLED).alias("v")).orderBy(F.col("v").asc_nulls_first(), "c_custkey").limit(50)
    return top.select("c_custkey", F.row_number().over(Window.orderBy(F.col("v").asc_nulls_first(), "c_custkey")).alias("rn"))


@query(f"SELECT c_custkey, row_number() OVER (ORDER BY {_NULLED} DESC NULLS LAST, c_custkey)::INT AS rn FROM customer QUALIFY rn <= 50")
def sort_desc_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty, nulls behind."""
    top = read(spark, sf_dir, "customer").select("c_custkey", F.expr(_NULLED).alias("v")).orderBy(F.col("v").desc_nulls_last(), "c_custkey").limit(50)
    return top.select("c_custkey", F.row_number().over(Window.orderBy(F.col("v").desc_nulls_last(), "c_custkey")).alias("rn"))


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A broadcast whose size was checked; a larger side would be dealt by key."""
    small = broadcast_within(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return read(spark, sf_dir, "customer").join(small, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_key_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of different types are brought to one type before the join, so that it stays an equi join on plain columns."""
    text = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_name")
    return join_typed(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey"), text, "key").select("o_orderkey", "c_name")


@query("SELECT o_orderkey, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS lv, (SELECT count(DISTINCT x.o_orderpriority) FROM orders x WHERE x.o_custkey = o.o_custkey) AS kinds FROM orders o")
def window_last_and_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """last_value under the default frame is the row's own; distinct values of a partition, of which there are few."""
    w = Window.partitionBy("o_custkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.last_value("o_orderkey").over(w.orderBy("o_orderdate", "o_orderkey")).alias("lv"), F.size(F.collect_set("o_orderpriority").over(w)).cast("bigint").alias("kinds"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC LIMIT 3")
def sql_hidden_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order by an aggregate that is not selected."""
    v = f"v_{uuid.uuid4().hex[:12]}"
    read(spark, sf_dir, "orders").createOrReplaceTempView(v)
    return spark.sql(f"SELECT o_orderpriority, count(*) AS n FROM {v} GROUP BY o_orderpriority ORDER BY sum(o_totalprice) DESC LIMIT 3")


@query("SELECT 'orders' AS what, 1 + 1 AS two, count(*) AS n, max(o_orderkey) AS last_key FROM orders")
def sql_mixed_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals beside aggregates without GROUP BY."""
    v = f"v_{uuid.uuid4().hex[:12]}"
    read(spark, sf_dir, "orders").createOrReplaceTempView(v)
    return spark.sql(f"SELECT 'orders' AS what, 1 + 1 AS two, count(*) AS n, max(o_orderkey) AS last_key FROM {v}")


@query("SELECT l_linestatus, count(DISTINCT l_orderkey % 1000) AS n FROM lineitem GROUP BY 1")
def agg_bitmap_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmaps of parts of a group, joined: distinct counts that can be added up."""
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(F.col("l_orderkey") % 1000 + 1)).alias("bits")
    parts = read(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_linenumber").agg(bits)
    return parts.groupBy("l_linestatus").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 200000")
def partitions_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt by ranges of a key and sorted within partitions, with counts observed on the way."""
    df = read(spark, sf_dir, "orders").observe(Observation(f"o_{uuid.uuid4().hex[:8]}"), F.count(F.lit(1)).alias("rows"))
    return df.filter("o_totalprice > 200000").select("o_custkey", "o_orderkey").repartitionByRange(4, "o_custkey").sortWithinPartitions("o_custkey", "o_orderkey")


@query("SELECT n_nationkey, struct_pack(name := n_name, region := n_regionkey + 1)['region'] AS region, n_name AS name FROM nation")
def transform_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transform() of a frame, with a struct's field replaced."""
    def packed(df: DataFrame) -> DataFrame:
        return df.select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("s"))

    def raised(df: DataFrame, by: int) -> DataFrame:
        return df.withColumn("s", F.col("s").withField("region", F.col("s.region") + by))

    return read(spark, sf_dir, "nation").transform(packed).transform(raised, 1).select("n_nationkey", "s.region", "s.name")


@query("SELECT 'count' AS summary, count(p_size)::VARCHAR AS p_size FROM part UNION ALL SELECT 'min', min(p_size)::VARCHAR FROM part UNION ALL SELECT 'max', max(p_size)::VARCHAR FROM part")
def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """summary() of chosen statistics."""
    return read(spark, sf_dir, "part").select("p_size").summary("count", "min", "max")


@query("SELECT round(covar_samp(l_quantity, l_extendedprice), 3) AS cov, true AS near FROM lineitem")
def stat_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance, and an approximate median within its error of the exact one."""
    df = read(spark, sf_dir, "lineitem")
    return df.agg(F.round(F.covar_samp("l_quantity", "l_extendedprice"), 3).alias("cov"), (F.abs(F.approx_percentile("l_quantity", 0.5) - F.median("l_quantity")) <= 1).alias("near"))


@query("SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n, grouping_id(o_orderpriority, o_orderstatus)::BIGINT AS level FROM orders WHERE o_orderkey % 2 = 0 GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def plan_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query kept as data: filter, cube and names, one DataFrame call for each step."""
    steps = [
        {"op": "filter", "expr": "o_orderkey % 2 = 0"},
        {"op": "group", "kind": "cube", "by": ["o_orderpriority", "o_orderstatus"], "aggs": {"n": "count(*)", "level": "grouping_id()"}},
        {"op": "rename", "names": {"o_orderpriority": "priority", "o_orderstatus": "status"}},
    ]
    return plans.apply(read(spark, sf_dir, "orders"), steps)


@query("SELECT n_name, r_name, n_regionkey * 10 + 1 AS code FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 20")
def plan_join_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query kept as data with a join and a function registered by name; Python sees batches, not rows."""
    name = f"coded_{uuid.uuid4().hex[:8]}"
    spark.udf.register(name, F.pandas_udf(lambda x: x * 10 + 1, "long"))
    steps = [
        {"op": "filter", "expr": "n_nationkey < 20"},
        {"op": "join", "with": "region", "on": "n_regionkey = r_regionkey"},
        {"op": "select", "exprs": ["n_name", "r_name", f"{name}(n_regionkey) AS code"]},
    ]
    return plans.apply(read(spark, sf_dir, "nation"), steps, {"region": read(spark, sf_dir, "region")})
