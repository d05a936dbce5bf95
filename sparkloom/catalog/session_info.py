"""Functions of the session, of partitions and of chance; most have no counterpart in SQL elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Registry, read

QUERIES = Registry()
query = QUERIES.query


@query("SELECT 'spark_catalog' AS cat, 'default' AS db, 'default' AS sch, 'bigint' AS t1, 'string' AS t2, 'array<int>' AS t3, true AS dated, NULL::INTEGER AS checked")
def session_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog, database and types by name; assert_true() on a true condition."""
    one = spark.range(1)
    return one.select(F.current_catalog().alias("cat"), F.current_database().alias("db"), F.current_schema().alias("sch"), F.typeof("id").alias("t1"), F.typeof(F.lit("x")).alias("t2"), F.typeof(F.array(F.lit(1))).alias("t3"), (F.to_date(F.now()) == F.current_date()).alias("dated"), F.assert_true(F.lit(True)).cast("int").alias("checked"))


@query("SELECT count(*) AS n, count(DISTINCT c_custkey) AS ids, true AS in_parts, true AS in_files FROM customer")
def partition_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row identifiers are distinct; every row knows its partition and file."""
    df = read(spark, sf_dir, "customer").select(F.monotonically_increasing_id().alias("i"), F.spark_partition_id().alias("p"), F.input_file_name().alias("f"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("i").alias("ids"), F.bool_and(F.col("p") >= 0).alias("in_parts"), F.bool_and(F.col("f").endswith(".parquet")).alias("in_files"))


@query("SELECT count(*) AS n, true AS uniform, true AS normal, true AS shuffled FROM customer")
def random_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded random numbers stay in their bounds; a shuffled array keeps its values."""
    df = read(spark, sf_dir, "customer").select(F.rand(1).alias("u"), F.randn(1).alias("g"), F.shuffle(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(5)).alias("s"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("u") >= 0) & (F.col("u") < 1)).alias("uniform"), (F.abs(F.avg("g")) < 0.5).alias("normal"), F.bool_and(F.array_sort("s") == F.array(F.lit(1), F.lit(2), F.lit(3))).alias("shuffled"))


@query("SELECT p_partkey, NULL::INTEGER AS pos, NULL::VARCHAR AS v FROM part WHERE p_size <= 25 UNION ALL SELECT p_partkey, 0, p_brand FROM part WHERE p_size > 25")
def posexplode_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and values, with a row of nulls for a null array."""
    return read(spark, sf_dir, "part").select("p_partkey", F.posexplode_outer(F.when(F.col("p_size") > 25, F.array("p_brand"))).alias("pos", "v"))


@query("SELECT p_partkey, NULL::VARCHAR AS b, NULL::INTEGER AS s FROM part WHERE p_size <= 25 UNION ALL SELECT p_partkey, p_brand, p_size FROM part WHERE p_size > 25")
def inline_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structs as columns, with a row of nulls for a null array."""
    return read(spark, sf_dir, "part").select("p_partkey", F.inline_outer(F.when(F.col("p_size") > 25, F.array(F.struct(F.col("p_brand").alias("b"), F.col("p_size").alias("s"))))))


@query("SELECT l_linenumber, cast(sum(l_orderkey) AS bigint) AS total FROM lineitem GROUP BY 1")
def hinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A physical hint on the result: rows are summed in part before the shuffle, and the few sums are put together in even files."""
    return read(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.sum("l_orderkey").alias("total")).hint("rebalance")
