"""Rows, files, tables and views as sources, and statements that define and change tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..sources import Files, capped_range, single_column, working_folder
from .common import Registry, read

QUERIES = Registry()
query = QUERIES.query

REGIONS = "SELECT r_regionkey, r_name FROM region"
NATIONS = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


def _name(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex[:12]}"


@query(f"{NATIONS} WHERE n_regionkey < 3")
def rows_of_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from tuples with a schema text; the table is small and of fixed size."""
    rows = [tuple(r) for r in _nations(spark, sf_dir).collect()]
    return spark.createDataFrame(rows, "n_nationkey long, n_name string, n_regionkey long").filter("n_regionkey < 3")


@query("SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_regionkey > 0 THEN n_regionkey END AS region FROM nation")
def rows_of_dicts_and_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from rows by name, types inferred from those that have a value."""
    rows = [Row(id=r[0], name=r[1], region=r[2] or None) for r in _nations(spark, sf_dir).collect()]
    return spark.createDataFrame(rows)


@query(NATIONS)
def rows_of_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame from pandas, through Arrow."""
    return spark.createDataFrame(_nations(spark, sf_dir).toPandas())


@query("SELECT n_name AS value, length(n_name) AS n FROM nation")
def rows_of_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unnamed column from a generator."""
    return single_column(spark, (r[1] for r in _nations(spark, sf_dir).collect()), "string").withColumn("n", F.length("value").cast("bigint"))


@query("SELECT range AS id, range * range AS square FROM range(3, 50, 7)")
def rows_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capped range."""
    return capped_range(spark, 3, 50, 7).select("id", (F.col("id") * F.col("id")).alias("square"))


def _round_trip(kind: str, sql: str, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files, name = Files(spark, working_folder(spark)), _name(kind)
        df = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("decimal(12,2)").alias("c_acctbal"))
        files.write(df, name, kind, **options)
        schema = "c_custkey long, c_name string, c_mktsegment string, c_acctbal decimal(12,2)"
        back = {"csv": lambda: files.csv(name, schema, **options), "json": lambda: files.json(name, schema), "orc": lambda: files.load(name, "orc")}[kind]()
        return back.filter("c_acctbal > 0").select("c_custkey", "c_name", "c_mktsegment")

    run.__name__, run.__doc__ = f"files_{kind}", f"Write {kind} and read it back; the filter reaches the scan."
    QUERIES[run.__name__] = (run, sql)


for _kind, _options in {"csv": {"header": "true", "sep": "|"}, "json": {}, "orc": {}}.items():
    _round_trip(_kind, "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal::DECIMAL(12,2) > 0", **_options)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def files_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders by value; reading one value lists and scans its folder only."""
    files, name = Files(spark, working_folder(spark)), _name("parts")
    files.write(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), name, partition_by=("o_orderstatus",))
    return files.parquet(name).filter("o_orderstatus = 'F'")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def files_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text out and in."""
    path = f"{working_folder(spark)}/{_name('text')}"
    read(spark, sf_dir, "part").select("p_brand").write.text(path)
    return spark.read.text(path).groupBy(F.col("value").alias("p_brand")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def table_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """saveAsTable with options, append and read by name."""
    name, folder = _name("saved"), working_folder(spark)
    df = _nations(spark, sf_dir)
    for part, mode in (("n_regionkey < 2", "overwrite"), ("n_regionkey >= 2", "append")):
        df.filter(part).write.mode(mode).option("compression", "zstd").option("path", f"{folder}/{name}").saveAsTable(name)
    return spark.table(name).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT a.n_name, b.r_name FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey WHERE b.r_name LIKE 'A%'")  # noqa: F541
def views_temp_and_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view of the session and one of all sessions, joined."""
    mine, everyone = _name("v"), _name("g")
    _nations(spark, sf_dir).createOrReplaceTempView(mine)
    read(spark, sf_dir, "region").createOrReplaceGlobalTempView(everyone)
    return spark.sql(f"SELECT a.n_name, b.r_name FROM {mine} a JOIN global_temp.{everyone} b ON a.n_regionkey = b.r_regionkey WHERE b.r_name LIKE 'A%'")


@query("SELECT r_regionkey AS id, r_name AS name, NULL::VARCHAR AS note FROM region UNION ALL SELECT 100, 'extra', 'by value' UNION ALL SELECT 101, 'more', NULL")
def sql_create_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE with columns; INSERT of values and of a query, with and without a column list."""
    t, v = _name("t"), _name("v")
    read(spark, sf_dir, "region").createOrReplaceTempView(v)
    spark.sql(f"CREATE TABLE {t} (id BIGINT, name STRING, note STRING) USING parquet LOCATION '{working_folder(spark)}/{t}'")
    spark.sql(f"INSERT INTO {t} VALUES (100, 'extra', 'by value')")
    spark.sql(f"INSERT INTO {t} (name, id) VALUES ('more', 101)")
    spark.sql(f"INSERT INTO {t} (id, name) SELECT r_regionkey, r_name FROM {v}")
    return spark.table(t)


@query("SELECT n_regionkey, min(n_name) AS first_name, count(*) AS n FROM nation GROUP BY 1")
def sql_create_as_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE ... AS SELECT in a schema of its own."""
    s, v = _name("s"), _name("v")
    folder = working_folder(spark)
    _nations(spark, sf_dir).createOrReplaceTempView(v)
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {s} LOCATION '{folder}/{s}'")
    spark.sql(f"CREATE TABLE {s}.t USING parquet AS SELECT n_regionkey, min(n_name) AS first_name, count(*) AS n FROM {v} GROUP BY n_regionkey")
    return spark.table(f"{s}.t")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN upper(n_name) || '!' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 2 THEN 20 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_regionkey <> 3")
def sql_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPDATE and DELETE on files: the changed rows replace the table, as plain formats have no row-level changes.

    The new rows are written beside the old ones before they replace them, so a
    lost executor leaves either table whole.
    """
    old, new = _name("t"), _name("t")
    folder = working_folder(spark)
    _nations(spark, sf_dir).write.option("path", f"{folder}/{old}").saveAsTable(old)
    spark.sql(f"""CREATE TABLE {new} USING parquet LOCATION '{folder}/{new}' AS SELECT n_nationkey, if(n_regionkey <=> 2, upper(n_name) || '!', n_name) AS n_name,
        if(n_regionkey <=> 2, 20, n_regionkey) AS n_regionkey FROM {old} WHERE NOT (n_regionkey <=> 3)""")
    spark.sql(f"DROP TABLE {old}")
    return spark.table(new)


@query("SELECT 'default' AS database, true AS listed, 'id' AS col, 'bigint' AS kind")
def sql_show_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHOW DATABASES, SHOW TABLES and DESCRIBE as frames."""
    t = _name("t")
    spark.sql(f"CREATE TABLE {t} (id BIGINT) USING parquet LOCATION '{working_folder(spark)}/{t}'")
    found = spark.sql("SHOW TABLES IN default").agg(F.bool_or(F.col("tableName") == t).alias("listed"))
    described = spark.sql(f"DESCRIBE {t}").filter("col_name = 'id'").select(F.col("col_name").alias("col"), F.col("data_type").alias("kind"))
    return spark.sql("SHOW DATABASES").filter("namespace = 'default'").select(F.col("namespace").alias("database")).crossJoin(found).crossJoin(described)


@query("SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS total FROM part GROUP BY 1")
def rows_of_pandas_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many pandas frames made in tasks, not on the driver."""
    def sums(batches):
        for batch in batches:
            yield batch.groupby("p_brand", as_index=False).agg(n=("p_size", "size"), total=("p_size", "sum")).astype({"n": "int64", "total": "int64"}) if len(batch) else pd.DataFrame({"p_brand": [], "n": [], "total": []})

    parts = read(spark, sf_dir, "part").select("p_brand", "p_size").mapInPandas(sums, "p_brand string, n long, total long")
    return parts.groupBy("p_brand").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
