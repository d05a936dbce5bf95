"""User-defined functions: scalar, vectorised, by group, by batch, as tables and by name in SQL.

Built-in functions are the fast path; these show the ways out of them.  All
move Arrow batches.  A call for each order costs about a millisecond however
few its lines are, so functions over groups are called for a block of
neighbouring order keys, and pandas groups the rows within it.  A block has at
most as many orders as keys, which bounds what a call holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Registry, read

QUERIES = Registry()
query = QUERIES.query

#: A block is the keys that differ in these low bits alone: 4096 of them.
BLOCK_BITS = 12


def block_of(key: str) -> Column:
    """Number of the block of a whole-number key; null keys have a block of their own."""
    return F.shiftright(key, BLOCK_BITS)


def _mirrored(s: str | None) -> str | None:
    return None if s is None else s[::-1].upper()


@query("SELECT p_partkey, upper(reverse(p_name)) AS mirrored FROM part")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function of a value, in Arrow batches; nulls stay null."""
    return read(spark, sf_dir, "part").select("p_partkey", F.udf(_mirrored, "string", useArrow=True)("p_name").alias("mirrored"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def udf_vectorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of whole pandas columns."""

    def net(price: pd.Series, discount: pd.Series) -> pd.Series:
        return price * (1 - discount)

    call = F.pandas_udf(net, "double")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(call("l_extendedprice", "l_discount"), 4).alias("net"))


@query("SELECT p_partkey, p_brand || ':' || p_size AS label FROM part")
def udf_iterator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of a stream of batches, which can set up once what all of them need."""

    def label(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for brand, size in batches:
            yield brand + ":" + size.astype(str)

    return read(spark, sf_dir, "part").select("p_partkey", F.pandas_udf(label, "string")("p_brand", "p_size").alias("label"))


@query("SELECT c_custkey FROM customer WHERE length(c_name) % 5 > 2 AND c_acctbal > 0")
def udf_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison with a function's result; the plain half of the predicate is still pushed down."""
    rest = F.udf(lambda s: len(s) % 5, "int", useArrow=True)
    return read(spark, sf_dir, "customer").filter((rest("c_name") > 2) & (F.col("c_acctbal") > 0)).select("c_custkey")


@query("SELECT n_regionkey, max(upper(reverse(n_name))) AS last_name, count(*) AS n FROM nation WHERE upper(reverse(n_name)) > 'B' GROUP BY n_regionkey HAVING max(upper(reverse(n_name))) > 'C'")
def udf_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function by name in SQL: in SELECT, WHERE and HAVING."""
    name = f"mirrored_{uuid.uuid4().hex[:8]}"
    spark.udf.register(name, F.udf(_mirrored, "string", useArrow=True))
    return spark.sql(f"SELECT n_regionkey, max({name}(n_name)) AS last_name, count(*) AS n FROM {{nation}} WHERE {name}(n_name) > 'B' GROUP BY n_regionkey HAVING max({name}(n_name)) > 'C'", nation=read(spark, sf_dir, "nation"))


@query("SELECT n_nationkey, upper(reverse(n_name)) AS mirrored FROM nation")
def udf_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered function called by name from the DataFrame side."""
    name = f"mirrored_{uuid.uuid4().hex[:8]}"
    spark.udf.register(name, F.udf(_mirrored, "string", useArrow=True))
    return read(spark, sf_dir, "nation").select("n_nationkey", F.call_function(name, "n_name").alias("mirrored"))


@query("SELECT l_orderkey, round(max(l_extendedprice) - min(l_extendedprice), 2) AS spread FROM lineitem GROUP BY l_orderkey")
def udf_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate of pandas columns over a block of orders, whose result is a list with a value for each order."""

    def spreads(key: pd.Series, price: pd.Series) -> list:
        by = price.groupby(key, dropna=False)
        found = by.max() - by.min()
        keys = found.index.astype(object).where(found.index.notna(), None)
        return [{"l_orderkey": k, "spread": v} for k, v in zip(keys, found.astype(object).where(found.notna(), None))]

    call = F.pandas_udf(spreads, "array<struct<l_orderkey: long, spread: double>>")
    blocks = read(spark, sf_dir, "lineitem").groupBy(block_of("l_orderkey")).agg(call("l_orderkey", "l_extendedprice").alias("spreads"))
    return blocks.select(F.inline("spreads")).select("l_orderkey", F.round("spread", 2).alias("spread"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem")
def udf_apply_in_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a block of orders as a pandas frame, each line against the total of its order."""

    def share(rows: pd.DataFrame) -> pd.DataFrame:
        price = rows["l_extendedprice"]
        return rows[["l_orderkey", "l_linenumber"]].assign(share=price / price.groupby(rows["l_orderkey"], dropna=False).transform("sum"))

    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = lines.groupBy(block_of("l_orderkey")).applyInPandas(share, "l_orderkey long, l_linenumber int, share double")
    return out.withColumn("share", F.round("share", 6))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders")
def udf_cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of orders and the lines of that block side by side, as two pandas frames."""

    def both(orders: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        count = lines["l_orderkey"].value_counts()
        return orders.assign(lines=orders["o_orderkey"].map(count).fillna(0).astype("int64"))

    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("price"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey")
    return orders.groupBy(block_of("o_orderkey")).cogroup(lines.groupBy(block_of("l_orderkey"))).applyInPandas(both, "o_orderkey long, price double, lines long")


@query("SELECT event_id, event_type || '!' AS loud FROM events WHERE value > 50")
def udf_map_in_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of rows to batches of rows, of other number and columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = batch[batch["value"] > 50]
            yield pd.DataFrame({"event_id": kept["event_id"], "loud": kept["event_type"] + "!"})

    return read(spark, sf_dir, "events").select("event_id", "event_type", "value").mapInPandas(run, "event_id long, loud string")


class _Words:
    """Table function: a row for each word of a text."""

    def eval(self, text: str):
        for k, word in enumerate((text or "").split(" ")):
            yield k, word


@query("SELECT p_partkey, cast(i - 1 AS int) AS pos, string_split(p_name, ' ')[i] AS word FROM (SELECT *, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)")
def udf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function joined laterally to each row."""
    name = f"words_{uuid.uuid4().hex[:8]}"
    spark.udtf.register(name, F.udtf(_Words, returnType="pos int, word string"))
    return spark.sql(f"SELECT p_partkey, w.pos, w.word FROM {{part}}, LATERAL {name}(p_name) w", part=read(spark, sf_dir, "part"))
