"""Every catalog query against its DuckDB SQL, on the smallest tables."""

import inspect
import math
import os
import typing

import duckdb
import pytest
from pyspark.sql import functions
from pyspark.sql.pandas import functions as pandas_functions

from sparkloom import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    got = duck.execute(ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_scans_are_pruned_and_pushed_down(spark, sf_dir):
    plan = QUERIES["pricing_summary"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan
    assert "l_partkey" not in plan


def test_fixed_values(spark):
    row = spark.sql(
        """SELECT soundex('Robert') s, hash('a') h, xxhash64('a') x, crc32('abc') c, initcap('ab cd') i, mask('Ab1-') m, conv('255', 10, 16) v,
        months_between(DATE '2024-03-31', DATE '2024-02-29') mb, format_number(1234.5, 2) f, url_encode('a b') u, width_bucket(5.3, 0.2, 10.6, 5) w"""
    ).first()
    assert (row.s, row.h, row.c, row.i, row.m, row.v, row.mb, row.f, row.u, row.w) == ("R163", 1485273170, 891568578, "Ab Cd", "Xxn-", "FF", 1.0, "1,234.50", "a+b", 3)


def test_sketches_are_near(spark, sf_dir):
    rows = {r.o_orderstatus: r for r in QUERIES["agg_approximate"](spark, sf_dir).collect()}
    exact = {r.o_orderstatus: r for r in QUERIES["agg_distinct"](spark, sf_dir).collect()}
    assert all(abs(rows[k].acd - exact[k].cd) <= 0.15 * exact[k].cd + 2 for k in rows)


def test_samples_stay_in_bounds(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert 0.07 * n < QUERIES["sample_rows"](spark, sf_dir).count() < 0.13 * n
    parts = QUERIES["random_split"](spark, sf_dir).collect()
    assert sum(r.n for r in parts) == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


@pytest.mark.parametrize("name", ["udf_aggregate", "udf_apply_in_pandas", "udf_cogroup"])
def test_grouped_functions_are_called_for_blocks_of_orders(spark, tmp_path, monkeypatch, name):
    keys = [*range(3000), *range(2**60, 2**60 + 40), -1, -5000, None]
    lines = [(k, n, None if n == 2 or k == 7 else 10.0 + (37 * i + n) % 101) for i, k in enumerate(keys) for n in range(1, 2 + i % 4) if i % 9]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 100.0 + i) for i, k in enumerate(keys)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    calls = str(tmp_path / "calls")

    def counted(f):
        def one(v):
            with open(calls, "a") as out:
                out.write("x")
            return f(v)

        def two(a, b):
            with open(calls, "a") as out:
                out.write("x")
            return f(a, b)

        wrapped, hints = one if len(inspect.signature(f).parameters) == 1 else two, typing.get_type_hints(f)
        wrapped.__annotations__ = dict(zip([*inspect.signature(wrapped).parameters, "return"], hints.values()))
        return wrapped

    pandas_udf = functions.pandas_udf
    for module in (functions, pandas_functions):
        monkeypatch.setattr(module, "pandas_udf", lambda f, returnType, functionType=None: pandas_udf(counted(f), returnType, functionType))
    df = QUERIES[name](spark, str(tmp_path))
    ours = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = con.execute(ORACLE[name])
    assert [d[0] for d in got.description] == df.columns
    assert ours == sorted((tuple(map(plain, r)) for r in got.fetchall()), key=repr)
    assert 0 < os.path.getsize(calls) <= 8
