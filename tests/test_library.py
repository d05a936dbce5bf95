"""Frame operators, functions, sources, plans, streaming, sessions, comparison."""

import os
import random
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from sparkloom import compare, functions, plans, sources, streaming
from sparkloom import session as sessions
from sparkloom.operators import frame


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_cross_budget(spark):
    a, b = spark.range(100), spark.range(50).toDF("x")
    assert frame.cross_join(a, b, 5000).count() == 5000
    with pytest.raises(ValueError, match="more than 4999"):
        frame.cross_join(a, b, 4999)
    with pytest.raises(ValueError):
        frame.theta_join(a, b, a.id > b.x, budget=10)


@pytest.mark.parametrize("how,n", [("inner", 1), ("left", 2), ("left_semi", 1), ("left_anti", 1), ("full", 3)])
def test_theta_join_keeps_its_form(spark, how, n):
    a, b = spark.createDataFrame([(1,), (5,)], "a int"), spark.createDataFrame([(3,), (9,)], "b int")
    assert frame.theta_join(a, b, a.a > b.b, how).count() == n


def test_join_with_keys_suffixes(spark):
    a = spark.createDataFrame([(1, "x", "l")], "k int, v string, v_right string")
    b = spark.createDataFrame([(1, "y")], "j int, v string")
    assert frame.join_with_keys(a, b, ["k"], ["j"]).columns == ["k", "v", "v_right", "j", "v_right_right"]


def test_as_of_ties_and_gaps(spark):
    a = spark.createDataFrame([(1, 5, "p"), (1, 1, "q"), (2, 9, "r"), (None, 3, "s")], "k int, t int, n string")
    b = spark.createDataFrame([(1, 5), (1, 4), (2, 10), (None, 2)], "k int, t int")
    assert rows(frame.as_of(a, b, "k", "t", "last").select("n", "last")) == [("p", 5), ("q", None), ("r", None), ("s", 2)]


def test_union_aligned(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([("y", 2)], "s string, i int")
    assert rows(frame.union_aligned(a, b)) == [(1, "x"), (2, "y")]


def test_describe_and_exact_sample(spark):
    df = spark.range(10)
    text = {r.summary: r.id for r in frame.describe_rounded(df, "id").collect()}
    assert text["mean"] == "4.5" and text["stddev"] == "3.0" and text["count"] == "10"
    assert frame.sample_exact(df, 0.35, 1).count() == 4


def test_empty_frames(spark):
    empty = spark.createDataFrame([], "a int, b double")
    assert frame.crosstab_long(empty, "a", "b").count() == 0
    assert frame.frequent(empty, "a", 0.1).count() == 0
    assert frame.exact_quantiles(empty, "b", [0.5]).first().value is None
    assert frame.correlations(empty).filter("a = 'a' AND b = 'b'").first()["corr"] is None


def test_functions(spark):
    df = spark.createDataFrame([([1, None, 3], [9, 8, 7], {"a": 1, "b": 5}, {"b": None, "c": 2}, 12, 10)], "x array<int>, y array<int>, m map<string,int>, n map<string,int>, i int, j int")
    got = df.select(
        functions.array_sum("x").alias("s"), functions.array_mean("x").alias("a"), functions.zip_with_coalesce("x", "y").alias("z"), functions.map_filter_value_gt("m", 2).alias("f"), functions.map_zip_with_coalesce("m", "n").alias("mz"),
        functions.map_get("m", "zz").alias("g"), functions.bitwise("i", "and", "j").alias("ba"), functions.bitwise("i", "xor", "j").alias("bx"), functions.replace_many(F.lit("abc"), [("a", "b"), ("b", "x")]).alias("r"), (F.lit("2024-01-31").cast("date") + functions.months(1)).alias("mo"),
    ).first()
    assert (got.s, got.a, got.z, got.f, got.mz, got.g, got.ba, got.bx, got.r, str(got.mo)) == (4.0, 2.0, [1, 8, 3], {"b": 5}, {"a": 1, "b": 5, "c": 2}, None, 8, 6, "xxc", "2024-02-29")


def test_path_confinement():
    assert sources.confine("a/b.csv", "/data") == "/data/a/b.csv"
    assert sources.confine("file:///data/x", "file:///data") == "file:///data/x"
    for bad in ("/etc/passwd", "../x", "/data/../etc", "s3://other/x", "/database/x"):
        with pytest.raises(sources.PathNotAllowed):
            sources.confine(bad, "/data")


def test_files_round_trip(spark, tmp_path):
    files = sources.Files(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, 2.5), (2, "c", None)], "k int, s string, d double")
    for kind in ("parquet", "json", "csv", "orc"):
        files.write(df, f"out.{kind}", kind, **({"header": "true"} if kind == "csv" else {}))
        assert compare.equal(files.load(f"out.{kind}").select("k", "s", "d").withColumn("k", F.col("k").cast("int")), df)
    files.write(df, "parts", partition_by=("k",))
    assert {p.name for p in (tmp_path / "parts").iterdir() if p.is_dir()} == {"k=1", "k=2"}
    assert files.csv("out.csv", "k INT, s STRING, d DOUBLE").schema["d"].dataType.simpleString() == "double"


def test_tables_and_views(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    spark.range(3).write.mode("overwrite").saveAsTable("shop.t")
    spark.sql("INSERT INTO shop.t VALUES (9)")
    assert spark.table("shop.t").count() == 4 and spark.catalog.tableExists("shop.t")
    spark.range(2).createOrReplaceTempView("v")
    spark.range(5).createOrReplaceGlobalTempView("g")
    assert spark.table("v").count() == 2 and spark.table("global_temp.g").count() == 5
    assert [r.col_name for r in spark.sql("DESCRIBE shop.t").collect()] == ["id"]
    spark.sql("DROP TABLE shop.t")
    spark.sql("DROP DATABASE shop")


def test_jdbc_options():
    j = sources.Jdbc("jdbc:postgresql://u:p@h/db?password=x", {"user": "u"})
    assert j.options(dbtable="t")["dbtable"] == "t" and "p@" not in str(j) and "=x" not in str(j)
    with pytest.raises(PermissionError):
        j.options(query="SELECT 1")
    with pytest.raises(ValueError):
        j.options(dbtable="t", partitionColumn="id")
    assert sources.Jdbc("u", trust_sql=True).options(query="SELECT 1")["query"] == "SELECT 1"
    assert sources.delta_options(3) == {"versionAsOf": "3"}
    with pytest.raises(ValueError):
        sources.delta_options(1, "2024-01-01")


def test_range_cap(spark):
    assert sources.capped_range(spark, 0, 10, 3).count() == 4
    with pytest.raises(ValueError):
        sources.capped_range(spark, 0, 100, cap=99)


def test_plan_steps(spark, sf_dir):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    steps = [
        {"op": "filter", "expr": "o_totalprice > 1000"},
        {"op": "join", "with": "customer", "on": "o_custkey = c_custkey", "how": "left"},
        {"op": "window", "name": "rn", "expr": "row_number()", "partition_by": ["c_nationkey"], "order_by": [{"expr": "o_totalprice", "desc": True}, "o_orderkey"]},
        {"op": "filter", "expr": "rn <= 3"},
        {"op": "group", "by": ["c_mktsegment"], "aggs": {"n": "count(1)", "best": "max(o_totalprice)"}},
        {"op": "orderBy", "keys": ["c_mktsegment"]},
    ]
    got = plans.apply(t("orders"), steps, {"customer": t("customer")})
    t("orders").createOrReplaceTempView("po")
    t("customer").createOrReplaceTempView("pc")
    want = spark.sql("SELECT c_mktsegment, count(1) n, max(o_totalprice) best FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) rn FROM po LEFT JOIN pc ON o_custkey = c_custkey WHERE o_totalprice > 1000) WHERE rn <= 3 GROUP BY 1")
    assert compare.equal(got, want)
    with pytest.raises(ValueError, match="step 0: unknown"):
        plans.apply(t("orders"), [{"op": "nope"}])
    with pytest.raises(ValueError, match="missing 'expr'"):
        plans.apply(t("orders"), [{"op": "filter"}])


def test_plan_small_steps(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5), (2, "b", 5)], "k int, s string, v int")
    steps = [{"op": "fillna", "values": {"v": 0}}, {"op": "distinct"}, {"op": "withColumn", "name": "w", "expr": "v + k"}, {"op": "rename", "names": {"s": "t"}}, {"op": "drop", "columns": ["v"]}, {"op": "replace", "values": {"a": "z"}, "subset": ["t"]}]
    assert rows(plans.apply(df, steps)) == [(1, "z", 1), (2, "b", 7)]
    assert plans.apply(df, [{"op": "unpivot", "ids": ["s"], "values": ["k", "v"]}, {"op": "dropna"}]).count() == 5
    assert plans.apply(df, [{"op": "explode", "name": "e", "expr": "sequence(1, k)"}]).count() == 5


def test_streams_match_batch(spark, sf_dir, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    spark.read.parquet(f"{sf_dir}/events.parquet").write.mode("overwrite").parquet(str(source / "x"))
    events = streaming.stream(spark, str(source / "x"))
    for name, call, mode in (("w", streaming.windowed, "complete"), ("s", streaming.sessions, "append"), ("o", streaming.once, "append")):
        batch = call(spark.read.parquet(str(source / "x")).withColumn("ts", F.col("ts").cast("timestamp")))
        if mode == "append":
            streaming.drain(call(events), str(tmp_path / name), str(tmp_path / f"cp{name}"))
            got = spark.read.parquet(str(tmp_path / name))
            extra = compare.difference(got, batch).filter("left_rows > right_rows").count()
            assert got.count() > 0 and extra == 0
        else:
            q = call(events).writeStream.outputMode(mode).format("memory").queryName("w_out").option("checkpointLocation", str(tmp_path / "cpw")).trigger(availableNow=True).start()
            q.awaitTermination()
            assert compare.equal(spark.table("w_out"), batch)


def test_profiles(spark):
    try:
        sessions.apply_profile(spark, "3.5")
        assert spark.sql("SELECT CAST('abc' AS INT) x").first().x is None
        assert spark.sql("SELECT map_concat(map(1, 2), map(1, 3)) m").first().m == {1: 3}
        sessions.apply_profile(spark, "4.0")
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            spark.sql("SELECT CAST('abc' AS INT) x").collect()
    finally:
        sessions.apply_profile(spark, "4.0")


def test_compare(spark):
    a = spark.createDataFrame([(1, 0.1 + 0.2, [1]), (1, 0.3, [1]), (None, None, None)], "k int, v double, a array<int>")
    b = spark.createDataFrame([(None, None, None), (1, 0.3, [1]), (1, 0.3, [1])], "k int, v double, a array<int>")
    assert compare.equal(a, b.select("v", "a", "k"))
    assert [r.left_rows for r in compare.difference(a.limit(1), b).collect()] != []
    with pytest.raises(ValueError):
        compare.difference(a, b.drop("v"))


def test_udfs(spark):
    import pandas as pd

    plus = F.udf(lambda x: None if x is None else x + 1, "int")
    twice = F.pandas_udf(lambda s: s * 2, "long")
    spark.udf.register("plus", plus)
    assert spark.range(3).select(twice("id").alias("x")).agg(F.sum("x")).first()[0] == 6
    assert spark.sql("SELECT plus(4) AS x").first().x == 5
    mean = spark.range(6).withColumn("g", F.col("id") % 2).groupBy("g").applyInPandas(lambda d: pd.DataFrame({"g": [d.g.iloc[0]], "m": [d.id.mean()]}), "g long, m double")
    assert rows(mean) == [(0, 2.0), (1, 3.0)]


def test_entry_has_sql_only_for_its_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_the_corpus(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/sparkloom", tmp_path / "sparkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 150 and 'pipeline' not in n and not [k for k in n if k.startswith('op')], n; assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_entry_imports_without_a_session():
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=repo, check=True, timeout=120)


def test_inspection_and_statistics(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert df.dtypes[0] == ("l_orderkey", "bigint") and df.schema["l_tax"].dataType.simpleString() == "double"
    assert len(df.inputFiles()) == 1 and df.sameSemantics(df.select("*")) and not df.isEmpty()
    assert abs(df.stat.corr("l_quantity", "l_extendedprice")) <= 1 and df.stat.cov("l_quantity", "l_quantity") > 0
    low, high = df.approxQuantile("l_quantity", [0.1, 0.9], 0.01)
    assert low < high
    assert df.select("l_linenumber").freqItems(["l_linenumber"], 0.1).count() == 1
    assert {r.summary for r in df.select("l_tax").summary().collect()} == {"count", "mean", "stddev", "min", "25%", "50%", "75%", "max"}
    few = df.orderBy("l_orderkey", "l_linenumber")
    assert few.head(2) == few.take(2) and len(few.limit(5).toJSON().collect() if hasattr(few, "toJSON") else []) == 5 and len(few.limit(9).tail(3)) == 3
    kept = df.select("l_orderkey").checkpoint()
    assert kept.count() == df.cache().count() and df.unpersist() is not None


def test_errors_are_raised(spark):
    with pytest.raises(Exception, match="wrong"):
        spark.range(1).select(F.raise_error(F.lit("wrong"))).collect()
    with pytest.raises(Exception, match="not so"):
        spark.range(1).select(F.assert_true(F.lit(False), "not so")).collect()
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        spark.range(1).filter("missing > 1").collect()


def test_exact_quantiles_of_skewed_and_empty_columns(spark):
    rng = random.Random(3)
    values = [1.0] * 500 + [rng.gauss(0, 1) for _ in range(777)] + [None] * 9
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.p: r.value for r in frame.exact_quantiles(df, "v", [0.0, 0.1, 0.33, 0.5, 0.999, 1.0]).collect()}
    known = sorted(v for v in values if v is not None)
    for p, v in got.items():
        at = p * (len(known) - 1)
        low, high = known[int(at)], known[min(len(known) - 1, int(at) + 1)]
        assert v == pytest.approx(low + (high - low) * (at - int(at)))
    assert {r.value for r in frame.exact_quantiles(df.filter("v IS NULL"), "v", [0.5]).collect()} == {None}


@pytest.mark.parametrize("rows,share", [(1000, 0.3), (7, 1.0), (50, 0.0)])
def test_exact_samples_have_their_size(spark, rows, share):
    df = spark.createDataFrame([(k, k % 3) for k in range(rows)] + [(-1, 0)] * 200, "a int, b int")
    got = frame.sample_exact(df, share, 5).collect()
    assert len(got) == round((rows + 200) * share)
    assert sorted(got) == sorted(frame.sample_exact(df.repartition(7), share, 5).collect())


def test_broadcasts_are_checked(spark):
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    df = spark.range(1000)
    assert "broadcast" in plan(frame.broadcast_within(df)) and "broadcast" not in plan(frame.broadcast_within(df, most_rows=10)) + plan(frame.broadcast_within(df, most_bytes=10))


def test_join_of_key_types(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, p string"), spark.createDataFrame([("1", "u"), ("02", "v"), (None, "w")], "k string, q string")
    assert [tuple(r) for r in frame.join_typed(a, b, "k").collect()] == [("1", "x", "u")]
    assert frame.join_typed(a, b.select(F.expr("try_cast(k AS bigint)").alias("k"), "q"), "k").schema["k"].dataType.simpleString() == "bigint"


def test_unknown_forms_are_refused(spark):
    a = spark.range(2)
    with pytest.raises(Exception, match="(?i)join type"):
        a.join(a.withColumnRenamed("id", "other"), F.col("id") == F.col("other"), "sideways").collect()
    with pytest.raises(Exception, match="wrong"):
        a.select(F.raise_error(F.lit("wrong"))).collect()


def test_working_folder_needs_the_setting_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        conf, sparkContext = type("Conf", (), {"get": staticmethod(lambda key, default: default)}), Context()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sources.working_folder(Session())
