"""Arrays, maps, structs, generators and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Registry, read

QUERIES = Registry()
query, P = QUERIES.query, QUERIES.projection
J = lambda x: f"array_join({x}, ',')"
K = lambda x: f"array_to_string({x}, ',')"
SA, SB = "split(p_name, ' ')", "split(p_type, ' ')"
DA, DB = "string_split(p_name, ' ')", "string_split(p_type, ' ')"
A, DU = "array(p_size, 3, p_size % 5, 3)", "[p_size, 3, p_size % 5, 3]"

P("array_basic", "part", ["p_partkey"], [
    ("sz", f"size({SA})", f"cast(len({DA}) as int)"), ("car", f"cardinality({SA})", f"cast(len({DA}) as int)"), ("asz", f"array_size({SA})", f"cast(len({DA}) as int)"), ("has", f"array_contains({A}, 3)", f"list_contains({DU}, 3)"), ("jn", f"array_join({SB}, '-')", f"array_to_string({DB}, '-')"),
    ("mx", f"array_max({A})", f"list_max({DU})"), ("mn", f"array_min({A})", f"list_min({DU})"), ("at", f"element_at({A}, 2)", "3"), ("at_last", f"element_at({A}, -1)", "3"), ("at_none", f"try_element_at({A}, 9)", "cast(NULL as int)"), ("gt", f"get({A}, 0)", "p_size"), ("gi", f"{A}[1]", "3"),
    ("srt", J(f"array_sort({A})"), K(f"list_sort({DU})")), ("srd", J(f"sort_array({A}, false)"), K(f"list_reverse_sort({DU})")), ("dst", J(f"array_sort(array_distinct({A}))"), K(f"list_sort(list_distinct({DU}))")), ("slc", J(f"slice({A}, 2, 2)"), K(f"{DU}[2:3]")), ("pos", f"array_position({A}, 3)", f"cast(list_position({DU}, 3) as bigint)"),
    ("cmp", J("array_compact(array(p_size, null, 1))"), "concat(p_size, ',1')"), ("rmv", J(f"array_remove({A}, 3)"), K(f"list_filter({DU}, lambda x: x <> 3)")), ("rpt", J("array_repeat(p_size, 3)"), K("[p_size, p_size, p_size]")), ("flt", J(f"flatten(array({A}, array(1)))"), K(f"flatten([{DU}, [1]])")),
    ("app", J(f"array_append({A}, 9)"), K(f"list_append({DU}, 9)")), ("pre", J(f"array_prepend({A}, 9)"), K(f"list_prepend(9, {DU})")), ("ins", J(f"array_insert({A}, 2, 8)"), K("[p_size, 8, 3, p_size % 5, 3]")), ("rv", J(f"reverse({A})"), K(f"list_reverse({DU})")), ("ct", J(f"concat({A}, array(7))"), K(f"list_concat({DU}, [7])")),
])
P("array_sets", "part", ["p_partkey"], [
    ("ex", J(f"array_sort(array_except({A}, array(3)))"), K(f"list_sort(list_distinct(list_filter({DU}, lambda x: x <> 3)))")), ("it", J(f"array_sort(array_intersect({A}, array(3, 4)))"), K(f"list_sort(list_intersect({DU}, [3, 4]))")), ("un", J(f"array_sort(array_union({A}, array(4)))"), K(f"list_sort(list_distinct(list_concat({DU}, [4])))")), ("ov", f"arrays_overlap({A}, array(4, 49))", f"list_has_any({DU}, [4, 49])"),
    ("zp", "to_json(arrays_zip(array(1, 2) as a, array(p_size, 4) as b))".replace(" as a", "").replace(" as b", ""), "concat('[{\"0\":1,\"1\":', p_size, '},{\"0\":2,\"1\":4}]')"), ("sq", J("sequence(1, 5)"), "'1,2,3,4,5'"), ("sqd", J("sequence(5, 1, -2)"), "'5,3,1'"), ("sqt", "size(sequence(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 1 MONTH))", "3"),
])
P("array_higher_order", "part", ["p_partkey"], [
    ("ex", f"exists({A}, x -> x > 40)", f"len(list_filter({DU}, lambda x: x > 40)) > 0"), ("fa", f"forall({A}, x -> x < 48)", f"len(list_filter({DU}, lambda x: x >= 48)) = 0"), ("fi", J(f"filter({A}, x -> x % 2 = 1)"), K(f"list_filter({DU}, lambda x: x % 2 = 1)")), ("fix", J(f"filter({A}, (x, i) -> i < 2)"), K(f"{DU}[1:2]")),
    ("tr", J(f"transform({A}, x -> x * 10)"), K(f"list_transform({DU}, lambda x: x * 10)")), ("tri", J(f"transform({A}, (x, i) -> x + i)"), K("[p_size, 4, p_size % 5 + 2, 6]")), ("ag", f"aggregate({A}, 0, (a, x) -> a + x)", f"cast(list_sum({DU}) as int)"), ("agf", f"aggregate({A}, 0, (a, x) -> a + x, a -> a * 1.0D / 4)", f"list_sum({DU}) / 4.0::DOUBLE"),
    ("rd", f"reduce({A}, 1, (a, x) -> a + x)", f"cast(list_sum({DU}) + 1 as int)"), ("zw", J("zip_with(array(1, 2), array(p_size, 5), (x, y) -> x * y)"), K("[p_size, 10]")), ("srt", J(f"array_sort({A}, (x, y) -> y - x)"), K(f"list_reverse_sort({DU})")),
])
P("embedding_norms", "embeddings", ["vec_id"], [
    ("n", "size(embedding)", "cast(len(embedding) as int)"), ("norm", "round(sqrt(aggregate(embedding, 0D, (a, x) -> a + cast(x as double) * x)), 5)", "round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 5)"),
    ("hi", "array_max(embedding)", "list_max(embedding)"), ("first_", "embedding[0]", "embedding[1]"), ("pos", "size(filter(embedding, x -> x > 0))", "cast(len(list_filter(embedding, lambda x: x > 0)) as int)"),
])
M = "map('a', p_size, 'b', p_size + 1)"
P("map_basic", "part", ["p_partkey"], [
    ("ks", J(f"map_keys({M})"), "'a,b'"), ("vs", J(f"map_values({M})"), K("[p_size, p_size + 1]")), ("en", f"map_entries({M})[1].value", "p_size + 1"), ("fa", "map_from_arrays(array('x', 'y'), array(1, p_size))['y']", "p_size"), ("fe", "map_from_entries(array(struct('k', p_size)))['k']", "p_size"), ("cc", J(f"array_sort(map_keys(map_concat({M}, map('c', 1))))"), "'a,b,c'"),
    ("ck", f"map_contains_key({M}, 'b')", "true"), ("el", f"element_at({M}, 'a')", "p_size"), ("no", f"try_element_at({M}, 'z')", "cast(NULL as int)"), ("ft", f"size(map_filter({M}, (k, v) -> v > 25))", "cast((p_size > 25)::INT + (p_size + 1 > 25)::INT as int)"), ("zw", f"map_zip_with({M}, map('a', 1), (k, x, y) -> x + coalesce(y, 0))['a']", "p_size + 1"),
    ("tk", J(f"map_keys(transform_keys({M}, (k, v) -> upper(k)))"), "'A,B'"), ("tv", f"transform_values({M}, (k, v) -> v * 2)['b']", "(p_size + 1) * 2"), ("st", "str_to_map('a:1,b:2')['b']", "'2'"), ("sz", f"size({M})", "2"), ("ns", "named_struct('x', p_size, 'y', p_brand).y", "p_brand"), ("sc", "struct(p_size, p_brand).p_brand", "p_brand"),
])
P("json_functions", "events", ["event_id"], [
    ("k", "get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"), ("none", "get_json_object(props, '$.zz')", "json_extract_string(props, '$.zz')"), ("parsed", "from_json(props, 'k INT').k", "cast(json_extract_string(props, '$.k') as int)"), ("ok", J("json_object_keys(props)"), K("json_keys(props)")), ("n", "json_array_length('[1,2,3]')", "3"),
    ("tj", "to_json(named_struct('a', event_id))", "concat('{\"a\":', event_id, '}')"), ("nest", "get_json_object('{\"a\":{\"b\":[10,20]}}', '$.a.b[1]')", "'20'"), ("mp", "from_json('{\"x\":1}', 'map<string,int>')['x']", "1"), ("so", "schema_of_json('{\"a\":1}')", "'STRUCT<a: BIGINT>'"), ("fc", "from_csv('1,abc', 'a INT, b STRING').b", "'abc'"), ("tc", "to_csv(named_struct('a', 1, 'b', 'x'))", "'1,x'"), ("sc", "schema_of_csv('1,abc')", "'STRUCT<_c0: INT, _c1: STRING>'"), ("vr", "variant_get(parse_json(props), '$.k', 'int')", "cast(json_extract_string(props, '$.k') as int)"),
])


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def explode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per word."""
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS v FROM part")
def explode_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without elements stay, with a null."""
    return read(spark, sf_dir, "part").select("p_partkey", F.explode_outer(F.when(F.col("p_size") > 25, F.array("p_size"))).alias("v"))


@query("SELECT p_partkey, cast(i - 1 AS int) AS pos, string_split(p_name, ' ')[i] AS word FROM (SELECT *, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)")
def posexplode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their places."""
    return read(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))


@query("SELECT n_nationkey, 'a' AS k, n_regionkey AS v FROM nation UNION ALL SELECT n_nationkey, 'b', n_regionkey + 1 FROM nation")
def explode_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per map entry."""
    return read(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.create_map(F.lit("a"), "n_regionkey", F.lit("b"), F.col("n_regionkey") + 1)).alias("k", "v"))


@query("SELECT n_nationkey, 1 AS a, n_name AS b FROM nation UNION ALL SELECT n_nationkey, 2, 'x' FROM nation")
def inline_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of structs as rows and columns."""
    return read(spark, sf_dir, "nation").select("n_nationkey", F.inline(F.array(F.struct(F.lit(1).alias("a"), F.col("n_name").alias("b")), F.struct(F.lit(2).alias("a"), F.lit("x").alias("b")))))


@query("SELECT n_nationkey, n_name AS a, 1 AS b FROM nation UNION ALL SELECT n_nationkey, 'y', 2 FROM nation")
def stack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stack(): values dealt into rows."""
    return read(spark, sf_dir, "nation").select("n_nationkey", F.stack(F.lit(2), F.col("n_name"), F.lit(1), F.lit("y"), F.lit(2)).alias("a", "b"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS other FROM events")
def json_tuple_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several JSON fields in one pass."""
    return read(spark, sf_dir, "events").select("event_id", F.json_tuple("props", "k", "zz").alias("k", "other"))


@query("SELECT role, count(*) AS n, cast(max(turn) AS bigint) AS deepest FROM conversations GROUP BY role")
def conversation_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by role."""
    return read(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("deepest"))
