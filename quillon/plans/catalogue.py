"""One query for each group of document operators, with the same result in SQL from the source columns.

Documents are made of the columns of ``customer``; what is expected is stated in SQL on the same
columns, so that it does not depend on the code under test. ``$k``, ``$name``, ``$bal``, ``$odd`` in a
template stand for a customer's key, name, balance, and whether the key is odd.
"""

from __future__ import annotations

import dataclasses
import enum
import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import dialect
from quillon.functions import documents as D
from quillon.functions import schemas
from quillon.functions.schemas import Field
from quillon.operators import tables
from quillon.sources import documents as sources
from quillon.sources.storage import shared_dir
from quillon.streaming.incremental import stream_to_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_PLACE = re.compile(r"\$(k|name|bal|odd)\b")
_C = "(SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, CASE WHEN c_custkey % 2 = 1 THEN 'true' ELSE 'false' END AS odd FROM customer) c"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return t.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.when(F.col("c_custkey") % 2 == 1, "true").otherwise("false").alias("odd"))


def _text(template: str) -> Column:
    parts = _PLACE.split(template)
    return F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def _says(template: str | None) -> str:
    """The template as an SQL expression."""
    if template is None:
        return "CAST(NULL AS VARCHAR)"
    parts = _PLACE.split(template)
    return "(" + " || ".join(f"CAST({p} AS VARCHAR)" if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts)) + ")"


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _cases(name: str, cases: list[tuple[str, str | None]]) -> None:
    """A query that reads each text and gives (k, n, doc), ``n`` counting the cases."""
    def run(spark, sf_dir):
        texts = F.array(*[F.struct(F.lit(i).alias("n"), _text(given).alias("t")) for i, (given, _) in enumerate(cases)])
        return _customers(spark, sf_dir).select("k", F.explode(texts).alias("c")).select("k", "c.n", D.parse("c.t").alias("doc"))

    QUERIES[name] = run
    ORACLE_SQL[name] = " UNION ALL ".join(f"SELECT k, {i} AS n, {_says(want)} AS doc FROM {_C}" for i, (_, want) in enumerate(cases))


def _edits(name: str, given: str, changes: list[tuple[tuple, str]]) -> None:
    """A query that applies each chain of edits to one document, one column a chain. Edits with columns are given as functions."""
    def run(spark, sf_dir):
        return _customers(spark, sf_dir).select("k", *[D.edit(_text(given), *(e() if callable(e) else e for e in chain)).alias(f"e{i}") for i, (chain, _) in enumerate(changes)])

    QUERIES[name] = run
    ORACLE_SQL[name] = "SELECT k, " + ", ".join(f"{_says(want)} AS e{i}" for i, (_, want) in enumerate(changes)) + f" FROM {_C}"


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# The dialect's rules.

_cases("doc_lex_separators", [
    ("[ $k\t,,\r\n \"$name\" ,]", '[$k,"$name"]'), ("[$k \"$name\" null]", '[$k,"$name",null]'),
    ("  \n\t{\"a\"  :  $k , , \"b\":\"$name\"}  ", '{"a":$k,"b":"$name"}'), (",,,$k", "$k"),
])
_cases("doc_lex_quotes", [
    (r'["$name\"quoted\\"]', r'["$name\"quoted\\"]'), (r'["aA\n\/", $k]', r'["aA\n/",$k]'), ('["$name', '["$name"]'),
    ("{'a\":$k,\"b\":1}", '{"a":$k,"b":1}'), (r'{"key":$k}', '{"key":$k}'), (r'["😀$name"]', '["\U0001f600$name"]'), ("[\"tab\there\"]", r'["tab\there"]'),
])
_cases("doc_lex_regex", [
    ("/^$name$/gi", "/^$name$/gi"), ("[/a b/,$k]", "[/a b/,$k]"), ('{"r":/x{2,3}/m,"k":$k}', '{"r":/x{2,3}/m,"k":$k}'),
])
_cases("doc_lex_numbers", [
    ("[$k,-$k,0]", "[$k,MINUS,0]"), ("[$k.5,-0.25,12.0]", "[$k.5,-0.25,12.0]"), ("[1e5,$k]", "[$k]"), ("[99999999999999999999,$k]", "[$k]"), ("[9223372036854775807,12x,$k]", "[9223372036854775807,$k]"), ("[1.5e3,$k]", "[1500.0,$k]"),
])
ORACLE_SQL["doc_lex_numbers"] = ORACLE_SQL["doc_lex_numbers"].replace("MINUS", "' || CAST(-k AS VARCHAR) || '")  # zero has no sign
_cases("doc_lex_words", [
    ("[true,false,null,$odd]", "[true,false,null,$odd]"), ("[xxtrue,is_false,$k]", "[true,false,$k]"), ("[yes,no,$k]", "[$k]"), ("null", "null"), ('{"a":true,"b":null,"c":$k}', '{"a":true,"b":null,"c":$k}'),
])
_cases("doc_lex_containers", [
    ('{"a":[$k,{"b":[1,2', '{"a":[$k,{"b":[1,2]}]}'), ("[$k}", "[$k]"), ('{"a":{"b":$k]]', '{"a":{"b":$k}}'), ('{"e":[},"f":$k}', '{"e":{},"f":$k}'), ("[{],$k]", "[[],$k]"), ("[[],{},$k]", "[[],{},$k]"),
])
_cases("doc_lex_duplicate_keys", [
    ('{"a":1,"b":2,"a":$k}', '{"a":$k,"b":2}'), ('{"a":{"x":1},"b":2,"a":"$name"}', '{"a":"$name","b":2}'),
])
_cases("doc_lex_roots", [
    ("$k 7 8", "$k"), ("1 [$k]", "[$k]"), ("[1] [$k]", "[$k]"), ("[1] $k", "$k"), ('{"a":1}{"b":$k}', '{"b":$k}'),
])
_cases("doc_lex_garbage", [
    ("~~ @@ ##", None), ("", None), ("[@@,$k,<>]", "[$k]"), ("no value here $k", "$k"), ("}}]]", None), ('{"a":@,"b":$k}', '{"b":$k}'),
])


# Sources.

@query(f"""SELECT k, {_says('{"k":$k,"s":"é$name"}')} AS from_bytes, {_says('[$k,2]')} AS from_slice, {_says('{"k":$k}')} AS from_text FROM {_C}""")
def doc_parse_forms(spark, sf_dir):
    """Text, bytes, a slice of a longer text."""
    c = _customers(spark, sf_dir)
    slice_ = F.expr("substring(concat('xx[', k, ',2]yy'), 3, length(concat('[', k, ',2]')))")
    return c.select("k", D.parse(_text('{"k":$k,"s":"é$name"}').cast("binary")).alias("from_bytes"), D.parse(slice_).alias("from_slice"), D.parse(_text('{"k":$k}')).alias("from_text"))


@query(f"""SELECT k, {_says('{"k":$k,"s":"é $name"}')} AS doc, true AS has_path FROM {_C}""")
def doc_text_files(spark, sf_dir):
    """Documents written as lines of text and read back with the file they come from."""
    path = _fresh(spark, "text")
    sources.write_documents(_customers(spark, sf_dir).select(D.parse(_text('{"k" : $k, "s" : "é $name"}')).alias("doc")), "doc", path)
    t = sources.read_documents(spark, path)
    return t.select(D.path("doc", "k", as_type="int").alias("k"), "doc", F.contains("path", F.lit("part-")).alias("has_path"))


@query("SELECT o_orderpriority AS priority, count(*) AS n, sum(o_orderkey) AS keys FROM orders GROUP BY o_orderpriority")
def doc_binary_files(spark, sf_dir):
    """One document a file, read as bytes and as whole texts: arrays of the orders of each priority."""
    path = _fresh(spark, "files")
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    one = t.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
    doc = D.object_of(priority=D.scalar("o_orderpriority"), n=D.scalar("n"), keys=D.scalar("keys"))
    one.select("o_orderpriority", doc.alias("value")).write.partitionBy("o_orderpriority").text(path)
    as_bytes, as_text = sources.read_binary(spark, f"{path}/*/part-*"), sources.read_documents(spark, f"{path}/*/part-*", lines=False)
    x = D.extract("doc", priority=("string", "priority"), n=("int", "n"), keys=("int", "keys"))
    return as_bytes.select("doc").intersect(as_text.select("doc")).select(x.alias("x")).select("x.*")


def _sum_of_numbers(tree) -> int | None:
    return None if tree is dialect.NOTHING else sum(x for x in tree if isinstance(x, int) and not isinstance(x, bool)) if isinstance(tree, list) else -1


@query(f"SELECT k, CASE k % 3 WHEN 0 THEN k + 2 WHEN 1 THEN -1 END AS total FROM {_C}")
def doc_scoped_parse(spark, sf_dir):
    """A function of the caller's on the parsed tree; what can't be read reaches it too."""
    doc = F.when(F.col("k") % 3 == 0, _text('[$k,"$name",2,true]')).when(F.col("k") % 3 == 1, _text('{"a":$k}')).otherwise(F.lit("~"))
    return _customers(spark, sf_dir).withColumn("doc", doc).transform(D.with_parsed, "doc", "total", _sum_of_numbers, "long").select("k", "total")


@query("""SELECT o_orderkey, '{"key":' || o_orderkey || ',"day":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '","none":null,"price":' || CASE WHEN o_orderkey % 5 = 0 THEN '"+Infinity"' WHEN o_orderkey % 5 = 1 THEN '"-Infinity"' WHEN o_orderkey % 5 = 2 THEN '"NaN"' ELSE CAST(o_totalprice AS VARCHAR) END || ',"word":"Infinity","sub":{"list":[' || o_custkey || ',null],"far":["+Infinity"]}}' AS doc FROM orders""")
def doc_from_struct(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    r = F.col("o_orderkey") % 5
    price = F.when(r == 0, F.lit(float("inf"))).when(r == 1, F.lit(float("-inf"))).when(r == 2, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    typed = t.select("o_orderkey", F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("day"), F.lit(None).cast("string").alias("none"), price.alias("price"), F.lit("Infinity").alias("word"), F.struct(F.array("o_custkey", F.lit(None)).alias("list"), F.array(F.lit(float("inf"))).alias("far")).alias("sub"))
    return typed.select("o_orderkey", D.from_struct(typed, "key", "day", "none", "price", "word", "sub").alias("doc"))


# Kinds, accessors, navigation.

_MIXED = '{"i":$k,"d":$k.5,"s":"$name","b":$odd,"n":null,"r":/^$name$/gi,"a":[$k,"$name",[1,{"k":$k}]],"o":{"k":$k,"z":"$name"}}'
_ONE_OF = [("null", "null"), ("boolean", "$odd"), ("int", "$k"), ("double", "$k.5"), ("string", '"é$name"'), ("regex", "/$name/i"), ("array", '[$k,"$name",[]]'), ("dictionary", '{"z":$k,"a":"$name"}')]


def _one_of(pick: Callable[[int], Column]) -> Column:
    found = F.when(F.lit(False), F.lit(""))
    for i in range(len(_ONE_OF)):
        found = found.when(F.col("k") % len(_ONE_OF) == i, pick(i))
    return found


@query(f"""SELECT k, k AS i, CAST(k AS DOUBLE) AS i_double, k + 0.5::DOUBLE AS d, CAST(NULL AS BIGINT) AS d_int, CAST(k + 0.5::DOUBLE AS FLOAT) AS d_float, name AS s, CAST(NULL AS BIGINT) AS s_int, {_says('/^$name$/gi')} AS r,
    odd = 'true' AS b, CAST(NULL AS BOOLEAN) AS s_bool, false AS gone_bool, CAST(NULL AS BIGINT) AS gone_int, CAST(NULL AS VARCHAR) AS n_string, {_says('[$k,"$name",[1,{"k":$k}]]')} AS a, CAST(NULL AS VARCHAR) AS gone FROM {_C}""")
def doc_typed_keys(spark, sf_dir):
    x = D.extract(_text(_MIXED), i=("int", "i"), i_double=("double", "i"), d=("double", "d"), d_int=("int", "d"), d_float=("float", "d"), s=("string", "s"), s_int=("int", "s"), r=("string", "r"), b=("boolean", "b"), s_bool=("boolean", "s"), gone_bool=("boolean", "gone"), gone_int=("int", "gone"), n_string=("string", "n"), a=("document", "a"), gone=("document", "gone"))
    return _customers(spark, sf_dir).select("k", x.alias("x")).select("k", "x.*")


@query(f"""SELECT k, k AS i, CAST(k AS DOUBLE) AS i_double, CAST(k AS FLOAT) AS i_float, name AS s, k + 0.5::DOUBLE AS d, odd = 'true' AS b, CAST(NULL AS BOOLEAN) AS out_bool, CAST(NULL AS BIGINT) AS s_int, '/x/' AS r, {_says('{"q":$k}')} AS o,
    'null' AS n, CAST(NULL AS VARCHAR) AS beyond, CAST(NULL AS VARCHAR) AS before, CAST(NULL AS BIGINT) AS before_int FROM {_C}""")
def doc_typed_indices(spark, sf_dir):
    x = D.extract(_text('[$k,"$name",$k.5,$odd,/x/,{"q":$k},null]'), i=("int", 0), i_double=("double", 0), i_float=("float", 0), s=("string", 1), d=("double", 2), b=("boolean", 3), out_bool=("boolean", 9), s_int=("int", 1), r=("string", 4), o=("document", 5), n=("document", 6), beyond=("document", 7), before=("document", -1), before_int=("int", -1))
    return _customers(spark, sf_dir).select("k", x.alias("x")).select("k", "x.*")


@query(f"""SELECT k, k AS i, name AS s, k + 0.5::DOUBLE AS d, CAST(k AS DOUBLE) AS i_double, CAST(k AS FLOAT) AS i_float, odd = 'true' AS b, CAST(NULL AS BIGINT) AS beyond, CAST(NULL AS VARCHAR) AS element, CAST(NULL AS BIGINT) AS s_int FROM {_C}""")
def doc_positional(spark, sf_dir):
    """Typed readers take an object's values by position, elements don't."""
    x = D.extract(_text('{"x":$k,"y":"$name","z":$k.5,"w":$odd}'), i=("int", 0), s=("string", 1), d=("double", 2), i_double=("double", 0), i_float=("float", 0), b=("boolean", 3), beyond=("int", 4), element=("document", 0), s_int=("int", 1))
    return _customers(spark, sf_dir).select("k", x.alias("x")).select("k", "x.*")


@query(f"SELECT k, k AS deep, name AS z, CAST(NULL AS BIGINT) AS through_scalar, CAST(NULL AS BIGINT) AS through_gone, {_says('{\"k\":$k}')} AS element FROM {_C}")
def doc_chain(spark, sf_dir):
    """Paths of several steps, through an element column and in one call."""
    c = _customers(spark, sf_dir).select("k", _text(_MIXED).alias("doc"))
    c = c.select("k", "doc", D.path("doc", "a", 2).alias("a2"))
    return c.select("k", D.path("a2", 1, "k", as_type="int").alias("deep"), D.path("doc", "o", "z", as_type="string").alias("z"), D.path("doc", "i", "k", as_type="int").alias("through_scalar"), D.path("doc", "gone", 0, "k", as_type="int").alias("through_gone"), D.path("doc", "a", 2, 1).alias("element"))


@query("SELECT k, CASE k % 8 " + " ".join(f"WHEN {i} THEN '{kind}'" for i, (kind, _) in enumerate(_ONE_OF)) + f""" END AS kind, CASE k % 8 WHEN 4 THEN 'é' || name WHEN 5 THEN {_says('/$name/i')} END AS s, CASE WHEN k % 8 = 2 THEN k END AS i,
    CASE WHEN k % 8 = 3 THEN k + 0.5::DOUBLE END AS d, CASE WHEN k % 8 = 1 THEN odd = 'true' END AS b, CAST(CASE k % 8 WHEN 4 THEN strlen(name) + 2 WHEN 5 THEN strlen(name) + 3 WHEN 6 THEN 3 WHEN 7 THEN 2 ELSE 0 END AS BIGINT) AS n,
    CASE WHEN k % 8 = 7 THEN 'z,a' END AS keys, CASE k % 8 """ + " ".join(f"WHEN {i} THEN {_says(t)}" for i, (_, t) in enumerate(_ONE_OF[:5])) + f""" WHEN 5 THEN {_says('"/$name/i"')} WHEN 6 THEN {_says(_ONE_OF[6][1])} WHEN 7 THEN {_says('[$k,"$name"]')} END AS vals FROM {_C}""")
def doc_accessors(spark, sf_dir):
    """Every kind through every accessor."""
    c = _customers(spark, sf_dir).select("k", _one_of(lambda i: _text(_ONE_OF[i][1])).alias("d"))
    return c.select("k", D.kind("d").alias("kind"), D.string_value("d").alias("s"), D.int_value("d").alias("i"), D.double_value("d").alias("d_"), D.bool_value("d").alias("b"), D.count("d").alias("n"), F.array_join(D.keys("d"), ",").alias("keys"), D.values("d").alias("vals")).withColumnRenamed("d_", "d")


_PAIRS = [("1", "1.0", False), ('{"a":$k,"b":[1]}', '{ "a":$k, "b":[1] }', True), ('{"a":1,"b":2}', '{"b":2,"a":1}', False), ("/$name/", '"/$name/"', False), ("[1,2]", "[2,1]", False), ("[0.0,null]", "[-0.0,null]", True), ('"$name"', '"$name"', True), ("~", "1", None)]


@query("SELECT k, CASE k % 8 " + " ".join(f"WHEN {i} THEN {'CAST(NULL AS BOOLEAN)' if want is None else str(want).lower()}" for i, (_, _, want) in enumerate(_PAIRS)) + f" END AS equal FROM {_C}")
def doc_equality(spark, sf_dir):
    return _customers(spark, sf_dir).select("k", D.same(_one_of(lambda i: _text(_PAIRS[i][0])), _one_of(lambda i: _text(_PAIRS[i][1]))).alias("equal"))


# Predicates.

@query(f"""SELECT k, k % 7 <> 0 AS has_a, k % 7 <> 0 AND k % 2 = 0 AS has_b, k % 7 <> 0 AND k % 2 = 0 AS all_ab, k % 7 <> 0 AND k % 6 = 0 AS all_abc, k % 7 <> 0 AS all_none FROM {_C}""")
def doc_predicates(spark, sf_dir):
    b, c = F.when(F.col("k") % 2 == 0, F.lit('"b":2,')).otherwise(F.lit("")), F.when(F.col("k") % 3 == 0, F.lit('"c":3,')).otherwise(F.lit(""))
    doc = F.when(F.col("k") % 7 == 0, F.lit('["a","b"]')).otherwise(F.concat(F.lit("{"), b, c, F.lit('"a":1}')))
    d = _customers(spark, sf_dir).select("k", doc.alias("d"))
    return d.select("k", D.contains_key("d", "a").alias("has_a"), D.contains_key("d", "b").alias("has_b"), D.contains_all("d", ["a", "b"]).alias("all_ab"), D.contains_all("d", ["c", "a", "b"]).alias("all_abc"), D.contains_all("d", []).alias("all_none"))


@query(f"SELECT k FROM {_C} WHERE k % 6 = 0")
def doc_filter(spark, sf_dir):
    """Rows whose document has all keys."""
    doc = F.concat(F.lit('{"a":1'), F.when(F.col("k") % 2 == 0, F.lit(',"b":null')).otherwise(F.lit("")), F.when(F.col("k") % 3 == 0, F.lit(',"c":3')).otherwise(F.lit("")), F.lit("}"))
    return _customers(spark, sf_dir).where(D.contains_all(doc, ["b", "c"])).select("k")


# Iteration.

_MEMBERS = [("i", "int", "$k"), ("d", "double", "$k.5"), ("s", "string", '"$name"'), ("b", "boolean", "$odd"), ("n", "null", "null"), ("r", "regex", "/^$name$/gi"), ("a", "array", '[$k,"$name",[1,{"k":$k}]]'), ("o", "dictionary", '{"k":$k,"z":"$name"}')]


@query(" UNION ALL ".join(f"SELECT k, CAST({i} AS BIGINT) AS ord, '{key}' AS key, '{kind}' AS kind, {_says(text)} AS text FROM {_C}" for i, (key, kind, text) in enumerate(_MEMBERS)))
def doc_children(spark, sf_dir):
    return _customers(spark, sf_dir).select("k", F.explode(D.children(_text(_MIXED))).alias("c")).select("k", "c.*")


@query(f"""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS key, 'dictionary' AS kind, turn, role, text FROM conversations""")
def doc_unnest_items(spark, sf_dir):
    """Items of arrays of different lengths, with what they hold."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "role", "text")))).alias("doc"))
    c = t.select("conv_id", F.explode(D.children("doc")).alias("c")).select("conv_id", "c.*")
    x = D.extract("text", turn=("int", "turn"), role=("string", "role"), text=("string", "text"))
    return c.select("conv_id", "ord", "key", "kind", x.alias("x")).select("conv_id", "ord", "key", "kind", "x.*")


@query(" UNION ALL ".join(f"SELECT k, {i} AS ord, '{key}' AS key FROM {_C}" for i, (key, _, _) in enumerate(_MEMBERS)))
def doc_keys(spark, sf_dir):
    strict = D.parse(_text(_MIXED), strict=True)
    return _customers(spark, sf_dir).select("k", F.posexplode(D.keys(strict)).alias("ord", "key"))


@query(" UNION ALL ".join(f"SELECT k, {n} AS n, '{key}' AS key, {_says(text)} AS text FROM {_C}" for n, key, text in [(0, "a", _MEMBERS[6][2]), (0, "o", _MEMBERS[7][2]), (1, "1", "[$k]"), (1, "2", '{"q":"$name"}'), (1, "4", "[]")]))
def doc_walking(spark, sf_dir):
    """Containers among the children; an item's key is its index."""
    given = F.array(F.struct(F.lit(0).alias("n"), _text(_MIXED).alias("t")), F.struct(F.lit(1).alias("n"), _text('[$k,[$k],{"q":"$name"},"x",[]]').alias("t")), F.struct(F.lit(2).alias("n"), F.lit("7").alias("t")))
    c = _customers(spark, sf_dir).select("k", F.explode(given).alias("c")).select("k", "c.n", F.explode(D.walking("c.t")).alias("w"))
    return c.select("k", "n", "w.key", "w.text")


_NODES = [("", 0, 0, None, "dictionary", 2, '{"a":[$k,{"b":null}],"c":"$name"}'), ("a", 1, 0, "a", "array", 2, '[$k,{"b":null}]'), ("a/[]", 2, 0, None, "int", 0, "$k"), ("a/[]", 2, 1, None, "dictionary", 1, '{"b":null}'), ("a/[]/b", 3, 0, "b", "null", 0, "null"), ("c", 1, 1, "c", "string", 0, '"$name"')]


@query(" UNION ALL ".join(f"SELECT k, '{p}' AS path, CAST({d} AS BIGINT) AS depth, CAST({o} AS BIGINT) AS ord, {'CAST(NULL AS VARCHAR)' if key is None else repr(key)} AS key, '{kind}' AS kind, CAST({n} AS BIGINT) AS n_children, {_says(t)} AS text FROM {_C}" for p, d, o, key, kind, n, t in _NODES))
def doc_nodes(spark, sf_dir):
    c = _customers(spark, sf_dir).select("k", F.explode(D.nodes(_text(_NODES[0][6]))).alias("n"))
    return c.select("k", F.array_join("n.path", "/").alias("path"), "n.depth", "n.ord", "n.key", "n.kind", "n.n_children", "n.text")


# Edits.

_edits("doc_replace", '[$k,"$name",3]', [
    ((D.replace({"new": [1, None]}),), '{"new":[1,null]}'), ((D.replace_at(1, 2.5),), "[$k,2.5,3]"), ((D.replace_at(3, 9), D.replace_at(-1, 9)), '[$k,"$name",3]'), ((lambda: D.replace_at(0, F.col("name")),), '[null,"$name",3]'), ((lambda: D.replace_at(0, F.col("k").cast("string")), D.replace(7), D.replace_at(0, 1)), "7"),
])
_edits("doc_append_insert_set", '[$k,"$name"]', [
    ((D.append(None), D.append("x")), '[$k,"$name",null,"x"]'), ((D.insert(2, 9),), '[$k,"$name",9,null]'), ((D.insert(4, 9),), '[$k,"$name",null,null,9,null]'), ((D.insert(0, True), D.insert(1, [1])), '[true,[1],$k,"$name"]'), ((D.set_at(1, 5),), "[$k,5]"), ((D.set_at(4, {"a": 1}),), '[$k,"$name",null,null,{"a":1}]'), ((D.set_at(-1, 1), D.insert(-1, 1)), '[$k,"$name"]'),
    ((lambda: D.append(F.concat(F.lit('{"z":'), F.col("k"), F.lit("}"))),), '[$k,"$name",{"z":$k}]'), ((D.set_key("a", 1), D.rename("a", "b"), D.remove_key("a")), '[$k,"$name"]'),
])
_edits("doc_remove_clean", '[null,$k,null,[null],{"a":null}]', [
    ((D.remove_at(1),), '[null,null,[null],{"a":null}]'), ((D.remove_at(5), D.remove_at(-1)), '[null,$k,null,[null],{"a":null}]'), ((D.clean(),), '[$k,[null],{"a":null}]'), ((D.clean(), D.remove_at(0), D.remove_at(0)), '[{"a":null}]'),
])
_edits("doc_object_edits", '{"a":1,"b":null,"c":{"d":null,"e":$k},"name":"$name"}', [
    ((D.set_key("b", 2),), '{"a":1,"b":2,"c":{"d":null,"e":$k},"name":"$name"}'), ((D.set_key("new", None), D.set_key("a", [True])), '{"a":[true],"b":null,"c":{"d":null,"e":$k},"name":"$name","new":null}'), ((D.rename("b", "bb"), D.rename("gone", "x")), '{"a":1,"bb":null,"c":{"d":null,"e":$k},"name":"$name"}'),
    ((D.remove_key("c"), D.remove_key("gone")), '{"a":1,"b":null,"name":"$name"}'), ((D.clean(),), '{"a":1,"c":{"d":null,"e":$k},"name":"$name"}'), ((D.at(("c",), D.clean()), D.at(("c", "gone"), D.clean())), '{"a":1,"b":null,"c":{"e":$k},"name":"$name"}'), ((D.append(1), D.insert(0, 1), D.set_at(0, 1), D.replace_at(0, 1), D.remove_at(0)), '{"a":1,"b":null,"c":{"d":null,"e":$k},"name":"$name"}'),
])
_edits("doc_typed_setters", '["$name",$k,$k.5,$odd,/x/i,null]', [
    ((D.at((0,), D.set_typed("string", "new")), D.at((1,), D.set_typed("int", 7)), D.at((2,), D.set_typed("double", 0.5)), D.at((3,), D.set_typed("boolean", True)), D.at((4,), D.set_typed("string", "/y/"))), '["new",7,0.5,true,/y/,null]'),
    ((D.at((0,), D.set_typed("string", None)), D.at((1,), D.set_typed("int", None)), D.at((2,), D.set_typed("double", None)), D.at((3,), D.set_typed("boolean", None))), '["",0,0.0,false,/x/i,null]'),
    ((D.at((0,), D.set_typed("int", 7)), D.at((1,), D.set_typed("double", 7.5)), D.at((2,), D.set_typed("int", 7)), D.at((3,), D.set_typed("string", "x")), D.at((5,), D.set_typed("int", 1))), '["$name",$k,$k.5,$odd,/x/i,null]'),
])


# Sorting.

_edits("doc_sort_nested", '{"bb":{"z":1,"a":$k},"a":[{"yy":1,"x":"$name"},2],"ccc":0,"B":1}', [
    ((D.sorted_keys(),), '{"B":1,"a":[{"x":"$name","yy":1},2],"bb":{"a":$k,"z":1},"ccc":0}'), ((D.remove_key("a"), D.sorted_keys()), '{"B":1,"bb":{"a":$k,"z":1},"ccc":0}'),
])
_edits("doc_sort_all_nested", '{"v":["$name",22,1,"b",[30,4,100]],"u":[{"b":1,"a":[2,1]},{"a":0}]}', [
    ((D.sorted_all(),), '{"u":[{"a":0},{"a":[1,2],"b":1}],"v":[1,22,"b",[4,30,100],"$name"]}'),
])


@query(f"""SELECT k, '[' || array_to_string(list_reverse_sort([5, k, 500, -1]), ',') || ']' AS falling, '[' || array_to_string(list_sort([5, k, 500, -1]), ',') || ']' AS rising, {_says('{"a":[2,1]}')} AS no_array FROM {_C}""")
def doc_sort_array(spark, sf_dir):
    """By a comparator and by a key."""
    c = _customers(spark, sf_dir)
    return c.select("k", D.edit(_text("[5,$k,500,-1]"), D.sort_array(before=lambda a, b: a > b)).alias("falling"), D.edit(_text("[5,$k,500,-1]"), D.sort_array(key=lambda x: x)).alias("rising"), D.edit(F.lit('{"a":[2,1]}'), D.sort_array(key=lambda x: x)).alias("no_array"))


# Text.

_cases("doc_compact", [
    (r'{ "a" : [ $k , 2.50 , "t\tb\"q\\ é\u0001" ] , "e" : { } , "f":[ ] }', r'{"a":[$k,2.5,"t\tb\"q\\ é\u0001"],"e":{},"f":[]}'), ("[1.0E2, 100000000.0, 0.00001]", "[100.0,1.0E8,1.0E-5]"), ('{"r":/a\tb/g,"z":null}', '{"r":/a\tb/g,"z":null}'),
])


@query(f"""SELECT k, 'doc ' || k || ': ' || {_says('{"k":$k,"s":"é"}')} AS line, CAST(strlen({_says('{"k":$k,"s":"é"}')}) AS BIGINT) AS size FROM {_C}""")
def doc_export(spark, sf_dir):
    doc = D.parse(_text('{"k":$k, "s":"é"}'))
    return _customers(spark, sf_dir).select("k", D.export_to(F.concat(F.lit("doc "), F.col("k"), F.lit(": ")), doc).alias("line"), D.export_size(doc).alias("size"))


_PRETTY = '{\n    "a": [\n        $k,\n        {\n            "b": [],\n            "c": {}\n        },\n        []\n    ],\n    "n": null,\n    "s": "$name"\n}'


@query(f"SELECT k, {_says(_PRETTY)} AS doc FROM {_C}")
def doc_pretty_nested(spark, sf_dir):
    return _customers(spark, sf_dir).select("k", D.pretty(_text('{"a":[$k,{"b":[],"c":{}},[]],"n":null,"s":"$name"}')).alias("doc"))


@query(f"SELECT k, k AS a, name AS s, 2 AS n, k AS v, CAST(k + 1 AS BIGINT) AS py FROM {_C}")
def doc_reify(spark, sf_dir):
    """Native values of a document: as a given type, as VARIANT, and as plain values for a function."""
    c = _customers(spark, sf_dir).select("k", _text('{"s":"$name","l":[$k,null],"a":$k}').alias("d"))
    t = D.reify("d", "a bigint, s string, l array<bigint>")
    py = D.parsed("d", lambda t: dialect.reify(t, null=1)["a"] + dialect.reify(t, null=1)["l"][1], "long")
    return c.select("k", t.alias("t"), D.reify("d").alias("v"), py.alias("py")).select("k", "t.a", "t.s", F.size("t.l").alias("n"), F.try_variant_get("v", "$.a", "bigint").alias("v"), "py")


# Construction.

class Celsius:
    """A kind of the user's that says itself what it is as a document."""

    def __init__(self, degrees: float):
        self.degrees = degrees

    def to_document(self):
        return {"celsius": self.degrees}


class Money:
    """A kind of the user's with a registered conversion."""

    def __init__(self, cents: int):
        self.cents = cents


dialect.register_conversion(Money, lambda m: [m.cents // 100, m.cents % 100])


@dataclasses.dataclass
class Point:
    x: int
    y: float | None = None


@query(f"""SELECT k, {_says('[$k,"$name",$bal,$odd,null]')} AS arr, {_says('{"z":$k,"a":["$name"],"none":null}')} AS obj, '{{"i":1,"f":2.5,"t":"x","b":true,"n":null,"l":[1,null],"p":{{"x":3}},"c":{{"celsius":21.5}},"m":[12,5],"odd":null}}' AS made, 'null' AS nothing FROM {_C}""")
def doc_construct(spark, sf_dir):
    value = {"i": 1, "f": 2.5, "t": "x", "b": True, "n": None, "l": [1, None], "p": Point(3), "c": Celsius(21.5), "m": Money(1205), "odd": object(), 7: "left out"}
    c = _customers(spark, sf_dir).withColumn("flag", F.col("odd") == "true")
    arr = D.array_of(D.scalar("k"), D.scalar("name"), D.scalar("bal"), D.scalar("flag"), F.lit(None).cast("string"))
    return c.select("k", arr.alias("arr"), D.object_of(z=D.scalar("k"), a=D.array_of(D.scalar("name")), none=F.lit(None).cast("string")).alias("obj"), D.document(value).alias("made"), D.document(None).alias("nothing"))


# Inference.

def _varied(spark, sf_dir) -> DataFrame:
    """Objects with missing keys, nulls, widened and mixed kinds."""
    even = F.col("k") % 2 == 0
    doc = F.concat(
        _text('{"k":$k,'), F.when(even, F.lit('"even":true,')).otherwise(F.lit("")), F.lit('"half":'), F.when(even, _text("$k")).otherwise(_text("$k.5")), F.lit(',"mix":'), F.when(even, _text("$k")).otherwise(_text('"$name"')),
        F.lit(',"nul":null,"obj":{},"some":'), F.when(even, F.lit("null")).otherwise(_text("$k")), F.lit(',"rx":'), F.when(even, F.lit("/x/")).otherwise(F.lit('"y"')), F.lit("}"),
    )
    return _customers(spark, sf_dir).select("k", doc.alias("doc"))


def _fields_frame(spark, found: list[tuple[str, list[Field]]]) -> DataFrame:
    """One row a field: (case, ord, name, kind, nullable)."""
    return _rows(spark, [(case, i, f.name, f.kind, f.nullable) for case, fields in found for i, f in enumerate(fields)], "case string, ord long, name string, kind string, nullable boolean")


def _fields_sql(rows: list[tuple]) -> str:
    said = ", ".join(f"('{case}', CAST({i} AS BIGINT), '{name}', '{kind}', {str(nullable).lower()})" for case, i, name, kind, nullable in rows)
    return f'SELECT * FROM (VALUES {said}) t("case", ord, name, kind, nullable)'


_VARIED = [("k", "int64", False), ("even", "boolean", True), ("half", "double", False), ("mix", "json", False), ("nul", "string", True), ("obj", "json", False), ("some", "int64", True), ("rx", "string", False)]


@query(_fields_sql([("varied", i, *f) for i, f in enumerate(_VARIED)] + [("items", 0, "a", "int64", True), ("items", 1, "b", "string", True), ("scalars", 0, "value", "double", False), ("mixed", 0, "value", "json", False), ("one", 0, "value", "int64", False), ("empty", 0, "value", "string", False)]))
def doc_infer_kinds(spark, sf_dir):
    """Flat schemas: the kinds' join, nulls, order of first appearance; arrays of records, of scalars, mixed, and lone scalars."""
    c = _customers(spark, sf_dir)
    found = [("varied", tables.infer_flat(_varied(spark, sf_dir), "doc", ordinal="k"))]
    for case, text in (("items", '[{"a":$k},{"b":"$name"}]'), ("scalars", "[$k,$k.5]"), ("mixed", '[{"a":$k},5]'), ("one", "$k"), ("empty", "[]")):
        found.append((case, tables.infer_flat(c.select("k", _text(text).alias("doc")), "doc", ordinal="k")))
    return _fields_frame(spark, found)


_NEST = '{"id":$k,"empty":{},"items":[{"p":$k},{"p":$k.5,"tags":["$name"]}],"mixed":MIX,"deep":{"a":{"b":[[1],[null,$k]]}},"nulls":[null,{}],"late":LATE}'


def _nested(spark, sf_dir) -> DataFrame:
    even = F.col("k") % 2 == 0
    head, rest = _NEST.split("MIX")
    middle, tail = rest.split("LATE")
    doc = F.concat(_text(head), F.when(even, F.lit("1")).otherwise(F.lit("[2]")), _text(middle), F.when(even, F.lit("null")).otherwise(_text('"$name"')), F.lit(tail))
    return _customers(spark, sf_dir).select("k", doc.alias("doc"))


_NEST_LINES = ["id: int64", "empty: string optional", "items: list", "  element: group optional", "    p: double", "    tags: list optional", "      element: string optional", "mixed: json", "deep: group", "  a: group", "    b: list", "      element: list optional", "        element: int64 optional", "nulls: list", "  element: string optional", "late: string optional"]


@query("SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{line}')" for i, line in enumerate(_NEST_LINES)) + ") t(ord, line)")
def doc_infer_nested(spark, sf_dir):
    """Groups, lists in lists, null-ish fields, a mixed field, widening inside items."""
    return _rows(spark, list(enumerate(schemas.describe(tables.infer_nested(_nested(spark, sf_dir), "doc", ordinal="k")))), "ord long, line string")


class Colour(enum.Enum):
    RED = "red"


@dataclasses.dataclass
class Tree:
    name: str
    size: int
    weight: float | None
    alive: bool
    notes: dict
    colour: Colour
    twigs: list["Tree"]


@dataclasses.dataclass
class Leafy:
    name: str
    size: int
    weight: float | None
    tags: list[str]
    at: Point


@dataclasses.dataclass
class Endless:
    again: "Endless"


@dataclasses.dataclass
class Hue:
    colour: Colour


def _error(fn, *args) -> str:
    try:
        fn(*args)
    except schemas.SchemaError as e:
        return "too deep" if "deep" in str(e) else "unsupported"
    return "none"


_CLASS_LINES = [("flat", x) for x in ("name: string", "size: int64", "weight: double optional", "tags: json", "at: json")] + [("scalar", "value: double")] + [("nested", x) for x in ("name: string", "size: int64", "weight: double optional", "alive: boolean", "notes: json", "colour: json", "twigs: list", "  element: group optional", "    name: string", "    size: int64", "    weight: double optional", "    alive: boolean", "    notes: json", "    colour: json")] + [("shapes", x) for x in ("record", "array", "scalar")] + [("errors", x) for x in ("unsupported", "too deep", "none")]


@query('SELECT * FROM (VALUES ' + ", ".join(f"('{case}', CAST({i} AS BIGINT), '{line}')" for i, (case, line) in enumerate(_CLASS_LINES)) + ') t("case", ord, line)')
def doc_class_schemas(spark, sf_dir):
    """Schemas from classes, flat and nested with its limit on recursion; shapes; errors."""
    found = [("flat", x) for x in schemas.describe(schemas.flat_fields(Leafy))] + [("scalar", x) for x in schemas.describe(schemas.flat_fields(float))] + [("nested", x) for x in schemas.describe(schemas.nested_fields(Tree, 1))]
    found += [("shapes", schemas.shape(x)) for x in (Tree, list[int], int)] + [("errors", x) for x in (_error(schemas.flat_fields, Hue), _error(schemas.flat_fields, Endless), _error(schemas.flat_fields, Leafy))]
    return _rows(spark, [(case, i, line) for i, (case, line) in enumerate(found)], "case string, ord long, line string")


# Shredding.

@query(f"""SELECT k, CASE WHEN k % 2 = 0 THEN true END AS even, CASE WHEN k % 2 = 0 THEN CAST(k AS DOUBLE) ELSE k + 0.5::DOUBLE END AS half, CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE {_says('"$name"')} END AS mix, CAST(NULL AS VARCHAR) AS nul, '{{}}' AS obj, CASE WHEN k % 2 = 1 THEN k END AS some, CASE WHEN k % 2 = 0 THEN '/x/' ELSE 'y' END AS rx FROM {_C}""")
def doc_shred_kinds(spark, sf_dir):
    """Widened numbers, JSON text where kinds mix (strings keep their quotes), nulls and missing keys."""
    return tables.to_table(_varied(spark, sf_dir), "doc", ordinal="k")


@query(f"""SELECT k, CASE k % 4 WHEN 0 THEN '' ELSE name END AS s, CASE k % 4 WHEN 1 THEN CAST(0 AS BIGINT) ELSE k END AS i, CASE k % 4 WHEN 2 THEN 0.0::DOUBLE WHEN 3 THEN CAST(k AS DOUBLE) ELSE k + 0.5::DOUBLE END AS d, CASE k % 4 WHEN 3 THEN NULL WHEN 1 THEN k <> 0 ELSE true END AS b,
    CASE k % 4 WHEN 0 THEN '5' WHEN 1 THEN {_says('"$name"')} WHEN 2 THEN '[true]' END AS j, CAST(NULL AS DOUBLE) AS gone FROM {_C}""")
def doc_shred_given(spark, sf_dir):
    """A given schema: keys outside it are left out, other kinds give the zero of the type, null stays null."""
    r = F.col("k") % 4
    doc = F.when(r == 0, _text('{"s":5,"i":$k,"d":$k.5,"b":true,"j":5,"extra":1}')).when(r == 1, _text('{"s":"$name","i":"x","d":$k.5,"b":$k,"j":"$name"}')).when(r == 2, _text('{"s":"$name","i":$k,"d":"x","b":true,"j":[true]}')).otherwise(_text('{"s":"$name","i":$k,"d":$k,"b":null,"j":null}'))
    fields = [Field("s", "string"), Field("i", "int64"), Field("d", "double"), Field("b", "boolean", True), Field("j", "json", True), Field("gone", "double", True)]
    return tables.shred(_customers(spark, sf_dir).select("k", doc.alias("doc")), "doc", fields, keep=["k"])


@query(f"SELECT k, name, k AS size, CASE WHEN k % 2 = 0 THEN bal END AS weight, {_says('[\"$name\"]')} AS tags, {_says('{\"x\":$k}')} AS at FROM {_C}")
def doc_shred_class(spark, sf_dir):
    """The flat columns of a class; its lists and classes are JSON text."""
    doc = F.when(F.col("k") % 2 == 0, _text('{"name":"$name","size":$k,"weight":$bal,"tags":["$name"],"at":{"x":$k}}')).otherwise(_text('{"at":{"x":$k},"tags":["$name"],"size":$k,"name":"$name","weight":null}'))
    return tables.shred(_customers(spark, sf_dir).select("k", doc.alias("doc")), "doc", schemas.flat_fields(Leafy), keep=["k"])


_TAGS = ['{"tags":null}', '{"tags":[]}', '{"tags":{}}', '{"tags":["$name",null,"y"]}', '{"tags":7}', "{}", '{"tags":[{}]}']
_TAGS_FIELD = [Field("tags", "list", True, (Field("element", "string", True),))]


@query(f"SELECT k, CASE k % 7 WHEN 1 THEN CAST(0 AS INT) WHEN 3 THEN 3 WHEN 6 THEN 1 END AS n, CASE k % 7 WHEN 3 THEN name END AS first, k % 7 IN (1, 3, 6) AS present FROM {_C}")
def doc_shred_lists(spark, sf_dir):
    """A list that is null, empty, ``{{}}``, filled, no array, missing, or holds ``{{}}``."""
    doc = F.when(F.lit(False), F.lit(""))
    for i, t in enumerate(_TAGS):
        doc = doc.when(F.col("k") % 7 == i, _text(t))
    t = tables.shred(_customers(spark, sf_dir).select("k", doc.alias("doc")), "doc", _TAGS_FIELD, nested=True, keep=["k"])
    return t.select("k", F.when(F.col("tags").isNotNull(), F.size("tags")).alias("n"), F.get("tags", F.lit(0)).alias("first"), F.col("tags").isNotNull().alias("present"))


@query(f"SELECT k, k % 5 IN (1, 2, 4) AS present, CASE WHEN k % 5 = 1 THEN k END AS a, CASE k % 5 WHEN 1 THEN name WHEN 2 THEN '' END AS b FROM {_C}")
def doc_shred_groups(spark, sf_dir):
    """A group that is null, filled, half filled with another kind, ``{{}}``, or no object at all (present, without values)."""
    r = F.col("k") % 5
    doc = F.when(r == 0, F.lit('{"g":null}')).when(r == 1, _text('{"g":{"a":$k,"b":"$name"}}')).when(r == 2, F.lit('{"g":{"b":5}}')).when(r == 3, F.lit('{"g":{}}')).otherwise(F.lit('{"g":5}'))
    fields = [Field("g", "group", True, (Field("a", "int64", True), Field("b", "string", True)))]
    t = tables.shred(_customers(spark, sf_dir).select("k", doc.alias("doc")), "doc", fields, nested=True, keep=["k"])
    return t.select("k", F.col("g").isNotNull().alias("present"), "g.a", "g.b")


@query(f"""SELECT k, k AS id, CAST(k AS DOUBLE) AS p0, k + 0.5::DOUBLE AS p1, CAST(NULL AS VARCHAR) AS t0, name AS t1, CASE WHEN k % 2 = 0 THEN '1' ELSE '[2]' END AS mixed, k AS b, CASE WHEN k % 2 = 1 THEN name END AS late, CAST(NULL AS VARCHAR) AS empty, 2 AS nulls FROM {_C}""")
def doc_shred_tree(spark, sf_dir):
    """Inferred groups and lists in lists, shredded."""
    t = tables.to_table(_nested(spark, sf_dir), "doc", nested=True, keep=["k"], ordinal="k")
    return t.select("k", "id", F.expr("items[0].p").alias("p0"), F.expr("items[1].p").alias("p1"), F.expr("items[0].tags[0]").alias("t0"), F.expr("items[1].tags[0]").alias("t1"), "mixed", F.expr("deep.a.b[1][1]").alias("b"), "late", "empty", F.size("nulls").alias("nulls"))


_SLOTS = {0: [(0, 0, None)], 1: [(0, 1, None)], 2: [(0, 0, None)], 3: [(0, 3, '"$name"'), (1, 2, None), (1, 3, '"y"')], 4: [(0, 0, None)], 5: [(0, 0, None)], 6: [(0, 2, None)]}


@query(" UNION ALL ".join(f"SELECT k, CAST({n} AS BIGINT) AS ord, 'tags.list.element' AS leaf, CAST({rep} AS BIGINT) AS rep, CAST({deep} AS BIGINT) AS def, {_says(v)} AS value FROM {_C} WHERE k % 7 = {i}" for i, slots in _SLOTS.items() for n, (rep, deep, v) in enumerate(slots)))
def doc_levels(spark, sf_dir):
    """Repetition and definition levels of a list in each of its states."""
    doc = F.when(F.lit(False), F.lit(""))
    for i, t in enumerate(_TAGS):
        doc = doc.when(F.col("k") % 7 == i, _text(t))
    return tables.stripe(_customers(spark, sf_dir).select("k", doc.alias("doc")), "doc", _TAGS_FIELD, keep=["k"])


_ORDERS_FIELD = Field("orders", "list", True, (Field("element", "group", True, (Field("id", "int64"), Field("tags", "list", True, (Field("element", "string", True),)))),))


@query(" UNION ALL ".join(f"SELECT k, CAST({n} AS BIGINT) AS ord, '{leaf}' AS leaf, CAST({rep} AS BIGINT) AS rep, CAST({deep} AS BIGINT) AS def, {_says(v)} AS value FROM {_C}" for n, (leaf, rep, deep, v) in enumerate([
    ("orders.list.element.id", 0, 3, "$k"), ("orders.list.element.tags.list.element", 0, 6, '"a"'), ("orders.list.element.tags.list.element", 2, 6, '"$name"'), ("orders.list.element.id", 1, 3, "2"), ("orders.list.element.tags.list.element", 1, 4, None), ("orders.list.element.id", 1, 2, None), ("orders.list.element.tags.list.element", 1, 2, None), ("orders.list.element.id", 1, 3, "3"), ("orders.list.element.tags.list.element", 1, 3, None)])))
def doc_levels_nested(spark, sf_dir):
    """Lists in lists: levels of both leaves, for filled, empty and missing inner lists and a null item."""
    doc = _text('{"orders":[{"id":$k,"tags":["a","$name"]},{"id":2,"tags":[]},null,{"id":3}]}')
    return tables.stripe(_customers(spark, sf_dir).select("k", doc.alias("doc")), "doc", [_ORDERS_FIELD], keep=["k"])


@query("""SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'id', CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'int64', false), (1, 'orders.list.element.id', 3, 1, 'int64', false), (2, 'orders.list.element.tags.list.element', 6, 2, 'string', true), (3, 'g.x', 2, 0, 'json', true)) t(leaf, path, def, rep, kind, nullable)""")
def doc_leaves(spark, sf_dir):
    """The leaves of a schema with their highest levels."""
    fields = [Field("id", "int64"), _ORDERS_FIELD, Field("g", "group", True, (Field("x", "json", True),))]
    return _rows(spark, [(i, p, d, r, k, n) for i, p, d, r, k, n in schemas.annotate(fields)], "leaf long, path string, def long, rep long, kind string, nullable boolean")


@query("SELECT * FROM (SELECT unnest([" + ", ".join(f"{{'ord': CAST({i} AS BIGINT), 'name': '{n}', 'kind': '{kind}', 'nullable': {str(null).lower()}}}" for i, (n, kind, null) in enumerate(_VARIED)) + f"], recursive := true)) f, LATERAL (SELECT CAST(CASE f.name WHEN 'even' THEN count(*) FILTER (k % 2 = 0) WHEN 'some' THEN count(*) FILTER (k % 2 = 1) WHEN 'nul' THEN 0 ELSE count(*) END AS BIGINT) AS present, count(*) AS rows FROM {_C})")
def doc_describe(spark, sf_dir):
    """A table's columns and how many rows hold a value."""
    docs = _varied(spark, sf_dir)
    fields = tables.infer_flat(docs, "doc", ordinal="k")
    return tables.describe(tables.shred(docs, "doc", fields), fields)


# Parquet and streams.

def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(ORACLE_SQL["doc_shred_kinds"])
def doc_parquet_flat(spark, sf_dir):
    """Inferred flat table, written and read back."""
    path = _fresh(spark, "flat")
    docs = _varied(spark, sf_dir)
    fields = tables.infer_flat(docs, "doc", ordinal="k")
    sources.write_parquet(tables.shred(docs, "doc", fields), path)
    return spark.read.schema(schemas.to_struct(fields)).parquet(path)


@query(ORACLE_SQL["doc_shred_tree"])
def doc_parquet_nested(spark, sf_dir):
    """Inferred nested table, written and read back, uncompressed."""
    path = _fresh(spark, "nested")
    sources.write_parquet(tables.to_table(_nested(spark, sf_dir), "doc", nested=True, keep=["k"], ordinal="k"), path, compression="uncompressed")
    t = spark.read.parquet(path)
    return t.select("k", "id", F.expr("items[0].p").alias("p0"), F.expr("items[1].p").alias("p1"), F.expr("items[0].tags[0]").alias("t0"), F.expr("items[1].tags[0]").alias("t1"), "mixed", F.expr("deep.a.b[1][1]").alias("b"), "late", "empty", F.size("nulls").alias("nulls"))


@query(f"SELECT name, k AS size, CASE WHEN k % 2 = 0 THEN bal END AS weight, 1 AS n_tags, name AS tag, k AS x, CAST(NULL AS DOUBLE) AS y FROM {_C}")
def doc_parquet_class(spark, sf_dir):
    """The nested schema of a class, written and read back."""
    doc = F.when(F.col("k") % 2 == 0, _text('{"name":"$name","size":$k,"weight":$bal,"tags":["$name"],"at":{"x":$k}}')).otherwise(_text('{"name":"$name","size":$k,"tags":["$name"],"at":{"x":$k,"y":null}}'))
    path = _fresh(spark, "class")
    sources.write_parquet(tables.shred(_customers(spark, sf_dir).select(doc.alias("doc")), "doc", schemas.nested_fields(Leafy), nested=True), path)
    return spark.read.parquet(path).select("name", "size", "weight", F.size("tags").alias("n_tags"), F.get("tags", F.lit(0)).alias("tag"), "at.x", "at.y")


def _footers(batches):
    import io

    import pyarrow.parquet as pq

    for b in batches:
        for data in b.column(0).to_pylist():
            f = pq.ParquetFile(io.BytesIO(data))
            groups = [f.metadata.row_group(i) for i in range(f.metadata.num_row_groups)]
            kinds = [str(f.schema.column(i).logical_type) for i in range(len(f.schema))]
            yield pa.RecordBatch.from_pydict({"n_rows": pa.array([g.num_rows for g in groups], pa.int64()), "codec": pa.array([g.column(0).compression for g in groups], pa.string()), "types": pa.array([",".join(kinds)] * len(groups), pa.string())})


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, true AS within, 'SNAPPY' AS codec, true AS has_size FROM customer")
def doc_parquet_options(spark, sf_dir):
    """Row groups of at most 400 rows and their codec, from the footers; the writer tells the bytes it has stored."""
    path = _fresh(spark, "options")
    size = sources.write_parquet(tables.shred(_varied(spark, sf_dir), "doc", [Field("k", "int64")]), path, rows_per_group=400, rows_per_page=50)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("content")
    groups = files.mapInArrow(_footers, "n_rows long, codec string, types string")
    return groups.agg(F.sum("n_rows").alias("n_rows"), (F.max("n_rows") <= 400).alias("within"), F.max("codec").alias("codec"), F.lit(size > 0).alias("has_size"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, true AS within, 'UNCOMPRESSED' AS codec, 'None,String,JSON' AS types FROM customer")
def doc_parquet_bytes(spark, sf_dir):
    """Parquet files as binary values; JSON text is annotated as JSON."""
    t = tables.shred(_varied(spark, sf_dir), "doc", [Field("k", "int64"), Field("rx", "string"), Field("mix", "json")])
    files = sources.to_parquet_bytes(t, compression="uncompressed", rows_per_group=300).select("data")
    return files.mapInArrow(_footers, "n_rows long, codec string, types string").agg(F.sum("n_rows").alias("n_rows"), (F.max("n_rows") <= 300).alias("within"), F.max("codec").alias("codec"), F.max("types").alias("types"))


@query(f"SELECT k, CASE WHEN k % 2 = 0 THEN '/x/' ELSE 'y' END AS rx, CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE {_says('\"$name\"')} END AS mix FROM {_C}")
def doc_parquet_sink(spark, sf_dir):
    """A sink of the caller's takes each part; here it puts it into the shared folder."""
    path = _fresh(spark, "sink").removeprefix("file:")

    def sink(part: int, data: bytes) -> None:
        import os

        os.makedirs(path, exist_ok=True)
        with open(f"{path}/part-{part}.parquet", "wb") as out:
            out.write(data)

    fields = [Field("k", "int64"), Field("rx", "string"), Field("mix", "json")]
    sources.write_to_sink(tables.shred(_varied(spark, sf_dir), "doc", fields), sink).agg(F.sum("n_rows")).collect()
    return spark.read.schema(schemas.to_struct(fields)).parquet(path)


def _streamed(spark, sf_dir, fields: list[Field], nested: bool) -> DataFrame:
    """Customers as lines of text, one document or an array of two a line, through a stream into Parquet."""
    given, path, checkpoint = (_fresh(spark, n) for n in ("lines", "stream", "stream-state"))
    record = '{"name":"$name","size":$k,"tags":["$name",null],"at":{"x":$k}}'
    _customers(spark, sf_dir).select(_text(f"[{record},{record}]").alias("value")).where("k % 2 = 0").unionByName(_customers(spark, sf_dir).where("k % 2 = 1").select(_text(record).alias("value"))).write.text(given)
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(given)
    stream_to_parquet(stream, "value", fields, path, checkpoint, nested=nested, available_now=True).awaitTermination()
    return spark.read.schema(schemas.to_struct(fields)).parquet(path)


@query(f"""SELECT name, k AS size, CAST(NULL AS DOUBLE) AS weight, {_says('["$name",null]')} AS tags, {_says('{"x":$k}')} AS at FROM {_C}, range(CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END)""")
def doc_stream_flat(spark, sf_dir):
    return _streamed(spark, sf_dir, schemas.flat_fields(Leafy), False)


@query(f"SELECT name, k AS size, CAST(NULL AS DOUBLE) AS weight, name AS tag, 2 AS n_tags, k AS x FROM {_C}, range(CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END)")
def doc_stream_nested(spark, sf_dir):
    t = _streamed(spark, sf_dir, schemas.nested_fields(Leafy), True)
    return t.select("name", "size", "weight", F.get("tags", F.lit(0)).alias("tag"), F.size("tags").alias("n_tags"), "at.x")
