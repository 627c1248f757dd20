"""Queries of the document engine, and the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import documents as D
from quillon.operators import tables
from quillon.plans import catalogue


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "props")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: one object an order."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return t.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))).alias("doc"))


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: an array of turns each."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return t.select("conv_id", F.to_json("turns", {"ignoreNullFields": "false"}).alias("doc"))


def doc_parse_events(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", D.parse("props").alias("doc"))


def doc_parse_lenient(spark, sf_dir):
    """Texts without their last character and with doubled commas read as if whole."""
    broken = F.concat(F.lit(",,"), F.expr("left(props, length(props) - 1)"))
    return _events(spark, sf_dir).select("event_id", D.parse(broken).alias("doc"))


def doc_extract(spark, sf_dir):
    d = _orders(spark, sf_dir).select(D.extract("doc", key=("int", "key"), status=("string", "status"), price=("double", "price"), cust=("double", "cust"), gone=("boolean", "gone"), none=("int", "gone")).alias("x"))
    return d.select("x.*")


def doc_edit(spark, sf_dir):
    edited = D.edit("props", D.set_key("type", F.to_json(F.struct("event_type"))), D.rename("k", "kk"), D.set_key("none", None), D.clean())
    return _events(spark, sf_dir).select("event_id", edited.alias("doc"))


def doc_sort_keys(spark, sf_dir):
    """A key removed, one nested object added, keys in order: one pass."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    doc = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("key")))
    chain = (D.remove_key("price"), D.set_key("by", {"zone": 1, "a": [2, 1]}), D.sorted_keys())
    return t.select("o_orderkey", D.edit(doc, *chain).alias("doc"))


def doc_infer_flat(spark, sf_dir):
    found = tables.infer_flat(_orders(spark, sf_dir), "doc", ordinal="o_orderkey")
    return spark.createDataFrame([(i, f.name, f.kind, f.nullable) for i, f in enumerate(found)], "ord long, name string, kind string, nullable boolean")


def doc_shred_flat(spark, sf_dir):
    return tables.to_table(_orders(spark, sf_dir), "doc", ordinal="o_orderkey")


def doc_shred_nested(spark, sf_dir):
    t = tables.to_table(_talks(spark, sf_dir), "doc", nested=True, keep=["conv_id"], ordinal="conv_id")
    return t.select("conv_id", "turn", "role", "text")


QUERIES = {f.__name__: f for f in (doc_parse_events, doc_parse_lenient, doc_extract, doc_edit, doc_sort_keys, doc_infer_flat, doc_shred_flat, doc_shred_nested)} | catalogue.QUERIES

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
ORACLE_SQL = catalogue.ORACLE_SQL | {
    "doc_sort_keys": "SELECT o_orderkey, '{\"by\":{\"a\":[2,1],\"zone\":1},\"key\":' || o_orderkey || ',\"cust\":' || o_custkey || ',\"status\":\"' || o_orderstatus || '\"}' AS doc FROM orders",
    "doc_parse_events": f"SELECT event_id, '{{\"k\":' || {_K} || '}}' AS doc FROM events",
    "doc_parse_lenient": f"SELECT event_id, '{{\"k\":' || {_K} || '}}' AS doc FROM events",
    "doc_extract": "SELECT o_orderkey AS key, o_orderstatus AS status, o_totalprice AS price, CAST(o_custkey AS DOUBLE) AS cust, false AS gone, CAST(NULL AS BIGINT) AS \"none\" FROM orders",
    "doc_edit": f"SELECT event_id, '{{\"kk\":' || {_K} || ',\"type\":{{\"event_type\":\"' || event_type || '\"}}}}' AS doc FROM events",
    "doc_infer_flat": "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'key', 'int64', false), (1, 'cust', 'int64', false), (2, 'status', 'string', false), (3, 'price', 'double', false)) t(ord, name, kind, nullable)",
    "doc_shred_flat": "SELECT o_orderkey AS key, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price FROM orders",
    "doc_shred_nested": "SELECT conv_id, turn, role, text FROM conversations",
}
