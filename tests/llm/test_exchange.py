"""Blocks and ranges: tasks that grow with the text, input in no fixed order."""

import os

from pyspark.sql import functions as F

from quillon.llm import common, exchange, suffix_dedup


def test_more_ranges_make_more_tasks_and_the_same_rows(spark, monkeypatch):
    rows = [(i, f"{i % 7} a passage of more than fifty bytes that some of the documents have in common {i % 7} {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, suffix_dedup.repeated_bytes(docs).collect()))
    monkeypatch.setattr(exchange, "RANGES_IN_TASK", 1)
    assert exchange._tasks(spark, 12) == 12 > exchange.shuffle_partitions(spark)
    assert sorted(map(tuple, suffix_dedup.repeated_bytes(docs).collect())) == want
    assert sum(r[2] > 0 for r in want) > 30


def test_what_has_no_fixed_order_is_written_before_it_is_packed(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    assert exchange._as_stored(stored.where("doc_id > 0").select("text"))
    assert not exchange._as_stored(stored.join(docs, "doc_id"))
    assert not exchange._as_stored(stored.groupBy("doc_id").agg(F.max("text").alias("text")))
    assert exchange.pack(stored.join(docs.select("doc_id"), "doc_id"), 1).count() >= 1


def test_steps_can_be_deleted(spark, monkeypatch):
    monkeypatch.setattr(common, "_written", [])
    step = common.materialize(spark.range(3), "some-step")
    (path,) = common._written
    assert step.count() == 3 and os.path.isdir(path.removeprefix("file:"))
    assert common.clear(spark) == 1 and not os.path.exists(path.removeprefix("file:")) and common.clear(spark) == 0
