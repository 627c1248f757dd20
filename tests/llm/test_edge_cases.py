"""Nulls, empty texts and tables, ties, repeated rows and clashing column names."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import decontaminate, queries, simhash, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
CLEAN = "The quick brown fox jumps over the lazy dog near the old mill by the river bank this morning."
ITEM = "seven wise owls sat quietly upon the broken northern wall of our ancient stone house"
ROWS = [
    (1, CLEAN, "en", "a", 0), (2, CLEAN, "en", "a", 0), (2, CLEAN, "en", "a", 0), (3, None, None, None, None), (4, "", "en", "b", 0),
    (5, f"Once, {ITEM}, and all was well with every one of them for a long while after that day had gone by.", "en", "b", 0),
    (None, "a row without an id", "de", "c", 0), (6, "x " * 30_000, "de", "c", 0), (7, "é" * 40, "fr", "d", 0),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A full folder of tables and one of empty tables."""
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("full", "empty"))
    made = {
        "documents": (ROWS, SCHEMA),
        "benchmark": ([(1, ITEM), (2, None), (3, ""), (1, ITEM), (None, "one two")], "item_id long, text string"),
        "labels": ([(1, 1, 0), (5, 1, 1), (5, 0, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int"),
        "pages": ([(1, "http://a", None), (2, None, ""), (None, "http://b", f"<html><body><article><p>{CLEAN} {CLEAN}</p></article></body></html>"), (3, "http://c", "<p>&amp; <"), (3, "http://c", "<p>&amp; <")], "page_id long, url string, html string"),
        "embeddings": ([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (None, [1.0, 0.0]), (5, [1e300, 1.0]), (6, [1.0])], "vec_id long, embedding array<double>"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{full}/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{empty}/{name}.parquet")
    return full, empty


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_row_of_odd_tables_comes_back_and_empty_tables_give_none(spark, tables, name):
    full, empty = tables
    table = {"6": "pages", "7": "pages", "8": "embeddings"}.get(re.match(r"op(\d+)", name)[1], "documents")
    got = queries.QUERIES[name](spark, full)
    if name != "op2_license_scan":  # reports what it finds, not one row for each document
        assert got.count() == spark.read.parquet(f"{full}/{table}.parquet").count()
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql_on_odd_rows(spark, tables, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables[0]}/{t}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, tables[0])
    want = db.sql(queries.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_extra_columns_with_clashing_names_stay(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("id", "fp", "component", "k", "y", "score", "part", "block", "n", "runs", "items", "h", "g", "root", "node", "first", "rest"):
        docs = docs.withColumn(c, F.lit(c))
    items, model = spark.createDataFrame([(1, ITEM)], "item_id long, text string"), toxicity.Model({}, -3.0)
    for out in (simhash.keep_one_of_each(docs, words=5), suffix_dedup.remove_repeated(docs), decontaminate.remove_contamination(docs, items), toxicity.drop_toxic(docs, model)):
        assert out.columns == docs.columns
        assert all(r["fp"] == "fp" and r["runs"] == "runs" and r["block"] == "block" for r in out.collect())


def test_pipeline_keeps_the_clean_and_cuts_the_item(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables[0])
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert kept[1] == CLEAN and 2 not in kept
    assert 5 not in kept or ITEM not in kept[5]
    assert corpus_pipeline.run(spark, tables[1]).count() == 0


def test_items_in_several_passes_are_cut_alike(spark):
    other = "a second item of ten words that stands in another block of items"
    docs = spark.createDataFrame([(1, f"{CLEAN} {ITEM} {CLEAN} {other} {CLEAN}"), (2, CLEAN), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, other)], "item_id long, text string").coalesce(1)
    found = decontaminate.find_contamination(docs, items, block_words=5, cut=True)
    got = {r["id"]: (r["text"], len(r["runs"]), r["items"]) for r in found.collect()}
    assert got == {1: (f"{CLEAN}  {CLEAN}  {CLEAN}", 2, [1, 2]), 2: (CLEAN, 0, []), 3: (None, 0, [])}


def test_swapped_terms_score_alike():
    texts = [(f"the {g} people are idiot scum here." if k % 2 else f"many women and {g} people live in town {k}.").encode() for k in range(200) for g in ("muslim", "jewish")]
    labels = [k % 2 for k in range(200) for _ in range(2)]
    model = toxicity.fit(texts, labels)
    assert model.score("some idiot scum") > 0.7 > model.score("many hindu women live here")
    assert abs(model.score("women live in town") - model.score("men live in town")) < 0.1
