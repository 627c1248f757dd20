import duckdb
import pytest

from quillon.llm import mixing, queries


@pytest.mark.parametrize("on_driver", [mixing.MAX_CELLS, 100])
def test_no_source_is_dropped_however_many_there_are(spark, tmp_path, monkeypatch, on_driver):
    monkeypatch.setattr(mixing, "MAX_CELLS", on_driver)
    monkeypatch.setattr(mixing, "ROUNDS", 2)
    monkeypatch.setattr(mixing.fit_weights, "__defaults__", (2,))
    monkeypatch.setattr(mixing.mix, "__defaults__", (*mixing.mix.__defaults__[:-2], 2, "__mix"))
    rows = [(i, "word " * (1 + i % 7) + f"w{i % 50}", f"l{i % 60}", f"s{i % 1200}" if i % 9 else None, 9) for i in range(2400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.QUERIES["op9_mix_sources"](spark, str(tmp_path)).collect()]
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(queries._op9_sql()).fetchall()
    near = lambda r: (*r[:5], pytest.approx(r[5], abs=2e-6), pytest.approx(r[6], abs=2e-6))
    assert [r[:7] for r in sorted(got)] == [near(r) for r in sorted(want)]
    assert all(r[6] > 0 for r in got)
    assert sum(a[7] != b[7] for a, b in zip(sorted(got), sorted(want))) == 0


def test_given_targets_alike_on_driver_and_apart(spark, monkeypatch):
    rows = [(i, "a b c " * (i % 5), f"s{i % 4}", f"l{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    run = lambda: {r["doc_id"]: (r["__mix"]["weight"], r["__mix"]["probability"]) for r in mixing.mix(docs, [docs["source"], docs["lang"]], [{"s0": 0.5, "s1": 0.2}, {"l0": 0.1, "l2": 0.8}], budget=40, rounds=3).collect()}
    want = run()
    monkeypatch.setattr(mixing, "MAX_CELLS", 1)
    got = run()
    assert {k: pytest.approx(v, abs=2e-6) for k, v in want.items()} == got


def test_clashing_columns_and_odd_rows(spark):
    rows = [(1, "a b", "s", 1), (2, None, None, 1), (None, "", "t", 1), (1, "a b", "s", 1), (3, "x " * 100_000, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int")
    for c in ("__mix", "doc", "d0", "d1", "u", "weight", "probability", "__doc", "__u"):
        docs = docs.withColumn(c, docs["source"])
    got = mixing.mix(docs, [docs["source"], mixing.topic_of()])
    assert got.columns == [*(c for c in docs.columns if c != "__mix"), "__mix"]
    found = got.collect()
    assert len(found) == 5 and all(r["u"] == r["source"] and r["tokens"] == 1 for r in found)
    assert {r["doc_id"]: r["__mix"]["tokens"] for r in found} == {1: 2, 2: 0, None: 0, 3: 100_000}
    assert mixing.mix(docs.limit(0), [docs["source"]]).count() == 0


@pytest.mark.parametrize("text,want", [(None, "brief"), ("", "brief"), ("a | b | c | d | e | f", "table"), ("What? Who! When.", "questions"), ("some words", "brief"), ("some words. " * 40, "prose")])
def test_kinds_of_text(spark, text, want):
    assert spark.createDataFrame([(text,)], "text string").select(mixing.topic_of().alias("t")).first().t == want
