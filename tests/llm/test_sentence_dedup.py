"""Repeated spans against a plain version, and planted passages that begin and end inside sentences."""

import hashlib
import random
import re

import duckdb
import pytest

from quillon.llm import queries
from quillon.llm.sentence_dedup import remove_repeated_spans

TOKEN = re.compile(r"[ \t\r\f\v]*[^ \t\r\f\v\n.!?]+[.!?]*|[ \t\r\f\v]*[.!?\n]+|[ \t\r\f\v]+")


def parts(text):
    """(tokens, parts as lists of token numbers)."""
    tokens, found, own = TOKEN.findall(text), [], []
    for k, t in enumerate(tokens):
        word = t.lstrip(" \t\r\f\v")
        is_word = bool(word) and word[0] not in ".!?\n"
        if is_word:
            own.append(k)
        if not is_word or word[-1] in ".!?" or hashlib.md5(word.encode()).hexdigest()[0] < "4":
            if own:
                found.append(own)
            own = []
    return tokens, found + ([own] if own else [])


def brute_force(rows, run=3, least=25):
    """Kept texts and counts, by the definition."""
    runs, first = [], {}
    for place, (doc, text) in enumerate(rows):
        tokens, own = parts(text or "")
        said = [" ".join(tokens[k].lstrip(" \t\r\f\v") for k in p) for p in own]
        weight = [max(s.count(" ") + 1, len(s.encode()) // 12) for s in said]
        mine = []
        for i in range(len(own)):
            for j in range(i + run, len(own) + 1):
                if sum(weight[i:j]) >= least:
                    mine.append((i, j))
                    break
        if not mine and own:
            mine = [(0, len(own))]
        for i, j in mine:
            key = tuple(said[i:j])
            runs.append((place, doc, i, j, key))
            at = (doc is None, doc or 0, i)
            first[key] = min(first.get(key, at), at)
    gone = [set() for _ in rows]
    for place, doc, i, j, key in runs:
        if first[key] != (doc is None, doc or 0, i):
            gone[place].update(range(i, j))
    out = []
    for (doc, text), g in zip(rows, gone):
        tokens, own = parts(text or "")
        drop = {k for n in g for k in own[n]}
        out.append((doc, None if text is None else "".join(t for k, t in enumerate(tokens) if k not in drop), len(own), len(g)))
    return out


def words(rnd, n):
    return [rnd.choice("abcdefghijklmnopqrstuvwxyz") + rnd.choice(["ar", "el", "ono", "isk", "umpa"]) + str(rnd.randrange(40)) + rnd.choice(["", "", "", "", ",", "."]) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    passages = [words(rnd, n) for n in (51, 55, 60, 80, 150)]
    made = [(None, "no id. No id? no!"), (1, None), (2, ""), (3, " \n "), (4, "Short text."), (5, "Short  text."), (6, "Oi. Yes. No."), (7, "Oi. Yes. No. Oi. Yes. No."), (8, "long" * 40_000)]
    for i in range(80):
        own = words(rnd, rnd.randint(5, 120))
        if i % 2:
            at = rnd.randrange(len(own))
            own[at:at] = passages[i % len(passages)]
        made.append((10 + i, rnd.choice([" ", "\n"]).join([" ".join(own[: len(own) // 2]), " ".join(own[len(own) // 2 :])])))
    return made + [made[20], (500, made[20][1]), (None, made[30][1]), (8, "")]


def test_same_as_the_definition(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in remove_repeated_spans(docs).select("doc_id", "text", "n_sentences", "n_removed").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_force(rows)))


def test_passages_inside_sentences_are_caught(rows):
    """Of the later documents with a passage all lose it, and hardly a clean one loses anything."""
    lost = {doc: n for doc, _, _, n in brute_force(rows) if doc and 10 <= doc < 90}
    assert all(lost[10 + i] for i in range(11, 80, 2))
    assert not any(lost[10 + i] for i in range(0, 80, 2))


def test_same_as_sql(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(queries.ORACLE_SQL["op1_sentence_span_dedup"])
    got = queries.QUERIES["op1_sentence_span_dedup"](spark, str(tmp_path))
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 7, "x", "y"), (2, None, 8, "x", "y")], "doc_id long, text string, n_removed int, block string, part string")
    got = remove_repeated_spans(docs)
    assert got.columns == ["doc_id", "text", "block", "part", "n_sentences", "n_removed"]
    assert sorted(map(tuple, got.collect())) == [(1, "a", "x", "y", 1, 0), (2, None, "x", "y", 0, 0)]
    assert remove_repeated_spans(docs.limit(0)).count() == 0
