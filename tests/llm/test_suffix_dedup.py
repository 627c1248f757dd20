import hashlib
import random

import numpy as np

from quillon.llm import suffix_dedup


def brute(rows, width=50):
    first = {}
    order = 1 << 62
    for i, t in rows:
        b, i = (t or "").encode(), order if i is None else i
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b, k = (t or "").encode(), order if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < k:
                gone[p : p + width] = b"\x01" * width
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=7, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "and", "thin", "ger", "é", "ñandú", "stion", "ab", "wh", "ere", "ou"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [text(rng.randint(8, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.2 and rows:
            t = rng.choice(rows)[1]
        elif kind < 0.6:
            t = text(rng.randint(0, 40)) + rng.choice(passages)[rng.randint(0, 9) :] + text(rng.randint(0, 40)) + rng.choice(passages)
        elif kind < 0.7:
            t = rng.choice("ab") * rng.randint(0, 200)
        else:
            t = text(rng.randint(0, 120))
        rows.append((i * 3 % 101, t))
    return rows + [(500, None), (501, ""), (None, rows[3][1]), (7, "x" * 49), (8, "x" * 50), (9, "y" + "x" * 50 + "z"), rows[5]]


def test_same_as_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id").selectExpr("doc_id", "text", "1 AS part", "'x' AS id").repartition(3)
    got = sorted((tuple(r) for r in suffix_dedup.repeated_bytes(df).collect()), key=repr)
    assert got == brute(rows)


def test_crowded_ranks_are_dealt_by_window(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWDED", 1)
    rows = corpus(11, 60)
    got = sorted((tuple(r) for r in suffix_dedup.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()), key=repr)
    assert got == brute(rows)


def test_empty_table(spark):
    assert suffix_dedup.repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefix_doubling_ranks():
    text = np.frombuffer(b"abcdefghij" * 7 + b"qrstuvwxyz" * 6, np.uint8)
    ends = np.full(len(text), len(text))
    rank = suffix_dedup.double_prefixes(text, ends, 50)
    for p in range(len(text)):
        own = text[p : p + 50].tobytes()
        others = sum(text[q : q + 50].tobytes() == own for q in range(len(text) - 49)) if len(own) == 50 else 0
        assert (rank[p] >= 0) == (others > 1)


def test_remove_keeps_columns_and_drops_what_is_empty(spark):
    p = "A passage of more than fifty bytes that is found in both documents."
    rows = [(1, "first " + p, "a"), (2, p, "b"), (3, "clean", "c"), (4, None, "d"), (5, p + " end", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["source"]) for r in suffix_dedup.remove_repeated(df).collect()}
    assert got == {1: ("first " + p, "a"), 3: ("clean", "c"), 4: (None, "d"), 5: (" end", "e")}
