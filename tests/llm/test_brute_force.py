"""Corpus queries against brute force on small fixtures."""

import random
import re
import struct

import numpy as np
import pytest
import xxhash

from quillon.llm import queries, simhash


def smallest_reachable(n, linked):
    group = list(range(n))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in linked:
        a, b = top(a), top(b)
        group[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = [list(map(float, base[i % 40] + rng.normal(size=16) * (0.02 if i < 120 else 0.25))) for i in range(200)]
    rows[50:56] = [None, [0.0] * 16, [float("nan")] + rows[0][1:], [None] + rows[0][1:], rows[0], rows[0]]
    spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    good = [i for i, r in enumerate(rows) if r and None not in r and np.isfinite(r).all() and any(r)]
    m = np.array([rows[i] for i in good])
    m /= np.linalg.norm(m, axis=1)[:, None]
    cos = m @ m.T
    linked = [(good[a], good[b]) for a in range(len(good)) for b in range(a) if cos[a, b] >= 0.95]
    assert len(linked) > 100
    n_links = [sum(i in pair for pair in linked) for i in range(len(rows))]
    component = smallest_reachable(len(rows), linked)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.QUERIES["op8_vector_forest"](spark, str(tmp_path)).collect()}
    assert got == {i: (n_links[i], component[i], component[i] == i) for i in range(len(rows))}


def fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("crowded", [simhash.CROWDED, 40])
def test_simhash(spark, tmp_path, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(80)]
    texts = [None, "", "One", "one two", " one\ttwo ", "É ü"]
    for _ in range(20):
        base = [rnd.choice(words) for _ in range(rnd.randint(3, 250))]
        texts += [" ".join(base), " ".join(base).upper()]
        for _ in range(3):
            base = list(base)
            base[rnd.randrange(len(base))] = "changed"
            texts.append(" ".join(base))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    fps = [fingerprint(t) for t in texts]
    linked = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    component = smallest_reachable(len(fps), linked)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op5_simhash_ball"](spark, str(tmp_path)).collect()}
    assert got == {i: (struct.pack(">Q", fps[i]).hex(), component[i]) for i in range(len(fps))}
