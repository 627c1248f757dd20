"""Prefixes of the fingerprints: their length, and which of them are crowded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import simhash


def test_a_million_spread_fingerprints_crowd_no_prefix(spark, monkeypatch):
    written = []
    keep = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name="step": written.append(name) or keep(df, name))
    simhash.fingerprint_links(spark.range(1_040_000).select(F.xxhash64("id").alias("fp")))
    assert "balls" not in written  # nothing is dealt a second time


@pytest.mark.parametrize("n", [0, 1, 10**5, 3 * 10**6, 10**8, 10**10])
def test_average_prefix_stays_far_from_crowded(n):
    bits = simhash._bits_for(n)
    assert n * (2 + 2 * bits + bits * (bits - 1) // 2) / 2**bits <= simhash.CROWDED / 2


def test_crowds_are_the_prefixes_with_many_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 60)
    rng = np.random.default_rng(8)
    near = np.uint64(0xF0 << 56) ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64))
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 64, 100, np.uint64), near])).view(np.int64)
    distinct = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    want = {}
    for x in fps.view(np.uint64).tolist():
        for most in (1, 2):
            for mask, _ in simhash._flips(0, 6, most):
                want[(x >> 58) ^ mask] = want.get((x >> 58) ^ mask, 0) + 1
    got = {r.key for r in simhash._first_crowds(distinct, 6).collect()}
    assert got == {k for k, n in want.items() if n > 60}
    assert 0 < len(got) < 64


@pytest.mark.parametrize("bits", [6, 20])
def test_links_connect_what_all_pairs_do(spark, bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 1 << 64, 40, np.uint64)
    rows = [base]
    for _ in range(12):
        flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3, 40)).astype(np.uint64), axis=0)
        rows.append(rows[-1] ^ flips)
    fps = np.unique(np.concatenate(rows))
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    found = simhash.fingerprint_links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), bits).toPandas()
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    links = np.array([(at[a], at[b]) for a, b in zip(found["a"], found["b"])])

    def roots(pairs):
        label = np.arange(len(fps))
        for _ in range(len(fps)):
            np.minimum.at(label, pairs[:, 0], label[pairs[:, 1]])
            np.minimum.at(label, pairs[:, 1], label[pairs[:, 0]])
        return label.tolist()

    assert roots(links) == roots(near)
