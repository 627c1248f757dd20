"""The forest against all pairs, at depths that split."""

import numpy as np
import pytest

from quillon.llm import vector_dedup


def clustered(n, dim, seed):
    """Vectors around many centres, some close enough to link and some not."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dim))
    near = rng.choice([0.02, 0.1, 0.2, 0.3], n)
    return centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * near[:, None]


def links_of(x):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    return close


@pytest.mark.parametrize("sample,depth", [(4000, 7), (4000, 12), (600, 12)])
def test_recall_of_leaves(sample, depth):
    """Pairs that share a leaf of some tree, whether nodes have medians of their own or an ancestor's."""
    x = clustered(4000, 24, 5)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    forest = vector_dedup.Forest(unit[:sample], len(unit), leaf=len(unit) / 2**depth)
    assert forest.depth == depth and forest.own == min(depth, int(np.log2(sample / vector_dedup.ENOUGH)))
    row, leaf = forest.leaves(unit)
    members = [[] for _ in range(len(unit))]
    for r, f in zip(row.tolist(), leaf.tolist()):
        members[r].append(f)
    sets = [frozenset(m) for m in members]
    close = np.argwhere(np.triu(links_of(x)))
    assert len(close) > 3000
    found = sum(not sets[a].isdisjoint(sets[b]) for a, b in close.tolist())
    assert found / len(close) >= 0.9
    sizes = np.unique(leaf, return_counts=True)[1]
    assert sizes.max() < 40 * len(unit) / 2**depth + 60


@pytest.mark.parametrize("leaf,most", [(8, 16_384), (64, 32)])
def test_forest_against_all_pairs(spark, leaf, most):
    x = clustered(2000, 16, 7)
    close = links_of(x)
    rows = [(i, list(map(float, v)), "label") for i, v in enumerate(x)]
    got = {r["id"]: r for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf string"), leaf=leaf, most_in_task=most).collect()}
    want = close.sum(1)
    have = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (have <= want).all() and have.sum() >= 0.9 * want.sum() and want.sum() > 2000
    for i in range(len(x)):
        assert got[i]["kept"] == (got[i]["component"] == i) and got[i]["component"] <= i


def test_blocks_of_a_large_leaf_lose_nothing(spark):
    """One leaf, dealt in pairs of blocks: exactly all pairs."""
    rng = np.random.default_rng(9)
    x = np.ones((300, 8)) + rng.normal(size=(300, 8)) * 0.12
    close = links_of(x)
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf=512, most_in_task=40).collect()
    assert close.sum() > 10_000
    assert {r["id"]: r["n_links"] for r in got} == dict(enumerate(close.sum(1).tolist()))


def test_rows_without_ids_are_compared(spark):
    rows = [(5, [1.0, 0.0]), (None, [1.0, 0.0]), (None, [0.0, 1.0]), (None, [0.0, 2.0]), (7, [0.01, 1.0]), (8, [-1.0, 0.0]), (None, [-1.0, -1.0])]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(repr, ((r["id"], r["n_links"], r["component"], r["kept"]) for r in got))) == sorted(map(repr, [(5, 1, 5, True), (None, 1, 5, False), (None, 2, 7, False), (None, 2, 7, False), (7, 2, 7, True), (8, 0, 8, True), (None, 0, None, False)]))
