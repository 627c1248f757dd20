"""Near-duplicate vectors by a forest of random-projection trees with spill.

Each tree splits the vectors again and again at the median of a random projection; those near a
median go to both sides. Vectors that share a leaf of some tree are compared, links that hold
are united. Copies of one vector are one class with a count.

The depth follows the number of vectors, whatever the sample's size: nodes that hold too little of
the sample to have a median of their own take it, for the projection of their level, from the
deepest node above them that holds enough. A leaf that still outgrows the limit, as a dense
cluster makes it, is dealt in pairs of blocks, so that its work is spread and all of it is done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize
from quillon.llm.components import connected_components, spanning_stars

TREES, LEAF, SPILL = 6, 512, 0.05
#: The trees' medians come from at most so many vectors (and bytes of vectors), those with the smallest hashes; every vector is routed.
SAMPLE, SAMPLE_BYTES = 50_000, 64 << 20
#: Vectors of the sample that a node's median comes from.
ENOUGH = 64
#: Vectors in one task of a leaf; a larger leaf is dealt in pairs of blocks of about half as many.
MOST_IN_TASK = 16_384
_BLOCK = 1024
#: Classes without ids have numbers from here on.
_NAMELESS = 1 << 62


class Forest:
    """Splits of all trees: a projection for each level and, for each node, two thresholds (high, low) around its median."""

    def __init__(self, sample: np.ndarray, total: int, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = 1):
        self.dim = sample.shape[1]
        self.depth = int(np.clip(np.ceil(np.log2(max(1, total) / leaf)), 0, 48)) if len(sample) else 0
        #: Levels whose nodes have their own medians; below them they are taken from the ancestor at this level.
        self.own = min(self.depth, max(0, int(np.floor(np.log2(max(1, len(sample)) / ENOUGH)))))
        self.seed, self.trees = seed, trees
        self.high, self.low, self.below_high, self.below_low = [], [], [], []
        for t in range(trees):
            z = sample @ self.directions(t)
            high, low = np.full(1 << self.own, np.nan), np.full(1 << self.own, np.nan)
            deep = [np.full((1 << self.own, self.depth - self.own), np.nan) for _ in range(2)]
            groups = {1: np.arange(len(sample))}
            for level in range(self.own):
                below = {}
                for node, rows in groups.items():
                    own = z[rows, level]
                    if len(rows) < 8 or own.min() == own.max():
                        continue  # a leaf: nothing to split
                    low[node], mid, high[node] = np.quantile(own, [0.5 - spill, 0.5, 0.5 + spill])
                    below[2 * node], below[2 * node + 1] = rows[own <= mid], rows[own > mid]
                groups = below
            for node, rows in groups.items():
                if self.depth > self.own and len(rows) >= 8:
                    deep[0][node - (1 << self.own)], deep[1][node - (1 << self.own)] = np.quantile(z[rows, self.own :], [0.5 + spill, 0.5 - spill], axis=0)
            self.high.append(high)
            self.low.append(low)
            self.below_high.append(deep[0])
            self.below_low.append(deep[1])

    def directions(self, tree: int) -> np.ndarray:
        return np.random.default_rng((self.seed, tree)).standard_normal((self.dim, max(1, self.depth)))

    def _thresholds(self, tree: int, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if level < self.own:
            return self.high[tree][nodes], self.low[tree][nodes]
        above = (nodes >> (level - self.own)) - (1 << self.own)
        return self.below_high[tree][above, level - self.own], self.below_low[tree][above, level - self.own]

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row reaches; leaves are numbered over all trees."""
        rows_out, leaves_out = [], []
        for t in range(self.trees):
            z = x @ self.directions(t)
            rows, nodes = np.arange(len(x)), np.ones(len(x), np.int64)
            for level in range(self.depth):
                high, low = self._thresholds(t, level, nodes)
                stop = np.isnan(high)
                rows_out.append(rows[stop])
                leaves_out.append((nodes[stop] << 8) | t)
                own = z[rows, level]
                left, right = ~stop & (own <= high), ~stop & (own >= low)
                rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * nodes[left], 2 * nodes[right] + 1])
            rows_out.append(rows)
            leaves_out.append((nodes << 8) | t)
        return np.concatenate(rows_out), np.concatenate(leaves_out)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors in double precision, one row each."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _route(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1 << 14):
                part = b.slice(at, 1 << 14)
                if not part.num_rows:
                    continue
                row, leaf = forest.leaves(_matrix(part.column(2)))
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                own = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(leaf, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), own], ["cls", "n", "vec", "leaves"])

    return run


def _compare(threshold: float):
    """In one leaf: for each vector with links there, its smallest linked representative and the vectors counted here.

    A pair that shares several leaves counts in the one with the smallest number, so sums over
    leaves count it once, without the pairs being shuffled.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        leaf, one, two = (k.as_py() for k in key)
        cls, n, block = table["cls"].to_numpy(), table["n"].to_numpy(), table["block"].to_numpy()
        x = _matrix(table["vec"])
        lists = table["leaves"].to_pylist()
        own = np.full((len(cls), max(map(len, lists), default=1)), -1, np.int64)
        for i, v in enumerate(lists):
            own[i, : len(v)] = v
        links = np.zeros(len(cls), np.int64)
        a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(cls), _BLOCK):
            for to in range(at, len(cls), _BLOCK):
                i, j = np.nonzero(x[at : at + _BLOCK] @ x[to : to + _BLOCK].T >= threshold)
                i, j = i + at, j + to
                # of a pair of different blocks only what lies between them: within a block another task looks
                new = (i < j) if one == two else (i < j) & (block[i] != block[j])
                i, j = i[new], j[new]
                if not len(i):
                    continue
                node, root = spanning_stars(i, j)
                a_out.append(node)
                b_out.append(root)
                for k in range(0, len(i), 1 << 14):
                    p, q = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                    same = (own[p][:, :, None] == own[q][:, None, :]) & (own[p] >= 0)[:, :, None]
                    first = np.where(same.any(2), own[p], np.iinfo(np.int64).max).min(1) == leaf
                    np.add.at(links, p[first], n[q[first]])
                    np.add.at(links, q[first], n[p[first]])
        a, b = np.concatenate(a_out), np.concatenate(b_out)
        low, high = np.minimum(cls[a], cls[b]), np.maximum(cls[a], cls[b])
        node, root = spanning_stars(high, low)
        counted = np.flatnonzero(links)
        return pa.table({"node": np.concatenate([node, cls[counted]]), "root": np.concatenate([root, cls[counted]]), "links": np.concatenate([np.zeros(len(node), np.int64), links[counted]])})

    return run


def _of_one_size(classes: DataFrame, total: int, dim: int, threshold: float, trees: int, leaf: int, spill: float, most_in_task: int) -> DataFrame:
    most = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    picked = classes.select("cls", "vec").orderBy(F.xxhash64("cls"), "cls").limit(most).toArrow()
    sample = _matrix(picked["vec"]) if picked.num_rows else np.zeros((0, dim))
    routed = classes.select("cls", "n", "vec").mapInArrow(_route(Forest(sample, total, trees, leaf, spill)), f"cls long, n long, vec {classes.schema['vec'].dataType.simpleString()}, leaves array<bigint>")
    routed = materialize(routed, "routed")
    sizes = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().where(F.col("count") > most_in_task)
    large = sizes.select(F.col("leaf").alias("l"), F.ceil(F.col("count") * 2 / most_in_task).cast("int").alias("blocks"))
    dealt = routed.select("cls", "n", "vec", "leaves", F.explode("leaves").alias("leaf"))
    # a leaf within the limit is one block; the table of larger ones has at most a row for each ``most_in_task`` leaf entries
    dealt = dealt.join(large, F.col("leaf") == F.col("l"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cls", "leaf"), F.col("blocks")).cast("int"))
    with_all = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = dealt.withColumn("other", F.explode(with_all))
    pairs = pairs.select("leaf", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "cls", "n", "vec", "leaves", "block")
    return pairs.groupBy("leaf", "one", "two").applyInArrow(_compare(threshold), "node long, root long, links long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """(id, n_links, component, kept) for every row.

    Two vectors link if they share a leaf and their cosine in double precision is at least
    ``threshold``. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, and vectors of different sizes not with each other. ``component`` is the
    smallest id reachable, ``kept`` whether that is the row's own. Ids are whole numbers under 2 ** 62;
    a row with a null id counts in its partners' links and is not kept, and only null ids being
    reachable gives a null component. Repeated rows are copies like others; an empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    v = F.col(vec_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vec"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = rows.withColumn("h", F.when(F.col("fine"), F.xxhash64("vec"))).withColumn("g", F.when(F.col("fine"), F.xxhash64(F.lit(1), "vec")))
    nameless = F.lit(_NAMELESS) + F.shiftrightunsigned("h", 2)  # a class of rows without ids only
    classes = materialize(rows.where("fine").groupBy("h", "g").agg(F.coalesce(F.min("id"), nameless).alias("cls"), F.count("*").alias("n"), F.first("vec").alias("vec")), "classes")
    sizes = classes.groupBy(F.size("vec").alias("dim")).count().orderBy("dim").collect()
    found = None
    for dim, total in sizes:
        part = _of_one_size(classes.where(F.size("vec") == dim), total, dim, threshold, trees, leaf, spill, most_in_task)
        found = part if found is None else found.union(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "node long, root long, links long")
    found = materialize(found, "vector-links")
    labels = connected_components(found.where("node <> root"), "node", "root").select(F.col("node").alias("l_node"), F.col("root").alias("l_root"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("h", "g", "cls", "n").join(counts, F.col("cls") == F.col("node"), "left").join(labels, F.col("cls") == F.col("l_node"), "left")
    named = named.select(F.col("h").alias("ch"), F.col("g").alias("cg"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("l_root", "cls").alias("component"))
    out = rows.select("id", "h", "g").join(named, (F.col("h") == F.col("ch")) & (F.col("g") == F.col("cg")), "left")
    own = F.when(F.col("component") >= _NAMELESS, F.lit(None)).otherwise(F.coalesce("component", "id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))
