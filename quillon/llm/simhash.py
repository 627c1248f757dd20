"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Two fingerprints at 3 or fewer differing bits have a middle string that is at most 2 flips
from one and at most 1 flip from the other. Every distinct fingerprint therefore sends out its
ball of radius 2 and its ball of radius 1, and the balls meet where a string is in both.

The strings of a ball are not shuffled one by one. They are dealt by their leading bits: a
fingerprint goes to each prefix that a string of its ball has, with the number of flips left,
and the task that owns the prefix enumerates the rest. Prefixes are as long as the number of fingerprints
asks, so that an average one stays far from crowded. Prefixes with too many fingerprints
(dense groups of near copies) are dealt again by the next bits, until whole strings are keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import as_bytes, materialize
from quillon.llm.components import connected_components, spanning_stars

#: Rows that an average prefix gets at most, and rows above which a prefix is dealt out by more bits.
PER_PREFIX, CROWDED = 80_000, 200_000
_BLOCK = 512
_FOLDED = 20


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles; 0 if it has no words.

    A-Z are lower-cased, words are runs of other than space and \\x09-\\x0D, shingles are joined
    by spaces and counted as often as they occur; a shorter text is one shingle.
    """
    from xxhash import xxh64_intdigest

    found = as_bytes(text).lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    pairs = zip(starts[:n].tolist(), ends[min(words, len(found)) - 1 :].tolist())
    hashes = np.fromiter((xxh64_intdigest(line[s:e], seed) for s, e in pairs), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long. Null texts count as empty; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, fp long")


def _flips(low: int, bits: int, most: int) -> list[tuple[int, int]]:
    """(mask, number of flips) for up to ``most`` flips among ``bits`` bits above bit ``low``."""
    return [(sum(1 << (low + p) for p in some), k) for k in range(most + 1) for some in combinations(range(bits), k)]


def _deal(balls: DataFrame, low: int, bits: int) -> DataFrame:
    """Send each (fp, key, left, wide) to the longer prefixes its ball reaches; bits below ``low`` stay open."""
    masks = F.array(*[F.struct(F.lit(m - (1 << 64) if m >> 63 else m).alias("m"), F.lit(k).alias("k")) for m, k in _flips(low, bits, 2)])
    rows = balls.withColumn("x", F.explode(F.filter(masks, lambda x: x["k"] <= F.col("left"))))
    flipped = F.col("fp").bitwiseXOR(F.col("x.m"))
    own = F.shiftrightunsigned(F.shiftleft(flipped, 64 - low - bits), 64 - bits)
    key = F.shiftleft(F.col("key"), bits).bitwiseOR(own) if low + bits < 64 else own
    return rows.select("fp", key.alias("key"), (F.col("left") - F.col("x.k")).alias("left"), "wide")


def _masks(low: int, flips: int) -> np.ndarray:
    return np.array([m for m, _ in _flips(0, low, flips)], np.uint64)


def _ball(fps: np.ndarray, low: int, flips: int) -> np.ndarray:
    """The lowest ``low`` bits of each fingerprint with up to ``flips`` of them flipped, one row for each; the key has the rest."""
    return (fps & np.uint64((1 << low) - 1))[:, None] ^ _masks(low, flips)[None, :]


def _fold(x: np.ndarray) -> np.ndarray:
    """Strings folded to ``_FOLDED`` bits; the fold of a flipped string is the fold of the string flipped by that of the mask."""
    out = _CODES[0][x & np.uint64(255)]
    for j in range(1, 8):
        out ^= _CODES[j][(x >> np.uint64(8 * j)) & np.uint64(255)]
    return out


def _codes() -> np.ndarray:
    bits = np.random.default_rng(64).integers(0, 1 << _FOLDED, (8, 8))
    out = np.zeros((8, 256), np.int64)
    for j in range(8):
        for b in range(8):
            out[j] ^= np.where(np.arange(256) >> b & 1, bits[j, b], 0)
    return out


_CODES = _codes()


def _meet(low: int):
    """For one prefix: where balls of radius 1 and 2 share a string, link their fingerprints."""

    def run(table: pa.Table) -> pa.Table:
        fp = table["fp"].to_numpy().view(np.uint64)
        left, wide = table["left"].to_numpy(), table["wide"].to_numpy(zero_copy_only=False)
        links_a, links_b = [], []
        small = [(fp[~wide & (left == k)], k) for k in (0, 1)]
        parts = [(_ball(x, low, k), x) for x, k in small if len(x)]
        if parts:
            strings = np.concatenate([s.ravel() for s, _ in parts])
            owners = np.concatenate([np.repeat(x, s.shape[1]) for s, x in parts])
            order = np.lexsort((owners, strings))
            strings, owners = strings[order], owners[order]
            first = np.flatnonzero(np.r_[True, strings[1:] != strings[:-1]])
            links_a.append(owners)
            links_b.append(np.repeat(owners[first], np.diff(np.r_[first, len(owners)])))
            strings, owners = strings[first], owners[first]
            there = np.zeros(1 << _FOLDED, bool)  # most strings of the wide balls are in no narrow one; their folds tell
            there[_fold(strings)] = True
            for k in (0, 1, 2):
                big, masks = fp[wide & (left == k)], _masks(low, k)
                folds, own = _fold(masks), big & np.uint64((1 << low) - 1)
                step = max(1, _BLOCK * 1024 // len(masks))
                for at in range(0, len(big), step):
                    row, col = np.nonzero(there[_fold(own[at : at + step])[:, None] ^ folds[None, :]])
                    ball = own[at + row] ^ masks[col]
                    spot = np.minimum(np.searchsorted(strings, ball), len(strings) - 1)
                    same = strings[spot] == ball
                    links_a.append(big[at + row[same]])
                    links_b.append(owners[spot[same]])
        a = np.concatenate(links_a) if links_a else np.zeros(0, np.uint64)
        b = np.concatenate(links_b) if links_b else a
        near = (a != b) & (np.bitwise_count(a ^ b) <= 3)  # the middle string proves it; checked all the same
        node, root = spanning_stars(a[near].view(np.int64), b[near].view(np.int64))
        return pa.table({"a": node, "b": root})

    return run


def _bits_for(n: int) -> int:
    """Bits of the shortest prefix that gets ``PER_PREFIX`` rows or fewer from ``n`` evenly spread fingerprints."""
    return next(p for p in range(6, 41) if n * (len(_flips(0, p, 2)) + len(_flips(0, p, 1))) <= PER_PREFIX << p or p == 40)


def _first_crowds(distinct: DataFrame, bits: int) -> DataFrame:
    """The first prefixes that get more than ``CROWDED`` rows, from the number of fingerprints of each, without dealing them."""
    counts = distinct.groupBy(F.shiftrightunsigned("fp", 64 - bits).alias("own")).agg(F.count("*").alias("n"))
    masks = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(2 if k < 2 else 1).alias("times")) for m, k in _flips(0, bits, 2)])
    rows = counts.select("own", "n", F.explode(masks).alias("x")).groupBy(F.col("own").bitwiseXOR(F.col("x.m")).alias("key")).agg(F.sum(F.col("n") * F.col("x.times")).alias("n"))
    return rows.where(F.col("n") > CROWDED).select("key")


def fingerprint_links(distinct: DataFrame, prefix_bits: int | None = None) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all pairs at 3 or fewer differing bits do.

    ``distinct`` has the distinct signed longs as ``fp``. Within a prefix the links are reduced
    to stars, so their number grows with the fingerprints and not with the pairs.
    """
    if prefix_bits is None:
        prefix_bits = _bits_for(distinct.count())
    balls = distinct.select("fp", F.lit(0).cast("long").alias("key"), F.explode(F.array(F.struct(F.lit(2).alias("left"), F.lit(True).alias("wide")), F.struct(F.lit(1).alias("left"), F.lit(False).alias("wide")))).alias("s")).select("fp", "key", "s.left", "s.wide")
    low, found = 64 - prefix_bits, None
    balls, crowded = _deal(balls, low, prefix_bits), _first_crowds(distinct, prefix_bits)
    while True:
        crowds = materialize(crowded, "crowds")
        some = low > 0 and bool(crowds.take(1))
        calm = balls.join(crowds, "key", "left_anti") if some else balls
        links = calm.groupBy("key").applyInArrow(_meet(low), "a long, b long")
        found = links if found is None else found.union(links)
        if not some:
            return found
        bits = min(16, low)
        balls = materialize(_deal(balls.join(crowds, "key", "left_semi"), low - bits, bits), "balls")
        low -= bits
        crowded = balls.groupBy("key").count().where(F.col("count") > CROWDED).select("key")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp, component): every row with its fingerprint and the smallest id reachable by links of 3 or fewer bits.

    Copies share a fingerprint and are handled once. Null texts, empty texts and texts without
    words have fingerprint 0 and link like any other. Rows with a null id keep their place and
    never name a component. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    labels = connected_components(fingerprint_links(classes.select("fp")))
    joined = classes.join(labels, classes.fp == labels.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("first").alias("component"))
    named = joined.join(lowest, "root").select(F.col("fp").alias("f"), "component")
    return rows.join(named, rows.fp == named.f).select("id", "fp", "component")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """The documents whose id names their component, with all their columns; one row if that id is repeated."""
    first = simhash_components(docs, id_col, text_col, words).where("id = component").select(F.col("id").alias(id_col)).distinct()
    one = docs.join(first, id_col, "left_semi").select(docs.columns)
    # rows with one id are in one partition after the join; of them the smallest text stays
    order = Window.partitionBy(id_col).orderBy(text_col)
    return one.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
