"""Toxicity classifier that is regularised by counterfactuals.

A logistic model over words and word beginnings, fitted on a bounded sample of labelled
documents. Sentences that mention an identity group are copied with the mention swapped for
other groups, and the change in score that a swap makes is penalised, so that a neutral
mention of a group does not move the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import as_bytes, materialize

#: Most labelled documents the classifier is fitted on: those with the smallest hashes of their ids.
MAX_FIT = 5_000
#: Most bytes of their texts, in the order of those hashes; the texts after them are left out.
MAX_FIT_BYTES = 64 << 20
#: What makes a feature usable: documents it occurs in at least, standard errors its log-odds differ from chance, and the log-odds themselves.
AT_LEAST, ERRORS, ODDS = 4, 4.0, 1.0
#: Most usable features, those furthest from chance; weight decay; steps of fitting.
MOST_FEATURES, DECAY, STEPS = 4_000, 1e-4, 300

# Terms for identity groups, by kind; a swap stays within a kind.
IDENTITY_TERMS = [
    ["muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"],
    ["black", "white", "asian", "latino", "arab", "african", "european", "indigenous"],
    ["gay", "lesbian", "bisexual", "straight", "transgender", "queer", "heterosexual", "homosexual"],
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["female", "male", "nonbinary"],
    ["immigrants", "refugees", "foreigners", "natives", "citizens"],
    ["deaf", "blind", "disabled", "autistic", "elderly", "young"],
    ["femmes", "hommes", "filles", "musulmans", "chrétiens", "juifs", "immigrés", "noirs", "blancs"],
    ["frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "schwarze", "weiße"],
    ["mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "negros", "blancos"],
]

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_BEGINNINGS = (4, 5, 6)


def word_features(word: bytes) -> list[bytes]:
    """The whole word and its beginnings of 4 to 6 bytes."""
    return [b"=" + word, *(word[:n] for n in _BEGINNINGS if len(word) >= n)]


def words_in(text: bytes) -> set[bytes]:
    return set(text.translate(_FOLD).split())


class Model:
    """Weights by feature, and the intercept. A feature counts once for each document it occurs in."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias, self._seen = weights, bias, {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "_seen": {}}

    def score(self, text: str | None) -> float:
        seen, weights, found = self._seen, self.weights, set()
        for w in words_in(as_bytes(text)):
            own = seen.get(w)
            if own is None:
                if len(seen) > 100_000:
                    seen.clear()
                own = seen[w] = tuple(f for f in word_features(w) if f in weights)
            if own:
                found.update(own)
        z = self.bias + sum(weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _sentences(text: bytes) -> list[bytes]:
    return re.split(rb"(?<=[.!?])\s+|\n+", text)


def counterfactuals(texts: list[bytes]) -> list[tuple[bytes, bytes]]:
    """(sentence, sentence with the identity terms swapped for the next of their kind) for each sentence that has one."""
    swap = {a.encode(): b.encode() for kind in IDENTITY_TERMS for a, b in zip(kind, kind[1:] + kind[:1])}
    pattern = re.compile(rb"(?<![\w\x80-\xff])(?:" + b"|".join(sorted(map(re.escape, swap), key=len, reverse=True)) + rb")(?![\w\x80-\xff])", re.I)
    pairs = []
    for text in texts:
        for s in _sentences(text) if pattern.search(text) else []:
            if pattern.search(s):
                pairs.append((s, pattern.sub(lambda m: swap.get(m[0].lower(), m[0]), s)))
    return pairs


def _numbered(texts: list[bytes], numbers: dict[bytes, int]) -> list[np.ndarray]:
    """The numbers of each text's features; new features get the next ones."""
    known: dict[bytes, tuple[int, ...]] = {}
    out = []
    for t in texts:
        found: set[int] = set()
        for w in words_in(t):
            if w not in known:
                known[w] = tuple(numbers.setdefault(f, len(numbers)) for f in word_features(w))
            found.update(known[w])
        out.append(np.fromiter(found, np.int32, len(found)))
    return out


def _columns(sentence: bytes, at: dict[bytes, int]) -> list[int]:
    return sorted({at[f] for w in words_in(sentence) for f in word_features(w) if f in at})


def fit(texts: list[bytes], labels: np.ndarray, swap_weight: float = 1.0) -> Model:
    """Fit the model. Without both classes the score is the share of label 1 for every text.

    ``swap_weight`` weighs the mean squared change of the log-odds that swaps make against the mean
    loss of a document; 0 leaves the penalty out. Where no labelled text mentions a group it has nothing to act on.
    """
    labels = np.asarray(labels, float)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = float(np.log(share / (1 - share)))
    if not len(labels) or labels.min() == labels.max():
        return Model({}, bias)
    numbers: dict[bytes, int] = {}
    docs = _numbered(texts, numbers)
    share_of = lambda y: np.bincount(np.concatenate([d for d, own in zip(docs, labels) if own == y]), minlength=len(numbers))
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    even = np.where(labels > 0, n0 / n1, 1.0) if n1 < n0 else np.where(labels > 0, 1.0, n1 / n0)  # both classes weigh the same
    even *= len(labels) / even.sum()
    # a feature is used if the classes differ in it beyond chance (log-odds over its standard error)
    a, b = share_of(1), share_of(0)
    odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
    z = np.abs(odds) / np.sqrt(1 / (a + 0.5) + 1 / (n1 - a + 0.5) + 1 / (b + 0.5) + 1 / (n0 - b + 0.5))
    telling, feature = np.flatnonzero((a + b >= AT_LEAST) & (z >= ERRORS) & (np.abs(odds) >= ODDS)), list(numbers)
    names = sorted(f for _, f in sorted((-z[i], feature[i]) for i in telling.tolist())[:MOST_FEATURES])
    if not names:
        return Model({}, bias)
    at = {f: i for i, f in enumerate(names)}
    column = np.full(len(numbers), -1, np.int64)
    column[[numbers[f] for f in names]] = np.arange(len(names))

    def matrix(lists):
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([j for x in lists for j in x], np.int64), len(lists)

    r, c, n = matrix([np.sort(column[d][column[d] >= 0]) for d in docs])
    pairs = counterfactuals(texts)
    pr, pc, pn = matrix([_columns(s, at) for s, _ in pairs])
    qr, qc, _ = matrix([_columns(s, at) for _, s in pairs])
    w, b0 = np.zeros(len(names)), bias
    m, v, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = b0 + np.bincount(r, w[c], n)
        err = (1 / (1 + np.exp(-z)) - labels) * even / n
        g = np.bincount(c, err[r], len(names)) + DECAY * w
        gb = err.sum()
        if pn:  # the penalty on the mean squared change of score that the swaps make
            gap = (np.bincount(pr, w[pc], pn) - np.bincount(qr, w[qc], pn)) * (2 * swap_weight / pn)
            g += np.bincount(pc, gap[pr], len(names)) - np.bincount(qc, gap[qr], len(names))
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate, up, down = 0.1 / (1 + step / 150), 1 - 0.9**step, 1 - 0.99**step
        w = w - rate * (m / up) / (np.sqrt(v / down) + 1e-9)
        b0 -= rate * (mb / up) / (np.sqrt(vb / down) + 1e-9)
    return Model({f: round(float(x), 9) for f, x in zip(names, w) if abs(x) > 1e-6}, round(float(b0), 9))


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row, from its whole text. Null and empty texts get the intercept's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in b.column(1).to_pylist()], pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, all columns, whose score is under ``threshold``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """True for the rows no label is learned from: crc32 of the id as text leaves 1 when divided by 3. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_fit: int = MAX_FIT, swap_weight: float = 1.0, max_bytes: int = MAX_FIT_BYTES) -> Model:
    """Fit on labelled documents that are not held out: at most ``max_fit``, those with the smallest hashes of their ids, up to ``max_bytes`` of text.

    Ids labelled more than once count with their largest label, null ids and null labels are left
    out, null texts count as empty. The sample is chosen among the labels, so that only its texts
    (at most ``max_fit`` ids, hence the broadcast) are looked up, and only those within the bytes leave the executors.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).cast("int").alias("y"))
    few = known.where(~held_out("k")).orderBy(F.xxhash64("k"), "k").limit(max_fit)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = materialize(texts.join(F.broadcast(few), F.col("id") == F.col("k")).groupBy("k").agg(F.max("y").alias("y"), F.min("t").alias("t")), "labelled")
    order = Window.orderBy(F.xxhash64("k"), "k")  # over the sizes of at most ``max_fit`` rows
    within = rows.select("k", F.sum(F.octet_length("t")).over(order).alias("total")).where(F.col("total") <= max_bytes).select("k")
    got = sorted((r["k"], as_bytes(r["t"]), r["y"]) for r in rows.join(F.broadcast(within), "k").toLocalIterator())
    return fit([t for _, t, _ in got], np.array([min(1, max(0, y)) for _, _, y in got]), swap_weight)
