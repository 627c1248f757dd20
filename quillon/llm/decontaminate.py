"""Benchmark decontamination with a generalised suffix automaton over the words of all test items.

Documents stream through the automaton word by word; the state tracks the longest suffix that
occurs in some item. Where that length reaches a window's, the window's words are hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from quillon.llm.common import as_bytes, materialize

#: Words of items in one automaton; more items are taken in blocks, one pass over the documents for each.
BLOCK_WORDS = 200_000

#: Bytes to what they become before a text is split: A-Z in lower case, everything that is no word byte a space.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null has none."""
    return as_bytes(text).translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window-long match.

    ``items`` are (id, words). A window is ``size`` consecutive words; an item of fewer words,
    but not none, is one window.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], size: int):
        self.size, self.vocab = size, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        ends, short = [], []
        for item, words in items:
            at = 0
            path = []
            for w in words:
                at = self._extend(at, self.vocab.setdefault(w, len(self.vocab)))
                path.append(at)
            ends.append((item, path))
            if 0 < len(words) < size:
                short.append((item, at, len(words)))
        self.least = min([size, *(n for _, _, n in short)])
        # the state of each window: the ancestor whose lengths include the window's
        self.windows: dict[int, set] = {}
        for item, path in ends:
            for at in path[size - 1 :]:
                self.windows.setdefault(self._ancestor(at, size), set()).add(item)
        self.shorts: dict[int, list] = {}
        for item, at, n in short:
            self.shorts.setdefault(self._ancestor(at, n), []).append((n, item))
        # for each state: the windows that are suffixes of its longest string
        self.suffix_windows = self._inherit()

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        half = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = half
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = half
            p = link[p]
        return half

    def _ancestor(self, at: int, n: int) -> int:
        while at > 0 and self.length[self.link[at]] >= n:
            at = self.link[at]
        return at

    def _inherit(self) -> list[tuple]:
        out: list[tuple] = [()] * len(self.next)
        for at in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = [(self.size, i) for i in self.windows.get(at, ())] + self.shorts.get(at, [])
            out[at] = out[self.link[at]] + tuple(own) if own else out[self.link[at]]
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Runs [start, end) of hit words, merged and in order, and the items found."""
        ids = list(map(self.vocab.get, words))
        nxt, link, length, ends, least = self.next, self.link, self.length, self.suffix_windows, self.least
        runs: list[list[int]] = []
        items: set = set()
        state = matched = 0
        for i, c in enumerate(ids):
            if c is None:
                state = matched = 0
                continue
            go = nxt[state].get(c)
            while go is None and state:
                state = link[state]
                matched = length[state]
                go = nxt[state].get(c)
            if go is None:
                continue
            state, matched = go, matched + 1
            if matched >= least:
                # the state's longest string may be longer than what matched here: its own windows are then too long
                at = state
                while at and length[link[at]] >= matched:
                    at = link[at]
                for n, item in ends[at]:
                    if n <= matched:
                        items.add(item)
                        start = i + 1 - n
                        while runs and runs[-1][0] >= start:
                            runs.pop()
                        if runs and runs[-1][1] >= start:
                            runs[-1][1] = i + 1
                        else:
                            runs.append([start, i + 1])
        return [(s, e) for s, e in runs], items


def _blocks(items: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list]:
    """Items with their words, in blocks of bounded size, read one partition at a time."""
    block, n = [], 0
    for row in items.select(item_col, text_col).toLocalIterator():
        words = words_of(row[1])
        if not words:
            continue
        if block and n + len(words) > limit:
            yield block
            block, n = [], 0
        block.append((row[0], words))
        n += len(words)
    if block:
        yield block


def find_contamination(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, cut: bool = False) -> DataFrame:
    """(id, n_words, runs, items) for every row: its hit words as runs [start, end) and the items whose windows occur.

    Null or empty texts have no words and no hits; without items nothing is hit. Items with the
    same id count once; items with a null id hit words but are not named. Repeated rows stay.
    The items are a query set: the documents pass once for each block of ``block_words`` item
    words, so a large benchmark costs passes and not memory. Documents are never shuffled. With ``cut``
    the column text has the texts without their hit spans.
    """
    other = items.schema[item_col].dataType.simpleString()
    run = StructType().add("start", "integer").add("end", "integer")
    schema = StructType().add("id", docs.schema[id_col].dataType).add("text", "string").add("n_words", "long").add("runs", ArrayType(run)).add("items", ArrayType(items.schema[item_col].dataType))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("long").alias("n_words"), F.array().cast("array<struct<start:int,end:int>>").alias("runs"), F.array().cast(f"array<{other}>").alias("items"))

    def scanner(machine: Automaton, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                count, runs, named = [], [], []
                for text, old, known in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                    words = words_of(text)
                    new, hit = machine.scan(words) if len(words) >= machine.least else ([], set())
                    count.append(len(words))
                    runs.append(_merge([(r["start"], r["end"]) for r in old] + new) if old else new)
                    named.append(sorted({*known, *(i for i in hit if i is not None)}))
                texts = pa.array([_cut(t, r) for t, r in zip(b.column(1).to_pylist(), runs)], pa.string()) if cut and last else b.column(1)
                yield pa.RecordBatch.from_arrays([b.column(0), texts, pa.array(count, pa.int64()), pa.array([[{"start": s, "end": e} for s, e in r] for r in runs], b.schema.field(3).type), pa.array(named, b.schema.field(4).type)], ["id", "text", "n_words", "runs", "items"])

        return run

    blocks = _blocks(items, item_col, item_text, block_words)
    block = next(blocks, [])
    while True:
        following = next(blocks, None)
        found = found.mapInArrow(scanner(Automaton(block, size), following is None), schema)
        if following is None:
            return found
        found, block = materialize(found, "scanned"), following


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_contamination(docs: DataFrame, items: DataFrame, size: int = 10, max_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents with all their columns and hit spans cut out; those hit in more than ``max_share`` of their words go.

    A span is cut from its first word to its last. Documents without hits stay byte for byte, nulls included.
    """
    columns = docs.columns
    rest = F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in columns if c != text_col]).alias("__rest")
    found = find_contamination(docs.select(rest, F.col(text_col).alias("text")), items, size, "__rest", "text", item_col, item_text, cut=True)
    n_hit = F.aggregate("runs", F.lit(0), lambda a, r: a + r["end"] - r["start"])
    kept = found.where((F.size("runs") == 0) | (n_hit <= F.lit(max_share) * F.col("n_words")))
    return kept.select(*[(F.col("text") if c == text_col else F.col(f"id.`{c}`")).alias(c) for c in columns])


def _cut(text: str | None, runs: list[tuple[int, int]]) -> str | None:
    if text is None or not runs:
        return text
    import re

    raw = as_bytes(text)
    spans = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    out, at = [], 0
    for s, e in runs:
        out.append(raw[at : spans[s][0]])
        at = spans[e - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")
