"""Substring deduplication by sliding sentence spans.

A text is cut into sentences, and long sentences into parts after words that their own hash
marks, so that a passage that begins and ends inside sentences still holds whole parts. Every run
of several consecutive parts with enough words is hashed; runs that occur more than once have
one first occurrence (smallest document id, then position), and parts covered by any other
occurrence are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import exchange
from quillon.llm.common import as_bytes
from quillon.llm.suffix_dedup import _by_part, _mix, _part, _power

#: Parts in a run, and the words it must have (half of a passage of 50): the shortest run that has both is looked at.
RUN, LEAST_WORDS = 3, 25
#: Bytes that count as a word where there is no white space for long.
WORD_BYTES = 12
#: A word ends its part if the first hexadecimal digit of its MD5 is smaller than this.
MARKED_BELOW = 4

_BLANK, _MARK, _BREAK, _LETTER = range(4)
_CLASS = np.full(256, _LETTER, np.uint8)
_CLASS[list(b" \t\r\f\v")], _CLASS[list(b".!?")], _CLASS[10] = _BLANK, _MARK, _BREAK
_VALUE = np.random.default_rng(3).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def _marked(words: list[bytes]) -> np.ndarray:
    return np.array([hashlib.md5(w).digest()[0] >> 4 < MARKED_BELOW for w in words], bool)


def _prefix_sums(values: np.ndarray) -> np.ndarray:
    """For ``_stretch``: sums of the values times the powers of their places."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(len(values) + 1)[0][: len(values)], out=sums[1:])
    return sums


def _stretch(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, odd: np.uint64 = _ODD[0]) -> np.ndarray:
    """A hash of the values from ``start`` to ``stop``, wherever they stand."""
    return _mix((sums[stop] - sums[start]) * _power(len(sums))[1][start] + (stop - start).astype(np.uint64) * odd)


class _Parts:
    """The parts of a block's texts: each with its bytes (white space before it included), its hash and its words.

    A word is a run of letters, anything but white space and the marks of sentences, with the marks that
    follow. It ends its part if a mark or a line break follows, or if it is marked itself.
    """

    def __init__(self, texts: list[bytes]):
        self.data = data = b"".join(texts)
        size = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        kind = _CLASS[np.frombuffer(data, np.uint8)]
        n, letter = len(kind), kind == _LETTER
        before, after = np.r_[False, letter[:-1]][:n], np.r_[letter[1:], False][:n]
        before[self.starts[size > 0]] = after[self.ends[size > 0] - 1] = False
        start, stop = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
        doc = np.searchsorted(self.ends, start, "right")
        others = np.r_[np.flatnonzero(kind != _MARK), n]
        end = np.minimum(others[np.searchsorted(others, stop)], self.ends[doc])  # after the marks
        between = np.r_[0, np.cumsum((kind == _MARK) | (kind == _BREAK), dtype=np.int64)]
        last = np.ones(len(start), bool)
        last[:-1] = (doc[1:] != doc[:-1]) | (between[start[1:]] > between[stop[:-1]])
        word = _stretch(_prefix_sums(_VALUE[np.frombuffer(data, np.uint8)]), start, end)
        open_ = np.flatnonzero(~last)
        _, one, which = np.unique(word[open_], return_index=True, return_inverse=True)
        if len(open_):
            last[open_] = _marked([data[start[k] : end[k]] for k in open_[one].tolist()])[which]
        first = np.flatnonzero(np.r_[True, last[:-1]][: len(last)])
        behind = np.flatnonzero(last) + 1
        self.hash = _stretch(_prefix_sums(word), first, behind)
        words, letters = behind - first, np.r_[0, np.cumsum(end - start)]
        self.weight = np.maximum(words, (letters[behind] - letters[first] + words - 1) // WORD_BYTES)
        self.doc = doc[first]
        solid = np.r_[-1, np.flatnonzero(kind != _BLANK)]
        self.begin = np.maximum(solid[np.searchsorted(solid, start[first]) - 1] + 1, self.starts[self.doc])
        self.end = end[behind - 1]


class _Runs:
    """The runs of a block's texts, and the different ones as entries in the order of their keys."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, run: int, least: int):
        self.parts = parts = _Parts([as_bytes(t) for t in table[text_col].to_pylist()])
        self.ids = np.array([exchange.NO_ID if i is None else i for i in table[id_col].to_pylist()], np.int64)
        doc, n = parts.doc, len(parts.doc)
        self.counts = np.bincount(doc, minlength=table.num_rows)
        ends, total, at = np.cumsum(self.counts), np.r_[0, np.cumsum(parts.weight)], np.arange(n)
        stop = np.maximum(np.searchsorted(total, total[:-1] + least, "left"), at + run)  # the run is at .. stop - 1
        fits = stop <= ends[doc]
        # a text without any such run is one run as a whole
        some = np.zeros(table.num_rows, bool)
        some[doc[fits]] = True
        whole = np.flatnonzero(~some & (self.counts > 0))
        self.at = np.concatenate([at[fits], (ends - self.counts)[whole]])
        self.stop = np.concatenate([stop[fits], ends[whole]])
        by = np.argsort(self.at, kind="stable")
        self.at, self.stop = self.at[by], self.stop[by]
        self.doc = doc[self.at]
        self.place = self.at - (ends - self.counts)[self.doc]
        key, other = (_stretch(_prefix_sums(_mix(parts.hash * odd + odd)), self.at, self.stop, odd) for odd in _ODD)
        own = self.ids[self.doc]
        order = np.lexsort((self.place, own, other, key))
        k, o = key[order], other[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])] if len(k) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        self.key, self.other, self.low, self.low_place = k[head], o[head], own[order][head], self.place[order][head]
        self.many = np.diff(np.r_[head, len(k)]) > 1
        self.entry = np.empty(len(k), np.int64)
        self.entry[order] = np.cumsum(new) - 1


def _ask(id_col, text_col, run, least, parts):
    def question(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
        g = _Runs(table, id_col, text_col, run, least)
        for part, at in _by_part(_part(g.key, parts)):
            key = g.key[at]
            yield part, len(key), exchange.zip_arrays(np.r_[key[:1], np.diff(key)], g.other[at], g.low[at], g.low_place[at].astype(np.uint32), g.many[at], np.arange(at.start, at.stop, dtype=np.uint32))

    return question


def _first(got: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    """For each repeated run of a block: where it occurs first."""
    cols = [exchange.unzip_arrays(d, n, np.uint64, np.uint64, np.int64, np.uint32, np.bool_, np.uint32) for _, n, d in got]
    key = np.concatenate([np.cumsum(c[0], dtype=np.uint64) for c in cols])
    other, low, place, many, entry = (np.concatenate([c[i] for c in cols]) for i in range(1, 6))
    source = np.repeat(np.arange(len(got)), [n for _, n, _ in got])
    order = np.lexsort((place, low, other, key))
    k, o = key[order], other[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])]
    head, group = np.flatnonzero(new), np.cumsum(new) - 1
    repeated = ((np.diff(np.r_[head, len(k)]) > 1) | many[order][head])[group]
    first = order[head][group]
    order, first = order[repeated], first[repeated]
    by = np.argsort(source[order], kind="stable")
    order, first = order[by], first[by]
    for s, at in _by_part(source[order]):
        yield got[s][0], at.stop - at.start, exchange.zip_arrays(entry[order[at]], low[first[at]], place[first[at]])


def _cut(id_col, text_col, run, least, columns):
    def work(block: int, table: pa.Table, answers) -> pa.Table:
        g = _Runs(table, id_col, text_col, run, least)
        low, place, known = np.zeros(len(g.key), np.int64), np.zeros(len(g.key), np.int64), np.zeros(len(g.key), bool)
        for _, n, data in answers:
            e, i, p = exchange.unzip_arrays(data, n, np.uint32, np.int64, np.uint32)
            low[e], place[e], known[e] = i, p, True
        e = g.entry
        again = known[e] & ((g.ids[g.doc] != low[e]) | (g.place != place[e])) if len(e) else np.zeros(0, bool)
        cover = np.zeros(len(g.parts.doc) + 1, np.int64)
        np.add.at(cover, g.at[again], 1)
        np.add.at(cover, g.stop[again], -1)
        gone = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
        removed = np.bincount(g.parts.doc[gone], minlength=table.num_rows)
        texts, k, data = table[text_col].to_pylist(), 0, g.parts.data
        for d in np.flatnonzero(removed).tolist():
            kept, to = [], int(g.parts.starts[d])
            for part in gone[k : k + removed[d]].tolist():
                kept.append(data[to : g.parts.begin[part]])
                to = int(g.parts.end[part])
            kept.append(data[to : g.parts.ends[d]])
            k += int(removed[d])
            texts[d] = b"".join(kept).decode("utf-8", "surrogatepass")
        made = {text_col: pa.array(texts, pa.string()), "n_sentences": pa.array(g.counts), "n_removed": pa.array(removed)}
        return pa.table([made[c] if c in made else table[c] for c in columns], columns)

    return work


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """All rows and columns, the text without the parts of repeated runs, and ``n_sentences``, ``n_removed`` (parts of the input, and those removed).

    Sentences end with ``.``, ``!``, ``?`` or a line break; a part also ends with each marked word
    (about one in four). Parts are compared by their words. A run is the shortest stretch of
    at least ``run`` parts of one text with at least ``least_words`` words in all, from any part on
    (``WORD_BYTES`` bytes without white space count as a word); a text without such a stretch is one
    run as a whole. The first occurrence, by id and then position, stays; rows with one id are taken
    for the same document, so their equal positions stay together. A null id counts as larger than
    any other. Null texts stay null, texts without words stay as they are. Columns of ``docs`` named as
    the two counts are replaced by them.
    """
    columns = [*(c for c in docs.columns if c not in ("n_sentences", "n_removed")), "n_sentences", "n_removed"]
    docs = docs.select(*[F.col(f"`{c}`") for c in columns[:-2]])
    ranges = exchange.ranges_for(docs, text_col)
    blocks = exchange.pack(docs, ranges, text_col)
    told = exchange.answer(exchange.ask(blocks, _ask(id_col, text_col, run, least_words, ranges)), _first, ranges)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return exchange.meet(blocks, told, _cut(id_col, text_col, run, least_words, columns), f"{kinds}, n_sentences long, n_removed long")
