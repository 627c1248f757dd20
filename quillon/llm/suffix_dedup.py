"""Removal of long repeated byte strings by distributed prefix doubling.

Ranks are names for the strings of one length that start at a position; the rank for twice the
length is the rank of a pair of ranks. Positions whose rank is unique are settled and leave.

1. The first rank, for 20 bytes, is a hash. Of each 50-byte window only its smallest 20-byte rank
   is looked at: equal windows have the same one, so a window whose smallest rank occurs in one
   document is unique. Neighbouring windows with the same smallest rank form a segment.
2. Segments are dealt by that rank. Equal segments have one representative, that of the smallest
   document id; the others are repeats as a whole. A representative alone under its rank is
   settled as well.
3. The other representatives send their bytes to the owner of their rank, where prefix doubling
   ranks all their positions for 8, 16, 32 and 50 bytes, sorting the pairs of ranks and leaving
   out what has become unique. Windows of one final rank are equal; those that do not belong to
   the smallest document id are repeats.

Each shuffle is keyed by a rank, so a task ranks one part of the order; a rank with very many
different segments is dealt by whole windows instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import exchange

_K = 20
#: Different segments under one rank above which they are dealt by window.
CROWDED = 50_000
_SLICE = 1 << 15
_A, _B, _C, _R = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_ONE64 = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _R
    x ^= x >> np.uint64(29)
    x *= _A
    x ^= x >> np.uint64(32)
    return x


def _words(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one number."""
    x2 = b[:-1].astype(np.uint16) | (b[1:].astype(np.uint16) << 8)
    x4 = x2[:-2].astype(np.uint32) | (x2[2:].astype(np.uint32) << 16)
    return x4[:-4].astype(np.uint64) | (x4[4:].astype(np.uint64) << np.uint64(32))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        inverse = np.uint64(pow(int(_B), -1, 1 << 64))
        for name, x in (("up", _B), ("down", inverse)):
            a = np.full(n, x, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


class Segments:
    """A block's texts, their segments, and the different segments as entries ordered by (rank, content, id)."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, width: int):
        self.texts, self.ids, self.width = texts, ids, width
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        n = max(0, len(self.bytes) - width + 1)
        rank, sums = np.empty(n, np.uint64), np.zeros(len(self.bytes) + 1, np.uint64)
        up, down = _power(len(self.bytes) + 1)
        span = width - _K + 1
        for at in range(0, n, _SLICE):
            stop = min(n, at + _SLICE)
            x = _words(self.bytes[at : stop + width - 1])
            m = stop - at + span - 1
            h = _mix(x[:m] * _A + x[8 : 8 + m] * _B + x[_K - 8 : _K - 8 + m] * _C)
            step = 1
            while 2 * step <= span:
                h = np.minimum(h[:-step], h[step:])
                step *= 2
            if step < span:
                h = np.minimum(h[: len(h) - (span - step)], h[span - step :])
            rank[at:stop] = h
            own = x[: stop - at] if stop < n else x
            sums[at + 1 : at + 1 + len(own)] = _mix(own) * up[at : at + len(own)]
        np.cumsum(sums, out=sums)
        # windows that lie in one text
        valid = np.zeros(len(self.bytes) + 1, np.int8)
        whole = sizes >= width
        valid[self.starts[whole]] += 1
        np.add.at(valid, self.ends[whole] - width + 1, -1)
        valid = np.cumsum(valid[:n], dtype=np.int8).astype(bool)
        new = np.ones(n, bool)
        new[1:] = rank[1:] != rank[:-1]
        new[self.starts[self.starts < n]] = True
        first = np.flatnonzero(new)
        last = np.r_[first[1:], n] if n else first
        # cut segments at the end of each text's windows, leave those outside
        doc = np.searchsorted(self.ends, first, "right")
        last = np.minimum(last, self.ends[doc] - width + 1) if n else last
        keep = (last > first) & valid[first] if n else np.zeros(0, bool)
        self.first, self.last, self.doc = first[keep], last[keep], doc[keep]
        rank = _mix(rank[self.first])  # minima crowd at small numbers; mixed, they are dealt evenly
        content = (sums[self.last + width - 8] - sums[self.first]) * down[self.first]
        content = _mix(content + (self.last - self.first).astype(np.uint64) * _C)
        own = ids[self.doc]
        order = np.argsort(rank)
        same = rank[order][1:] == rank[order][:-1]
        tied = np.zeros(len(order), bool)
        tied[1:] |= same
        tied[:-1] |= same
        some = order[tied]
        order[tied] = some[np.lexsort((own[some], content[some], rank[some]))]
        r, c, i = rank[order], content[order], own[order]
        new = np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])] if len(r) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        self.rank, self.content, self.low = r[head], c[head], i[head]
        tail = np.r_[head[1:], len(r)][: len(head)] - 1
        self.many = i[tail] != self.low if len(head) else np.zeros(0, bool)
        self.entry = np.empty(len(r), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.sample = order[head]


def _segments(table: pa.Table, id_col: str, text_col: str, width: int) -> Segments:
    texts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in table[text_col].to_pylist()]
    ids = np.array([exchange.NO_ID if i is None else i for i in table[id_col].to_pylist()], np.int64)
    return Segments(texts, ids, width)


def _part(rank: np.ndarray, parts: int) -> np.ndarray:
    return ((rank >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """For ascending parts: each with its run."""
    cut = np.flatnonzero(np.diff(part)) + 1
    for s, e in zip(np.r_[0, cut], np.r_[cut, len(part)]):
        if e > s:
            yield int(part[s]), slice(int(s), int(e))


def _ask_ranks(id_col: str, text_col: str, width: int, parts: int):
    def question(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
        g = _segments(table, id_col, text_col, width)
        for part, at in _by_part(_part(g.rank, parts)):
            rank = g.rank[at]
            step = np.r_[rank[:1], np.diff(rank)]
            yield part, len(rank), exchange.zip_arrays(step, g.content[at], g.low[at], g.many[at], np.arange(at.start, at.stop, dtype=np.uint32))

    return question


def _answer_ranks(got: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    """For each entry that matters: the smallest id with that segment, and 1 if its bytes are to be ranked (2: by window)."""
    cols = [exchange.unzip_arrays(d, n, np.uint64, np.uint64, np.int64, np.bool_, np.uint32) for _, n, d in got]
    rank = np.concatenate([np.cumsum(c[0], dtype=np.uint64) for c in cols])
    content, low, many, entry = (np.concatenate([c[i] for c in cols]) for i in (1, 2, 3, 4))
    source = np.repeat(np.arange(len(got)), [n for _, n, _ in got])
    order = np.argsort(rank)
    same = rank[order][1:] == rank[order][:-1]
    shared = np.zeros(len(rank), bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    pick = np.flatnonzero(shared | many)
    order = pick[np.lexsort((low[pick], content[pick], rank[pick]))]
    if not len(order):
        return
    r, c, i = rank[order], content[order], low[order]
    new_r = np.r_[True, r[1:] != r[:-1]]
    new = new_r | np.r_[True, c[1:] != c[:-1]]
    lowest = i[np.flatnonzero(new)][np.cumsum(new) - 1]
    kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_r))[np.cumsum(new_r) - 1]
    start = np.flatnonzero(new_r)
    spread = (np.minimum.reduceat(i, start) < np.maximum.reduceat(i, start)) | np.logical_or.reduceat(many[order], start)
    send = (kinds > 1) & spread[np.cumsum(new_r) - 1] & (i == lowest)
    flag = np.where(send, np.where(kinds > CROWDED, 2, 1), 0).astype(np.uint8)
    told = send | (i > lowest) | many[order]
    order, lowest, flag = order[told], lowest[told], flag[told]
    by = np.argsort(source[order], kind="stable")
    for k, at in _by_part(source[order][by]):
        rows = by[at]
        rows = rows[np.argsort(entry[order[rows]])]
        yield got[k][0], len(rows), exchange.zip_arrays(entry[order[rows]], lowest[rows], flag[rows])


def _told(answers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cols = [exchange.unzip_arrays(d, n, np.uint32, np.int64, np.uint8) for part, n, d in answers if part == 0]
    if not cols:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    return np.concatenate([c[0] for c in cols]).astype(np.int64), np.concatenate([c[1] for c in cols]), np.concatenate([c[2] for c in cols])


def _send_bytes(id_col: str, text_col: str, width: int, parts: int):
    def work(block: int, table: pa.Table, answers) -> pa.Table:
        entry, _, flag = _told(answers)
        rows = []
        if flag.any():
            g = _segments(table, id_col, text_col, width)
            out = []  # part, entry, offset of the first window, first byte, bytes, id
            e = entry[flag == 1]
            s = g.sample[e]
            out.append((_part(g.rank[e], parts), e, np.zeros(len(e), np.int64), g.first[s], g.last[s] - g.first[s] + width - 1, g.low[e]))
            e = entry[flag == 2]
            if len(e):  # each window by itself, to the owner of its own hash
                s = g.sample[e]
                n = g.last[s] - g.first[s]
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(g.first[s], n) + off
                x = _words(np.r_[g.bytes, np.zeros(8, np.uint8)])
                h = np.zeros(len(at), np.uint64)
                for k in [*range(0, width - 7, 8), width - 8]:
                    h = _mix(h + x[at + k])
                out.append((_part(h, parts), np.repeat(e, n), off, at, np.full(len(at), width), np.repeat(g.low[e], n)))
            part, e, off, at, n, low = (np.concatenate([o[i] for o in out]) for i in range(6))
            order = np.argsort(part, kind="stable")
            for p, where in _by_part(part[order]):
                o = order[where]
                raw = b"".join(g.bytes[a : a + k].tobytes() for a, k in zip(at[o].tolist(), n[o].tolist()))
                head = exchange.zip_arrays(e[o].astype(np.uint32), off[o].astype(np.uint32), n[o].astype(np.uint32), low[o])
                rows.append((p, block, len(o), len(head).to_bytes(8, "little") + head + exchange.zip_arrays(np.frombuffer(raw, np.uint8))))
        return pa.Table.from_batches([exchange._rows(rows)])

    return work


def double_prefixes(text: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Ranks of the ``width`` bytes from each position on; -1 where they are unique or run over their segment's end.

    ``ends`` has for each position the end of its segment. Ranks start with 8 bytes and double;
    pairs are sorted only where both ranks occur more than once.
    """
    n = len(text)
    place = np.arange(n)
    x = _words(np.r_[text, np.zeros(8, np.uint8)])[:n]
    rank = _name(x, place + 8 <= ends)
    length = 8
    while length < width:
        step = min(length, width - length)
        other = np.full(n, -1, np.int64)
        other[: n - step] = rank[step:]
        fit = (place + length + step <= ends) & (rank >= 0) & (other >= 0)
        pair = (rank.astype(np.uint64) << np.uint64(32)) | (other.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        rank = _name(pair, fit)
        length += step
    return rank


def _name(keys: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Numbers from 0 on for the keys that occur more than once, in their order; -1 elsewhere."""
    out = np.full(len(keys), -1, np.int64)
    at = np.flatnonzero(where)
    order = at[np.argsort(keys[at])]
    k = keys[order]
    if len(k):
        new = np.r_[True, k[1:] != k[:-1]]
        group = np.cumsum(new) - 1
        count = np.bincount(group)
        repeated = count[group] > 1
        out[order[repeated]] = group[repeated]
    return out


def _rank_bytes(width: int):
    def reply(got: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        heads, texts = [], []
        for _, n, data in got:
            size = int.from_bytes(data[:8], "little")
            h = exchange.unzip_arrays(data[8 : 8 + size], n, np.uint32, np.uint32, np.uint32, np.int64)
            heads.append(h)
            texts.append(exchange.unzip_arrays(data[8 + size :], int(h[2].sum()), np.uint8)[0])
        entry, off, n, low = (np.concatenate([h[i] for h in heads]) for i in range(4))
        n = n.astype(np.int64)
        text = np.concatenate(texts)
        ends = np.repeat(np.cumsum(n), n)
        rank = double_prefixes(text, ends, width)
        at = np.flatnonzero(rank >= 0)
        owner = np.repeat(np.arange(len(n)), n)
        lowest = np.full(int(rank.max(initial=-1)) + 1, exchange.NO_ID, np.int64)
        np.minimum.at(lowest, rank[at], low[owner[at]])
        at = at[low[owner[at]] > lowest[rank[at]]]
        window = at - (np.cumsum(n) - n)[owner[at]] + off[owner[at]]
        source = np.repeat(np.arange(len(got)), [k for _, k, _ in got])[owner[at]]
        for k, where in _by_part(source):  # in the order of their blocks
            yield got[k][0], where.stop - where.start, exchange.zip_arrays(entry[owner[at[where]]], window[where].astype(np.uint32))

    return reply


def _cut(id_col: str, text_col: str, width: int, columns: list[str], with_kept: bool):
    def work(block: int, table: pa.Table, answers) -> pa.Table:
        from hashlib import sha256

        g = _segments(table, id_col, text_col, width)
        cover = np.zeros(len(g.bytes) + 1, np.int32)
        entry, lowest, _ = _told(answers)
        low = np.full(len(g.rank), exchange.NO_ID, np.int64)
        low[entry] = lowest
        own = g.ids[g.doc]
        full = own > low[g.entry] if len(entry) else np.zeros(len(own), bool)
        np.add.at(cover, g.first[full], 1)
        np.add.at(cover, g.last[full] + width - 1, -1)
        parts = [exchange.unzip_arrays(d, n, np.uint32, np.uint32) for part, n, d in answers if part == 1]
        if parts:  # single windows of the representatives, wherever the same id has that segment
            e, w = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (0, 1))
            same = np.flatnonzero(own == g.low[g.entry])
            by = same[np.argsort(g.entry[same], kind="stable")]
            left, right = np.searchsorted(g.entry[by], e, "left"), np.searchsorted(g.entry[by], e, "right")
            n = right - left
            seg = by[np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            at = g.first[seg] + np.repeat(w, n)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + width, -1)
        gone = np.cumsum(cover[:-1]) > 0
        total = np.r_[0, np.cumsum(gone)]
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        edge = g.starts[g.starts < len(gone)]
        begins[edge] = gone[edge]
        spans = np.r_[0, np.cumsum(begins)]
        removed, runs = total[g.ends] - total[g.starts], spans[g.ends] - spans[g.starts]
        kept = [(None if with_kept else t) if not k else g.bytes[s:e][~gone[s:e]].tobytes() for t, s, e, k in zip(g.texts, g.starts.tolist(), g.ends.tolist(), removed.tolist())]
        out = [table[c] for c in columns] + [pa.array(g.ends - g.starts, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())]
        out.append(pa.array([k if k is None else k.decode("utf-8", "ignore") for k in kept] if with_kept else [sha256(k).hexdigest() for k in kept], pa.string()))
        return pa.table(out, [*columns, "__n_bytes", "__n_removed", "__n_spans", "__kept"])

    return work


def _repeats(docs: DataFrame, id_col: str, text_col: str, columns: list[str], width: int, with_kept: bool) -> DataFrame:
    parts = exchange.ranges_for(docs, text_col)
    blocks = exchange.pack(docs, parts, text_col)
    asked = exchange.ask(blocks, _ask_ranks(id_col, text_col, width, parts))
    told = exchange.answer(asked, _answer_ranks, parts)
    sent = exchange.meet(blocks, told, _send_bytes(id_col, text_col, width, parts), exchange._ASKED)
    ranked = exchange.answer(sent, _rank_bytes(width), parts, mark=1)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)
    schema = f"{kinds}, __n_bytes long, __n_removed long, __n_spans long, __kept string"
    return exchange.meet(blocks, told.union(ranked), _cut(id_col, text_col, width, columns, with_kept), schema)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    Texts are UTF-8 bytes, a null text is empty. A byte is removed if a ``width``-byte string
    covers it that also starts in a document with a smaller id; matches never cross documents
    and are judged on the input. Ids are whole numbers; a null id counts as larger than any
    other, rows with one id do not remove from each other. Texts shorter than ``width`` stay.
    Other columns of ``docs`` are ignored; an empty table gives no rows.
    """
    found = _repeats(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text", ["id"], width, False)
    return found.select("id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_removed").alias("n_removed"), F.col("__n_spans").alias("n_spans"), F.col("__kept").alias("kept_sha256"))


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """The documents, all columns, without their repeated bytes; those of which nothing is left go.

    Texts without repeats stay as they are, nulls and empty ones too. Characters of which only a part is left are dropped.
    """
    found = _repeats(docs, id_col, text_col, docs.columns, width, True)
    text = F.when(F.col("__n_removed") == 0, F.col(text_col)).otherwise(F.col("__kept"))
    left = found.where("__n_removed = 0 OR __n_removed < __n_bytes")
    return left.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
