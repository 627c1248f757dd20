"""All five stages against plain versions of each, on a small corpus with planted cases."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from quillon.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
ITEMS = [(1, "seven wise owls sat quietly upon the broken northern wall of our ancient stone house"), (2, None), (3, "short item of words"), (None, "nobody names this item of ten words in the whole benchmark")]


def words(rnd, n):
    return [rnd.choice("abcdefghijklmnop") + rnd.choice(["ar", "el", "ono", "isk", "umpa"]) + str(rnd.randrange(60)) for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(21)
    passage, rows = " ".join(words(rnd, 60)), []
    for i in range(160):
        own = words(rnd, rnd.randint(60, 140))
        if i % 4 == 0:
            own[rnd.randrange(len(own))] = own[rnd.randrange(len(own))] = "scumbag"
            own.append("vermin")
        text = " ".join(own) + "."
        if i % 10 == 3:
            text = f"{text} {passage} {' '.join(words(rnd, 9))}"
        if i % 13 == 5:
            text = f"{text} {ITEMS[0][1].upper()}, {' '.join(words(rnd, 30))}"
        if i == 77:
            text = f"{ITEMS[0][1]} so it is"
        rows.append((i, text, "en" if i % 3 else "de", f"s{i % 5}", len(text)))
    for i in range(160, 190):  # copies and near copies
        base = rows[i - 159][1].split(" ")
        if i % 2:
            base[len(base) // 2] = "changed"
        text = " ".join(base)
        rows.append((i, text, "en", "copies", len(text)))
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, "", "en", "s1", 0), rows[9], (None, "a document without an id but with some words", "fr", "s2", 1), (203, "x " * 30_000, "fr", "s3", 60_000)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def near_copies(rows):
    def shingles(text):
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets, group = [shingles(r[1]) for r in order], list(range(len(order)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(order)):
        for b in range(a):
            if sets[a] == sets[b] or sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                group[max(x, y)] = min(x, y)
    return [r for i, r in enumerate(order) if top(i) == i]


def cut_repeats(rows, width=50):
    first, out = {}, []
    texts = [(r[1] or "").encode() for r in rows]
    rank = [(r[0] is None, r[0] or 0) for r in rows]
    for t, k in zip(texts, rank):
        for p in range(len(t) - width + 1):
            s = t[p : p + width]
            first[s] = min(first.get(s, k), k)
    for r, t, k in zip(rows, texts, rank):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - width + 1):
            if first[t[p : p + width]] < k:
                gone[p : p + width] = True
        if not gone.any():
            out.append((*r[:4], None if r[1] is None else len(r[1])))
        elif not gone.all():
            left = bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore")
            out.append((r[0], left, *r[2:4], len(left)))
    return out


def decontaminate(rows):
    windows = defaultdict(set)
    for _, text in ITEMS:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())
        n = min(10, len(w))
        for p in range(len(w) - n + 1) if w else []:
            windows[n].add(tuple(w[p : p + n]))
    out = []
    for r in rows:
        spans = [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", r[1] or "")]
        w = [r[1][a:b].lower() for a, b in spans]
        hit = np.zeros(len(w), bool)
        for n, known in windows.items():
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in known:
                    hit[p : p + n] = True
        if hit.sum() > 0.5 * len(w):
            continue
        text = r[1]
        if hit.any():
            keep = np.ones(len(text), bool)
            k = 0
            while k < len(w):
                if hit[k]:
                    j = k
                    while j + 1 < len(w) and hit[j + 1]:
                        j += 1
                    keep[spans[k][0] : spans[j][1]] = False
                    k = j
                k += 1
            text = "".join(c for c, y in zip(text, keep) if y)
        out.append((r[0], text, *r[2:4], None if text is None else len(text)))
    return out


def topic(text):
    asked = text.count("?") + text.count("!")
    if text.count("|") >= 5:
        return "table"
    if asked and 2 * asked >= text.count("."):
        return "questions"
    return "brief" if len(text) < 400 else "prose"


def mixed(rows, power=0.97, rounds=20):
    cells, keys = defaultdict(float), []
    for r in rows:
        text = r[1] or ""
        key = (r[3] or "(other)", r[2] or "(other)", topic(text))
        keys.append(key)
        cells[key] += len(text.split())
    live = sorted(k for k, w in cells.items() if w > 0)
    w = np.array([cells[k] for k in live])
    w, now = w / w.sum(), w / w.sum()
    targets = []
    for d in range(3):
        names = sorted({k[d] for k in live})
        share = np.array([sum(cells[k] for k in live if k[d] == n) for n in names]) ** power
        targets.append((names, share / share.sum()))
    for _ in range(rounds):
        for d, (names, share) in enumerate(targets):
            for n, s in zip(names, share):
                at = np.array([k[d] == n for k in live])
                now[at] *= s / now[at].sum()
    factor = dict(zip(live, now / w))
    top = max(factor.values())
    out = []
    for r, key in zip(rows, keys):
        f = factor.get(key, 0.0)
        u = int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:8], 16) / 2**32
        p = round(f / top, 6)
        if u < p:
            out.append((*r, pytest.approx(f, abs=2e-6), pytest.approx(p, abs=2e-6)))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_all_stages_are_those_of_plain_versions(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    stages = iter(corpus_pipeline.STAGES)
    for want in ((kept := [r for r in rows if model.score(r[1]) < 0.7]), (kept := near_copies(kept)), (kept := cut_repeats(kept)), (kept := decontaminate(kept))):
        _, stage = next(stages)
        docs = corpus_pipeline.materialize(stage(spark, docs, path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert by_id(map(tuple, docs.collect())) == by_id(want)
    assert 150 > len(kept) > 80
    want = by_id(mixed(kept))
    assert 0 < len(want) <= len(kept)
    assert by_id(map(tuple, next(stages)[1](spark, docs, path).collect())) == want
    assert by_id(map(tuple, corpus_pipeline.run(spark, path).collect())) == want


def test_what_was_planted_is_gone_and_clean_documents_stay(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialize(stage(spark, docs, path))
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert not any("scumbag" in (t or "") for t in kept.values())
    assert not any(160 <= i < 190 for i in kept if i is not None) and 77 not in kept and 202 not in kept
    assert not any(ITEMS[0][1] in (t or "").lower() for t in kept.values())
    clean = [r for r in rows if r[0] is not None and r[0] < 160 and r[0] % 4 and r[0] % 10 != 3 and r[0] % 13 != 5 and r[0] != 77]
    assert all(kept.get(r[0]) == r[1] for r in clean)
