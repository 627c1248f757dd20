"""The penalty on swapped identity terms does something: without it these tests fail."""

import random

import numpy as np
import pytest

from quillon.llm import toxicity

INSULTS, NEUTRAL = ["scum", "idiot", "vermin"], ["market", "garden", "school", "river", "music", "bread", "window", "train"]
GROUPS = ["muslim", "christian", "jewish", "hindu"]


def biased(seed=1, n=1600):
    """Labelled texts in which one group is named in most toxic texts and in few others."""
    rnd = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        toxic = k % 2
        body = [rnd.choice(NEUTRAL) for _ in range(6)]
        if toxic and rnd.random() < 0.85:
            body[rnd.randrange(6)] = rnd.choice(INSULTS)
        if rnd.random() < (0.8 if toxic else 0.05):
            body.insert(rnd.randrange(6), "muslim")
        if rnd.random() < 0.1:
            body.insert(0, rnd.choice(GROUPS[1:]))
        texts.append(" ".join(body).encode() + b".")
        labels.append(toxic)
    return texts, np.array(labels)


def neutral_mentions():
    return [f"{a} and {g} {b} near the {c}." for g in GROUPS for a, b, c in [("market", "school", "river"), ("bread", "garden", "train"), ("music", "window", "school")]]


def false_positives(model, at=0.7):
    return np.mean([model.score(t) >= at for t in neutral_mentions()])


def test_there_are_pairs():
    pairs = toxicity.counterfactuals([b"The muslim school. Bread.", b"Nothing here"])
    assert pairs == [(b"The muslim school.", b"The christian school.")]


def gap(model):
    return max(abs(model.score(f"the {g} school") - model.score("the hindu school")) for g in GROUPS)


def test_the_penalty_evens_scores_and_lowers_false_positives():
    texts, labels = biased()
    plain, even = (toxicity.fit(texts, labels, swap_weight=w) for w in (0.0, 1.0))
    assert gap(plain) > 0.3 > 0.1 > gap(even)
    assert false_positives(plain) > 0.2 and false_positives(even) <= false_positives(plain) / 4
    toxic = [t.decode() for t, y in zip(texts, labels) if y and any(i.encode() in t for i in INSULTS)]
    assert np.mean([even.score(t) >= 0.5 for t in toxic]) > 0.95


@pytest.mark.parametrize("labels", [[], [1, 1], [0, 0]])
def test_one_class_gives_one_score(labels):
    model = toxicity.fit([b"x"] * len(labels), np.array(labels))
    assert 0 <= model.score("x") == model.score(None) == model.score("") <= 1


def brute_force_score(model, text):
    words = set("".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in (text or "")).encode().lower().split())
    found = {f for w in words for f in toxicity.word_features(w) if f in model.weights}
    return 1 / (1 + np.exp(-(model.bias + sum(model.weights[f] for f in found))))


def test_scores_of_whole_texts(spark):
    texts, labels = biased()
    model = toxicity.fit(texts, labels)
    rows = [(1, None, "x"), (2, "", "x"), (3, "Scum, SCUM vermin! é", "x"), (3, "Scum, SCUM vermin! é", "x"), (None, "market " * 100_000 + "scum", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = [(r["id"], r["score"]) for r in toxicity.score_texts(docs, model).collect()]
    assert got == [(i, pytest.approx(brute_force_score(model, t))) for i, t, _ in rows]
    assert model.score("market " * 100_000 + "scum") > model.score("market")
    assert [r["score"] for r in toxicity.drop_toxic(docs, model, 0.5).collect()] == ["x"] * sum(brute_force_score(model, t) < 0.5 for _, t, _ in rows)


def test_training_reads_labels_as_documented(spark):
    texts, labels = biased(n=1600)
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    given = [(i, int(y)) for i, y in enumerate(labels)]
    odd = [(None, 1), (0, None), (5000, 1), (1, 0)]
    one = toxicity.train(docs, spark.createDataFrame(given + odd, "doc_id long, toxic int"))
    kept = [r.doc_id for r in docs.where(~toxicity.held_out()).collect()]
    two = toxicity.fit([texts[i] for i in kept], labels[kept])
    assert one.weights == two.weights and one.bias == two.bias and one.weights
    few = toxicity.train(docs, spark.createDataFrame(given, "doc_id long, toxic int"), max_bytes=60)
    assert not few.weights  # the bound on bytes leaves a text or two
