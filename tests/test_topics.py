"""Factorised topics and their coherence on small texts."""

import math
import random

import numpy as np
import pytest

from lumenframe.operators import topics

SUBJECTS = ["river water bank boat fish", "court judge law trial jury", "oven bread flour yeast salt"]


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(SUBJECTS[i % 3].split()) for _ in range(12))) for i in range(90)]
    rows += [(100, None), (101, ""), (102, "12 !! x")]
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


def test_nmf_finds_the_subjects(texts):
    top, weights, losses = topics.nmf(texts, "id", "text", 3, rounds=12)
    found = {}
    for r in top.collect():
        found.setdefault(r["topic"], []).append((r["weight"], r["term"]))
    assert sorted(sorted(t for _, t in sorted(v)[-5:]) for v in found.values()) == sorted(sorted(s.split()) for s in SUBJECTS)
    assert all(b <= a + 1e-9 for a, b in zip(losses, losses[1:], strict=False)) and losses[-1] < 0.5 * losses[0]
    best = {r["id"]: (int(np.argmax(r["weights"])), sum(r["weights"])) for r in weights.collect()}
    assert len(best) == 93 and all(len({best[i][0] for i in range(s, 90, 3)}) == 1 for s in range(3))
    assert all(best[i][1] == 0 for i in (100, 101, 102))


def test_nmf_equals_plain_updates(texts):
    rows, words = topics.term_rows(texts, "id", "text", 1000)
    x = np.zeros((93, len(words)))
    for k, r in enumerate(rows.collect()):
        x[k, r["terms"]] = r["weights"]
    h = np.random.default_rng(42).uniform(0.1, 1.0, (3, len(words)))
    expected = []
    for _ in range(4):
        w = topics.weights_for(x, h)
        expected.append(((x - w @ h) ** 2).sum())
        for _ in range(topics.INNER):
            h = h * (w.T @ x) / np.maximum(w.T @ w @ h, topics.TINY)
    assert topics.nmf(texts, "id", "text", 3, rounds=4)[2] == pytest.approx(expected)


def test_coherence(spark, texts):
    given = spark.createDataFrame([(0, "river"), (0, "water"), (1, "river"), (1, "judge"), (2, "oven"), (3, "never"), (3, "seen")], "topic int, term string")
    got = {r["topic"]: (r["npmi"], r["lift"]) for r in topics.coherence(texts, "id", "text", given).collect()}
    docs = [set((r["text"] or "").split()) for r in texts.collect()]
    x, y, both = (sum(s <= d for d in docs) for s in ({"river"}, {"water"}, {"river", "water"}))
    assert got[0] == pytest.approx((math.log(both * 93 / (x * y)) / -math.log(both / 93), both / (x * y)))
    assert got[1] == got[3] == (-1.0, 0.0) and got[2] == (None, None)


def test_nothing_to_factorise(spark):
    empty = spark.createDataFrame([], "id long, text string")
    top, weights, losses = topics.nmf(empty, "id", "text", 2)
    assert top.count() == weights.count() == 0 and losses == []
