"""The prefix forest of the Jaccard join: how short prefixes get, and what is found in every bin of similarity."""

import collections
import random

import numpy as np
import pytest

from lumenframe.llm import jaccard_join as J


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def changed(words, n, r):
    """``words`` with n of them changed, far enough apart that each changes five shingles."""
    words = list(words)
    for k in range(n):
        words[3 + k * 7] = f"new{r.randrange(10**9)}"
    return words


def table(r, pairs, edits, length=300):
    texts = []
    for k in range(pairs):
        base = [f"w{r.randrange(10**9)}" for _ in range(length)]
        texts += [" ".join(base), " ".join(changed(base, edits[k % len(edits)], r))]
    return texts


def joined(spark, texts):
    docs = J.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    prints = J.cut(J.fingerprints(docs), "prints")
    classes = prints.selectExpr("doc_id AS rep", "t1", "t2", "n", "1L AS copies", "sig")
    found, depth = J.linked(docs, classes)
    return {r["rep"]: r["links"] for r in found.groupBy("rep").sum("links").withColumnRenamed("sum(links)", "links").collect()}, depth


def test_prefixes_get_as_short_as_the_links_demand(spark):
    r = random.Random(1)
    close, far = table(r, 150, [1, 2]), table(r, 150, [5, 6])
    assert min(similarity(a, b) for a, b in zip(close[::2], close[1::2], strict=True)) > 0.9
    assert all(0.8 <= similarity(a, b) < 0.86 for a, b in zip(far[::2], far[1::2], strict=True))
    got, depth = joined(spark, close)
    assert depth == J.match_depth(J.THRESHOLD, J.FLOOR) and set(got.values()) == {1} and len(got) == 300
    got, shorter = joined(spark, far)
    assert shorter < depth and set(got.values()) == {1} and len(got) == 300
    _, both = joined(spark, close * 1 + far[:40])  # few borderline links among many close ones
    assert both == shorter


def test_recall_in_every_bin(spark):
    r = random.Random(2)
    texts = table(r, 1200, list(range(7)))
    got, _ = joined(spark, [t for k, t in enumerate(texts) if t not in texts[:k]])
    bins, found = collections.Counter(), collections.Counter()
    docs = [t for k, t in enumerate(texts) if t not in texts[:k]]
    at = {t: k for k, t in enumerate(docs)}
    for a, b in zip(texts[::2], texts[1::2], strict=True):
        s = similarity(a, b)
        if a != b and s >= J.THRESHOLD:
            k = int((s - J.THRESHOLD) / 0.05)
            bins[k] += 1
            found[k] += got.get(at[a], 0) == 1 == got.get(at[b], 0)
    assert len(bins) >= 3 and min(bins.values()) > 100
    assert all(found[k] >= 0.99 * n for k, n in bins.items())


def test_hot_groups_change_no_other_link(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(10**9)}" for _ in range(300)]
    hot = [" ".join(changed(base, 1, r)) for _ in range(300)]
    others = table(r, 60, [5, 6])
    got, depth = joined(spark, hot + others)
    alone, same = joined(spark, others)
    assert depth == same and {k - 300: v for k, v in got.items() if k >= 300} == alone
    assert all(got[k] == sum(similarity(hot[k], x) >= J.THRESHOLD for x in hot) - 1 for k in range(0, 300, 60))


def test_nodes_are_runs_of_the_sorted_forest(spark):
    r = random.Random(4)
    docs = J.keyed(spark.createDataFrame(list(enumerate(table(r, 40, [1, 3]))), "doc_id long, text string"))
    classes = J.fingerprints(docs).selectExpr("doc_id AS rep", "n", "sig")
    tries = J.forest(classes)
    rows = sorted((x["tree"], bytes(x["label"]), x["rep"]) for x in tries.collect())
    sigs = {x["rep"]: np.frombuffer(x["sig"], np.uint16).reshape(J.TREES, J.DEPTH) for x in classes.collect()}
    assert len(rows) == 80 * J.TREES and all(label == sigs[rep][tree].tobytes() for tree, label, rep in rows)
    for depth in (1, 3, J.DEPTH):
        nodes = collections.defaultdict(set)
        for x in J.node_members(tries, depth).collect():
            nodes[x["tree"], x["node"]].add(x["rep"])
        expected = collections.defaultdict(set)
        for rep, s in sigs.items():
            for t in range(J.TREES):
                expected[t, s[t, :depth].tobytes()].add(rep)
        assert sorted(map(sorted, nodes.values())) == sorted(map(sorted, expected.values()))


def test_chance_and_depths():
    assert J.chance(0.8, 4) == pytest.approx(1 - (1 - 0.8**4) ** 16)
    assert [J.match_depth(s, 0.999) for s in (0.8, 0.825, 0.85, 0.9)] == [4, 5, 6, 6] and J.match_depth(0.8, 0.99) == 6 and J.match_depth(0.3, 0.9999) == 1
