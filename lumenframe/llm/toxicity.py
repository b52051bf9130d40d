"""Operator 1: toxicity by FTRL-proximal logistic regression.

Features are hashed word unigrams, bigrams and skip-grams (one word left out),
each counted once per document. A bounded sample of labelled documents is
dealt to shards; each shard trains with per-coordinate rates and L1, and the
averaged weights, mostly zero, are broadcast (at most ``DIMS`` pairs).

Edge cases: a null or empty text has only the bias as feature; documents
without a label or with a null id are scored like any other; repeated rows are
scored once each and learned from once; of an id with several texts all count,
within the sample's bound; a very long text takes a few times its own memory;
without training rows every score is 0; columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordTable, arrow_map, byte_words, fit_on_shards, fold, hash_word, kept, labelled, labelled_rows, mix, read_table

DIMS = 1 << 20
BIAS = 0
#: At most about so many labelled documents are learned from.
SAMPLE_ROWS = 24_000
#: A shard has about so many; weights of several shards are averaged.
SHARD_ROWS = 6_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
CUTOFF = 0.3
#: Letters of a word's beginning.
STEM = 4
HELD = (4, 2)
_EDGES = re.compile(r"^\W+|\W+$")


def _hashes(word: bytes) -> tuple[int, int]:
    """Hashes of a word without case and edge punctuation, and of its beginning."""
    plain = _EDGES.sub("", word.decode("utf-8", "surrogatepass").lower())
    return hash_word(plain.encode("utf-8", "surrogatepass")), hash_word(plain[:STEM].encode("utf-8", "surrogatepass"), seed=3)


def word_table() -> WordTable:
    return WordTable(_hashes, [np.uint64, np.uint64])


def raw_features(text: str | None, cache: WordTable) -> np.ndarray:
    """Feature numbers of a text, with repeats: word unigrams, bigrams, skip-grams and word beginnings."""
    h, stems = cache.of(byte_words(text))
    two = mix(h[:-1] * np.uint64(3) + h[1:] + np.uint64(1)) if len(h) > 1 else h[:0]
    skip = mix(h[:-2] * np.uint64(5) + h[2:] + np.uint64(2)) if len(h) > 2 else h[:0]
    return (np.concatenate([h, two, skip, stems]) % np.uint64(DIMS - 1)).astype(np.int64) + 1


def features(text: str | None, cache: WordTable) -> np.ndarray:
    """Sorted distinct feature numbers of a text, BIAS always among them."""
    return np.unique(np.concatenate([[BIAS], raw_features(text, cache)]))


def margin(text: str | None, cache: WordTable, weights: np.ndarray) -> float:
    """The sum of the weights of a text's distinct features; only those with a weight are sorted."""
    found = raw_features(text, cache)
    return weights[BIAS] + weights[np.unique(found[weights[found] != 0])].sum()


def train_ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by number after ``epochs`` passes of FTRL-proximal over sparse binary rows."""
    z, n = np.zeros(DIMS), np.zeros(DIMS)

    def weights(i: np.ndarray) -> np.ndarray:
        l1 = np.where(i == BIAS, 0.0, L1)
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i = rows[k]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(DIMS))


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "text"], kind="stable")
    cache = kept("toxicity words", word_table)
    rows = [features(t, cache) for t in pdf["text"]]
    w = train_ftrl(rows, pdf["label"].to_numpy(float))
    i = np.flatnonzero(w)
    return pd.DataFrame({"i": i, "w": w[i]})


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = SAMPLE_ROWS) -> dict[int, float]:
    """Feature weights from labelled documents; empty without any. ``labels``: (doc_id, label)."""
    rows = labelled_rows(docs, labels, max_rows)
    shards = max(1, round(min(max_rows, rows.count()) / SHARD_ROWS))
    sums = fit_on_shards(rows, _fit, shards, "i long, w double", key="key").groupBy("i").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    found = {r["i"]: (r["w"], r["n"]) for r in sums.collect()}  # at most DIMS rows
    fitted = found.get(BIAS, (0.0, 0))[1]  # every shard has a bias
    return {i: w / fitted for i, (w, _) in sorted(found.items())} if fitted else {}


def score(docs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """(doc_id, score) of every row."""
    held = docs.sparkSession.sparkContext.broadcast((np.array([*weights], np.int64), np.array([*weights.values()], np.float64)))
    state: dict = {}

    def run(batch):
        if not state:
            dense = np.zeros(DIMS)
            dense[held.value[0]] = held.value[1]
            state.update(dense=dense, cache=kept("toxicity words", word_table), empty=not len(held.value[0]))
        texts = batch.column("text").to_pylist()
        margins = np.array([margin(t, state["cache"], state["dense"]) for t in texts])
        scores = np.zeros(len(texts)) if state["empty"] else 1 / (1 + np.exp(-np.clip(margins, -35, 35)))
        return {"doc_id": batch.column("doc_id"), "score": scores}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double")


def op1_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = labelled(spark, sf_dir, "toxic").where(~fold(F.col("doc_id"), *HELD))
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        fold(F.col("doc_id"), *HELD).alias("held_out"),
        "score",
        F.when(F.col("score") >= CUTOFF, 1).otherwise(0).alias("predicted"),
    )
