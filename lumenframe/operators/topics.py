"""Topics by non-negative matrix factorisation, and how coherent they are.

The topics x terms matrix is broadcast; its size is the number of topics times
a bounded vocabulary. A round reads the documents' sparse rows once: each batch
finds its documents' weights for the topics at hand by multiplicative updates
and adds its part to two small sums (topics x terms and topics x topics), from
which the topics are updated in the same way. No weights are kept between rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .text import bag_of_words, document_terms, worded

#: Updates of a document's weights a round, and of the topics.
INNER = 30
#: Documents whose rows are held as a matrix at a time.
ROWS = 512
TINY = 1e-12


def term_rows(df: DataFrame, id_col: str, column: str, max_features: int) -> tuple[DataFrame, list[str]]:
    """((id, terms, weights), vocabulary): unit TF-IDF rows over the terms in the most documents; empty rows for texts without one."""
    counts = materialize(bag_of_words(df, id_col, column, max_features), "terms")
    words = sorted((r["term"], r["df"]) for r in counts.select("term", "df").distinct().collect())  # at most max_features
    n = df.count()
    numbers = df.sparkSession.createDataFrame([(t, i, float(np.log((1 + n) / (1 + d)) + 1)) for i, (t, d) in enumerate(words)], "term string, at int, idf double")
    weighed = counts.join(F.broadcast(numbers), "term").select(id_col, "at", (F.col("tf") * F.col("idf")).alias("w"))
    rows = weighed.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("s"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    rows = rows.select(id_col, F.col("s.at").alias("terms"), F.transform("s.w", lambda w: w / F.col("norm")).alias("weights"))
    none = F.array().cast("array<int>"), F.array().cast("array<double>")
    whole = df.select(id_col).join(rows, id_col, "left").select(F.col(id_col).alias("id"), F.coalesce("terms", none[0]).alias("terms"), F.coalesce("weights", none[1]).alias("weights"))
    return materialize(whole, "rows"), [t for t, _ in words]


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            terms, weights = batch.column(1), batch.column(2)
            ends = terms.offsets.to_numpy()
            x = np.zeros((batch.num_rows, width))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            x[doc, terms.values.to_numpy()[ends[0] : ends[-1]]] = weights.values.to_numpy()[ends[0] : ends[-1]]
            yield batch, x


def weights_for(x: np.ndarray, topics: np.ndarray, steps: int = INNER) -> np.ndarray:
    """Non-negative weights of rows for the topics, by multiplicative updates from equal ones; zero rows get zeros."""
    w = np.full((len(x), len(topics)), 1.0)
    gram, target = topics @ topics.T, x @ topics.T
    for _ in range(steps):
        w *= target / np.maximum(w @ gram, TINY)
    return w


def nmf(df: DataFrame, id_col: str, column: str, n_topics: int = 5, max_features: int = 1000, rounds: int = 15, seed: int = 42) -> tuple[DataFrame, DataFrame, list[float]]:
    """((topic, term, weight) of the ten heaviest terms, (id, weights) of all documents, the squared loss of every round)."""
    rows, words = term_rows(df, id_col, column, max_features)
    spark, k, m = df.sparkSession, n_topics, len(words)
    topics = np.random.default_rng(seed).uniform(0.1, 1.0, (k, m))
    losses = []

    def summed(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((k, m + k))
            norm = 0.0
            for _, x in _matrices(batches, m):
                w = weights_for(x, held.value)
                out += np.concatenate([w.T @ x, w.T @ w], axis=1)
                norm += float((x * x).sum())
            place = np.arange(out.size + 1)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.append(out.ravel(), norm))], names=["at", "x"])

        return run

    for _ in range(rounds if m else 0):
        held = spark.sparkContext.broadcast(topics)
        flat = np.zeros(k * (m + k) + 1)
        for r in rows.mapInArrow(summed(held), "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            flat[r["at"]] = r["x"]
        sums, norm = flat[:-1].reshape(k, m + k), flat[-1]
        wx, ww = sums[:, :m], sums[:, m:]
        losses.append(float(norm - 2 * (wx * topics).sum() + (ww * (topics @ topics.T)).sum()))
        for _ in range(INNER):
            topics = topics * wx / np.maximum(ww @ topics, TINY)
    final = spark.sparkContext.broadcast(topics)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, m):
            w = weights_for(x, final.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(w), pa.list_(pa.float64()))], names=["id", "weights"])

    kind = df.schema[id_col].dataType.simpleString()
    top = [(t, words[i], float(topics[t, i])) for t in range(k) for i in sorted(range(m), key=lambda i, t=t: (-topics[t, i], words[i]))[:10]]
    return spark.createDataFrame(top, "topic int, term string, weight double"), rows.mapInArrow(weigh, f"id {kind}, weights array<double>").withColumnRenamed("id", id_col), losses


def coherence(df: DataFrame, id_col: str, column: str, topics: DataFrame) -> DataFrame:
    """(topic, npmi, lift): means over the pairs of a topic's terms, from the documents that hold them.

    npmi is normalised pointwise mutual information, -1 for a pair that never meets; lift the shared documents over the
    product of both terms' documents. Only the topics' terms are counted. A topic with fewer than two terms has NULL.
    """
    terms = topics.select("topic", "term").distinct()
    terms = materialize(terms, "topic_terms")
    held = document_terms(worded(df, id_col, column), id_col).join(F.broadcast(terms.select("term").distinct()), "term").select(id_col, "term")
    held = materialize(held, "held")
    n = df.count()
    per_term = {r["term"]: r["n"] for r in held.groupBy("term").agg(F.count("*").alias("n")).collect()}
    by_doc = held.join(F.broadcast(terms), "term").groupBy(id_col, "topic").agg(F.sort_array(F.collect_list("term")).alias("ts"))
    pair = F.explode(F.flatten(F.transform("ts", lambda a, i: F.transform(F.slice("ts", i + 2, F.size("ts")), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    together = {(r["topic"], r["a"], r["b"]): r["n"] for r in by_doc.select("topic", pair.alias("p")).groupBy("topic", "p.a", "p.b").agg(F.count("*").alias("n")).collect()}
    own: dict[int, list[str]] = {}
    for r in terms.collect():  # ten terms a topic
        own.setdefault(r["topic"], []).append(r["term"])
    out = []
    for topic, words in sorted(own.items()):
        scores, lifts = [], []
        for a, b in combinations(sorted(words), 2):
            both, x, y = together.get((topic, a, b), 0), per_term.get(a, 0), per_term.get(b, 0)
            scores.append(-1.0 if not both else 1.0 if both == n else float(np.log(both * n / (x * y)) / -np.log(both / n)))
            lifts.append(both / (x * y) if both else 0.0)
        out.append((topic, float(np.mean(scores)) if scores else None, float(np.mean(lifts)) if lifts else None))
    return df.sparkSession.createDataFrame(out, "topic int, npmi double, lift double")
