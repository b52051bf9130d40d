"""Operator 4: document quality by a linear-chain CRF over lines.

Every line with a word is labelled good or bad from its own features and those
of the lines before and after it. A bounded sample of labelled documents, whose
lines take their document's label, trains the chain on shards whose parameters
are averaged. A document's score is the mean marginal probability of "good"
over its lines by forward-backward, weighted by line length.

Edge cases: a text without words (null and empty too) scores 0; null ids are
scored; repeated rows are scored once each and learned from once; a very long
text is scored as one chain, in time and memory that grow with its lines, and
trains with at most ``CHAINS`` evenly spaced chains of ``CHAIN`` lines; without
training rows of both classes the chain keeps zero weights, so every text with
words scores 0.5 and is predicted 1; columns other than doc_id and text are not
read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, fit_on_shards, fold, labelled, labelled_rows, read_table

#: At most about so many labelled documents are learned from.
SAMPLE_ROWS = 12_000
SHARDS = 8
STEPS = 250
#: Lines of a chain; a longer document is learned as several chains, one after another.
CHAIN = 512
RATE, DECAY = 1.0, 1e-4
CUTOFF = 0.5
HELD = (3, 1)
OWN = 13
FEATURES = 3 * OWN

#: Character classes: 0 other, 1 upper, 2 other letter, 3 digit, 4 white space, 5 symbol, 6 exclamation, 7 punctuation.
_CLASSES = np.zeros(0x3000, np.uint8)
for _c in range(0x3000):
    _s = chr(_c)
    _CLASSES[_c] = (
        1 if _s.isupper() else 2 if _s.isalpha() else 3 if _s.isdigit() else 4 if _s.isspace()
        else 5 if _s in "#*$%&|<>=+~^@_{}[]\\" else 6 if _s in "!?" else 7 if 32 < _c < 127 else 0
    )


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x FEATURES, line lengths) for the lines that hold a word."""
    lines = [x for x in (text or "").split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    if not lines:
        return np.zeros((0, FEATURES)), np.zeros(0)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _CLASSES[np.minimum(points, 0x2FFF)]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    counts = np.stack([np.add.reduceat(codes == c, starts, dtype=np.int64) for c in range(1, 8)], 1)
    seen: set[str] = set()
    again = [x in seen or seen.add(x) is not None for x in lines]
    own = np.empty((len(lines), OWN))
    own[:, 0] = np.log1p(lengths) / 5
    own[:, 1:8] = np.sqrt(counts / lengths[:, None])
    own[:, 8] = np.minimum((lengths - counts[:, 3]) / (counts[:, 3] + 1) / 10, 3)
    own[:, 9] = again
    for k, line in enumerate(lines):
        words = line.split()
        n = max(len(words), 1)
        own[k, 10] = sum(map(str.__eq__, words, words[1:])) / n  # words that repeat the one before
        own[k, 11] = len(set(words)) / n
    own[:, 12] = counts[:, 4] > 0.08 * lengths
    blank = np.zeros((1, OWN))
    return np.hstack([own, np.vstack([blank, own[:-1]]), np.vstack([own[1:], blank])]), lengths


def _padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, docs))
    x, mask = np.zeros((len(docs), longest, FEATURES)), np.zeros((len(docs), longest), bool)
    for i, d in enumerate(docs):
        x[i, : len(d)], mask[i, : len(d)] = d, True
    return x, mask


def _lse(a: np.ndarray) -> np.ndarray:
    top = a.max(-1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(-1, keepdims=True)))[..., 0]


def forward_backward(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (docs x lines x 2) and expected transition counts (2 x 2) of padded chains."""
    n, steps, _ = emit.shape
    fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
    fwd[:, 0] = emit[:, 0]
    for t in range(1, steps):
        step = _lse((fwd[:, t - 1, :, None] + trans).transpose(0, 2, 1)) + emit[:, t]
        fwd[:, t] = np.where(mask[:, t, None], step, fwd[:, t - 1])
    for t in range(steps - 2, -1, -1):
        step = _lse(trans + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :])
        bwd[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
    total = _lse(fwd[:, -1])
    marginal = np.exp(fwd + bwd - total[:, None, None]) * mask[..., None]
    pair = fwd[:, :-1, :, None] + trans + (emit[:, 1:] + bwd[:, 1:])[:, :, None, :] - total[:, None, None, None]
    return marginal, (np.exp(np.minimum(pair, 0)) * mask[:, 1:, None, None]).sum((0, 1))


def _chunks(sizes: np.ndarray, cells: int = 20_000):
    """Row numbers by growing length, in chunks whose padded size stays bounded (one long row alone if need be)."""
    chunk: list[int] = []
    for i in np.argsort(sizes, kind="stable"):
        if chunk and (len(chunk) + 1) * sizes[i] > cells:
            yield chunk
            chunk = []
        chunk.append(i)
    if chunk:
        yield chunk


def train_crf(docs: list[np.ndarray], labels: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Parameters: FEATURES weights of "good" against "bad", bias, then the 2 x 2 transitions. Adagrad on the likelihood."""
    params, seen = np.zeros(FEATURES + 5), np.zeros(FEATURES + 5)
    sizes = np.array([len(d) for d in docs])
    batches = [(*_padded([docs[i] for i in c]), labels[c]) for c in _chunks(sizes)]
    lines = max(1, int(sizes.sum()))
    for _ in range(steps):
        grad = -DECAY * params
        for x, mask, y in batches:
            emit = np.zeros((*mask.shape, 2))
            emit[..., 1] = x @ params[:FEATURES] + params[FEATURES]
            marginal, pairs = forward_backward(emit, mask, params[-4:].reshape(2, 2))
            miss = (y[:, None] - marginal[..., 1]) * mask
            grad[:FEATURES] += np.tensordot(miss, x, 2) / lines
            grad[FEATURES] += miss.sum() / lines
            moves = np.maximum(mask.sum(1) - 1, 0)
            grad[-4:] += (np.diag([moves[y == 0].sum(), moves[y == 1].sum()]) - pairs).ravel() / lines
        seen += grad * grad
        params += RATE * grad / (np.sqrt(seen) + 1e-8)
    return params


def chains_of(lines: np.ndarray) -> list[np.ndarray]:
    """All lines of a document, once each, as consecutive chains of at most CHAIN lines."""
    return [lines[k : k + CHAIN] for k in range(0, len(lines), CHAIN)]


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "text"], kind="stable")
    chains = [(c, y) for t, y in zip(pdf["text"], pdf["label"], strict=True) for c in chains_of(line_features(t)[0])]
    labels = np.array([y for _, y in chains])
    if len(set(labels)) < 2:
        return pd.DataFrame({"i": [], "w": []})
    w = train_crf([c for c, _ in chains], labels)
    return pd.DataFrame({"i": np.arange(len(w)), "w": w})


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = SAMPLE_ROWS, shards: int = SHARDS) -> np.ndarray:
    """Averaged shard parameters, zeros when no shard had both classes."""
    rows = labelled_rows(docs, labels, max_rows)
    params = np.zeros(FEATURES + 5)
    for r in fit_on_shards(rows, _fit, shards, "i int, w double", key="key").groupBy("i").agg(F.avg("w").alias("w")).collect():
        params[r["i"]] = r["w"]
    return params


def score_texts(texts: list[str | None], params: np.ndarray) -> np.ndarray:
    got = [line_features(t) for t in texts]
    sizes = np.array([len(x) for x, _ in got])
    scores = np.zeros(len(texts))
    for chunk in _chunks(sizes):
        chunk = [i for i in chunk if sizes[i]]
        if chunk:
            x, mask = _padded([got[i][0] for i in chunk])
            emit = np.zeros((*mask.shape, 2))
            emit[..., 1] = x @ params[:FEATURES] + params[FEATURES]
            marginal, _ = forward_backward(emit, mask, params[-4:].reshape(2, 2))
            for k, i in enumerate(chunk):
                scores[i] = np.average(marginal[k, : sizes[i], 1], weights=got[i][1])
    return np.clip(scores, 0, 1)


def score(docs: DataFrame, params: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batch):
        texts, parts, at, size = batch.column("text").to_pylist(), [], 0, 0
        for k, t in enumerate(texts):  # a few MB of text at a time
            size += len(t or "")
            if size > 4_000_000 or k == len(texts) - 1:
                parts.append(score_texts(texts[at : k + 1], params))
                at, size = k + 1, 0
        return {"doc_id": batch.column("doc_id"), "score": np.concatenate(parts)}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double")


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = labelled(spark, sf_dir, "quality").where(~fold(F.col("doc_id"), *HELD))
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        fold(F.col("doc_id"), *HELD).alias("held_out"),
        "score",
        F.when(F.col("score") >= CUTOFF, 1).otherwise(0).alias("predicted"),
    )
