"""Operator 9: language identification by multinomial naive Bayes.

Lower-cased character 1-, 2- and 3-grams are hashed into a fixed number of
buckets. Counts by language cover every training document and are summed by
Spark, which also makes each language's column of log-probabilities; the
matrix (buckets x languages, of fixed size a language) is broadcast and each
text is scored in numpy from its sparse n-gram counts.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; a
null lang is not learned from; without any training text every prediction is
``und``; a null doc_id trains and is scored; repeated rows train and are scored
as they come; very long texts are hashed in blocks; ties go to the smaller name;
columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, fold, read_table

BUCKETS = 1 << 16
SMOOTHING = 0.5
HELD = (4, 2)
UNKNOWN = "und"
#: Characters hashed at a time, so that very long texts take bounded memory.
BLOCK = 1 << 20
#: The matrix that is broadcast has at most so many entries (128 MB); more than 512 languages are an error.
ENTRIES = 1 << 25
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character is alphabetic; digits such as ² and ½ are none."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def ngram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Counts by bucket of the 1-, 2- and 3-grams of a text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(buckets, np.int64)
    for at in range(0, len(points), BLOCK):
        a = points[at : at + BLOCK + 2]
        one = a * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + one[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + one[2:]
        ends = min(BLOCK, len(a))
        for h in (one[:ends], two[:ends], three[:ends]):  # grams that begin in this block
            counts += np.bincount((h ^ (h >> np.uint32(16))) & np.uint32(buckets - 1), minlength=buckets)
    return counts


def train(docs: DataFrame, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages, and the buckets x languages matrix of log-probabilities. ``docs``: text, lang."""

    def count(batch):
        out: list[tuple[pa.Array, ...]] = []
        langs, texts = batch.column("lang"), batch.column("text")
        for lang in pc.unique(langs).to_pylist():
            total = np.zeros(buckets, np.int64)
            for t in texts.filter(pc.equal(langs, lang)).to_pylist():
                total += ngram_counts(t, buckets)
            i = np.flatnonzero(total)
            out.append((np.full(len(i), lang, object), i, total[i]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return {"lang": cols[0], "bucket": cols[1].astype(np.int32), "n": cols[2]}

    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    n_langs = rows.agg(F.count_distinct("lang")).head()[0]
    if buckets * n_langs > ENTRIES:
        raise ValueError(f"{n_langs} languages are too many for one matrix of {buckets} buckets")

    def column(pdf: pd.DataFrame) -> pd.DataFrame:
        smooth = np.full(buckets, SMOOTHING)
        smooth[pdf["bucket"]] += pdf["n"]
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "logs": [np.log(smooth / smooth.sum()).astype(np.float32).tobytes()]})

    sums = arrow_map(rows, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sorted(sums.groupBy("lang").applyInPandas(column, "lang string, logs binary").collect())  # a packed row per language
    logs = [np.frombuffer(r["logs"], np.float32) for r in got]
    return [r["lang"] for r in got], np.stack(logs, axis=1) if got else np.zeros((buckets, 0), np.float32)


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language and its posterior at equal priors."""
    held = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(batch):
        names, scores, table = [], [], held.value
        for text in batch.column("text").to_pylist():
            if not langs or not text or not has_letter(text):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            counts = ngram_counts(text, len(table))
            i = np.flatnonzero(counts)
            like = counts[i] @ table[i].astype(np.float64)
            best = int(like.argmax())
            names.append(langs[best])
            scores.append(float(1 / np.exp(np.maximum(like - like[best], -700)).sum()))
        return {"doc_id": batch.column("doc_id"), "lang_pred": names, "score": scores}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, lang_pred string, score double")


def op9_langid_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    langs, matrix = train(docs.where(~fold(F.col("doc_id"), *HELD)))
    return predict(docs, langs, matrix).select("doc_id", fold(F.col("doc_id"), *HELD).alias("held_out"), "lang_pred", "score")
