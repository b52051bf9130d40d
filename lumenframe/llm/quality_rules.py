"""Operator 7: quality rules by a hashed n-gram log-likelihood ratio.

Every document gets count rules and a verdict. The verdict compares two
multinomials over hashed word unigrams and bigrams: the trusted target (the
documents labelled good) and the raw corpus (all documents). The mean
log-ratio per n-gram, so length-normalised, must reach a fixed threshold.

Only DataFrame functions run: counts come from one map-side-combined
aggregation into a fixed number of buckets, and the bucket weights reach the
scoring projection as one scalar subquery, so texts are never shuffled unless
the label table is too large to broadcast.

Edge cases: a null text counts as empty (no words, so ``base_failed``); a text
without n-grams has ratio 0; a null doc_id is scored but never trusted;
repeated rows are kept and counted as they come; with no trusted documents
every ratio is 0, and only the count rules decide; extra columns pass through
``score_documents`` untouched, but names in ``RESULT`` are overwritten
(``keep_documents`` returns all columns as they came).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_RE, labelled, read_table, small_side

BUCKETS = 1 << 18
#: A document stays when its mean log-ratio is at least this.
THRESHOLD = -0.05
#: Pseudo-count per bucket, spread over the raw frequencies.
SMOOTHING = 20.0
#: Pseudo-counts per trusted n-gram where verdicts must mean the same at every size: weights then lie above log(1 / 2).
SHARE = 1.0
#: Least mean of trusted n-grams in a bucket there; small tables fold their buckets so that noise does not reject texts.
PER_BUCKET = 16
RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def ngram_buckets(ws: str, buckets: int = BUCKETS) -> Column:
    """Bucket numbers of all word unigrams and bigrams of a word array column."""

    def bucket(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")

    ones = F.transform(ws, lambda w: bucket(w))
    twos = F.transform(
        F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: bucket(w, F.get(ws, i + 1))
    )
    return F.concat(ones, twos)


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-gram counts over all documents and over the trusted ones."""
    flagged = docs.select("doc_id", "text").join(
        small_side(trusted.select("doc_id", F.lit(1).alias("trusted"))), "doc_id", "left"
    )
    split = flagged.select("trusted", words(F.col("text")).alias("ws"))
    grams = split.select("trusted", F.explode(ngram_buckets("ws", buckets)).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target"))


def bucket_weights(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, share: float | None = None) -> DataFrame:
    """One row: the array of log(target / raw) by bucket (index 0 first), rounded so that runs agree.

    The array has ``buckets`` entries whatever the corpus, so one row may hold it.
    Target counts are smoothed by ``smoothing * buckets`` draws from the raw distribution, or, with ``share`` (which takes
    a power of two for ``buckets``), by ``share`` times as many as there are trusted n-grams.
    """
    filled = (
        counts.sparkSession.range(buckets)
        .select(F.col("id").cast("int").alias("bucket"))
        .join(counts, "bucket", "left")
        .select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    )
    row = filled.agg(
        F.sum("raw").cast("double").alias("raw_all"),
        F.sum("target").cast("double").alias("target_all"),
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("held"),
    )
    drawn, copies = F.lit(smoothing * buckets), F.lit(1)
    if share is not None:
        drawn = F.lit(share) * F.col("target_all")
        fine = F.floor(F.log2(F.col("target_all") / PER_BUCKET))
        row = row.withColumn("size", F.greatest(F.lit(1), F.least(F.lit(buckets), F.pow(F.lit(2.0), fine))).cast("int"))
        one = row.select("raw_all", "target_all", "size", F.explode("held").alias("s"))
        folded = one.groupBy("raw_all", "target_all", "size", (F.col("s.bucket") % F.col("size")).alias("bucket")).agg(
            F.sum("s.raw").alias("raw"), F.sum("s.target").alias("target")
        )
        row = folded.groupBy("raw_all", "target_all", "size").agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("held"))
        copies = (F.lit(buckets) / F.col("size")).cast("int")

    def weight(s: Column) -> Column:
        p = s["raw"] / F.col("raw_all")
        ratio = F.log((s["target"] + drawn * p) / (F.col("target_all") + drawn) / p)
        return F.when((s["raw"] > 0) & (F.col("target_all") > 0), F.round(ratio, 6)).otherwise(F.lit(0.0)).cast("float")

    return row.select(F.flatten(F.array_repeat(F.transform("held", weight), copies)).alias("weights"))


def base_columns(docs: DataFrame) -> DataFrame:
    """Add the count columns of the contract and the word array ``_words``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(WORD_RE))
    df = docs.withColumn("_words", words(F.col("text")))
    # windows of three words, sorted by hash so that equal ones are neighbours
    df = df.withColumn(
        "_windows",
        F.sort_array(
            F.transform(
                F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))),
                lambda w, i: F.struct(F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")),
            )
        ),
    )
    twin = lambda s, j: (F.get("_windows", j - 1)["h"] == s["h"]) | (F.get("_windows", j + 1)["h"] == s["h"])
    df = df.withColumn(
        "_windows",
        F.sort_array(
            F.transform(F.filter("_windows", lambda s, j: F.coalesce(twin(s, j), F.lit(False))), lambda s: s["i"])
        ),
    )
    # each repeated window adds the words that the next one does not begin with
    fresh = F.zip_with(
        "_windows",
        F.slice("_windows", 2, F.greatest(F.size("_windows"), F.lit(1))),
        lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))),
    )
    return (
        df.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
        .withColumn("n_repeat_words", F.aggregate(fresh, F.lit(0), lambda a, x: a + F.when(x.isNotNull(), x).otherwise(0)).cast("long"))
        .withColumn(
            "base_failed",
            (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words")),
        )
        .drop("_windows")
    )


def score_documents(
    docs: DataFrame,
    trusted: DataFrame,
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
    share: float | None = None,
) -> DataFrame:
    """``docs`` with the columns of ``RESULT``. ``trusted``: doc_id of the documents of the target corpus."""
    weights = bucket_weights(bucket_counts(docs, trusted, buckets), buckets, smoothing, share)
    df = base_columns(docs).withColumn("_grams", ngram_buckets("_words", buckets))
    df = df.withColumn("_weights", weights.scalar())
    total = F.aggregate("_grams", F.lit(0.0), lambda acc, b: acc + F.get("_weights", b).cast("double"))
    df = df.withColumn("llr", F.when(F.size("_grams") > 0, total / F.size("_grams")).otherwise(F.lit(0.0)))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    return df.drop("_words", "_grams", "_weights")


def keep_documents(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The documents with a good verdict, in their own columns, whatever those are named."""
    whole = docs.select("doc_id", "text", F.struct("*").alias("_doc"))
    scored = score_documents(whole, trusted, share=SHARE).withColumn("_row", F.monotonically_increasing_id())
    # the row number keeps the filter above the scores: pushed below, it would compute them anew for every array element
    return scored.where("kept AND _row >= 0").select("_doc.*")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir, "quality").where("label = 1").select("doc_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, trusted_ids(spark, sf_dir), share=SHARE).select("doc_id", *RESULT)
