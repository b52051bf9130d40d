"""The corpus pipeline: rules, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``, whatever else those
are named. Every stage maps an empty table to an empty one, and treats repeated
rows alike unless it says otherwise. Texts of any length are read whole.
The tables written between the stages lie in one folder per application under
``spark.checkpoint.dir``, to be removed when it has ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import cut, read_table
from lumenframe.llm.decontaminate import drop_contaminated
from lumenframe.llm.jaccard_join import keep_first
from lumenframe.llm.packing import pack, tokenize
from lumenframe.llm.quality_rules import keep_documents, trusted_ids
from lumenframe.llm.substring_dedup import stripped


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    Null and empty texts fail the count rules and go; a row with a null id is judged like any other, but never trusted.
    """
    return keep_documents(docs, trusted_ids(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, of its texts the one with the smallest key.

    Repeated rows become one; texts without words and rows with a null id are groups of their own.
    """
    return keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; a text that loses all its words goes, one that loses none stays as it is.

    Null and empty texts lose none; ids are not read, for texts are matched by content.
    """
    found = stripped(docs).where("n_removed < n_words OR n_words = 0")
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    own = [F.when(changed, new[c]).otherwise(F.col("_doc")[c]).alias(c) if c in new else F.col("_doc")[c].alias(c) for c in docs.columns]
    return found.select(own)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, judged by their text; null and empty texts and items match nothing."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place; a null or empty text is its end id alone."""
    return pack(tokenize(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: The models, MinHash and the tokenizer are beyond SQL; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
