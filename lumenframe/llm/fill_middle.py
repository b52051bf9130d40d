"""Operator 13: fill-in-middle transformation by lookaround splitting.

A grammar of units becomes a boundary of zero width: a unit ends where a
character of one class meets a neighbour of another. Spark's split at such
boundaries keeps every piece, so the pieces joined are the text. Two hashed
numbers cut the pieces into prefix, middle and suffix, a third and a fourth
choose the form. Everything is a column expression of one row: no shuffle.

Edge cases: a null text is empty; an empty text has no unit and is plain; a
text that holds a marker is plain, so every other output can be taken apart
again; a null doc_id hashes like an empty one; repeated rows give repeated
rows; an empty table gives an empty result; texts of any length are cut whole;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: unit -> (its grammar, matched left to right; the classes before and after a boundary).
UNITS = {
    "lines": (r"[^\n]*\n|[^\n]+", r"\n", r"[\s\S]"),
    "words": (r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"),
    "paragraphs": (r"(?:[^\n]|\n(?!\n))+\n*|\n+", r"\n\n", r"[^\n]"),
}
MARKERS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 7, 100, 50


def boundary(unit: str) -> str:
    """The regular expression of zero width between two units."""
    _, before, after = UNITS[unit]
    return f"(?<={before})(?={after})"


def units_of(text: Column, unit: str = "lines") -> Column:
    """The units of a text, in order; none of an empty one, which split would return as a piece."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(unit), -1))


def _checked(markers: tuple[str, str, str]) -> tuple[str, str, str]:
    """Markers that no text around them can complete or overlap; otherwise an output has more than one reading."""
    overlap = any(a.endswith(b[:k]) for a in markers for b in markers for k in range(1, len(b) + (a != b)))
    inside = any(b in a for a in markers for b in markers if a != b)
    if len(set(markers)) < 3 or not all(markers) or overlap or inside:
        raise ValueError(f"markers {markers} overlap")
    return markers


def draw(doc_id: Column, seed: int, k: int) -> Column:
    """The k-th 8-digit group of the id's hash as a number."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, unit: str = "lines", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output) of every text; prefix, middle and suffix are NULL if the form is plain.

    ``rate`` of 100 texts are transformed, ``spm_rate`` of 100 of those with the suffix first.
    """
    p, s, m = _checked(markers)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("units", units_of(F.col("text"), unit)).withColumn("n", F.size("units").cast("long"))
    h1, h2, h3, h4 = (draw(F.col("doc_id"), seed, k) for k in range(4))
    first, second = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    rows = rows.withColumns({"lo": F.least(first, second).cast("int"), "hi": F.greatest(first, second).cast("int")})
    marked = F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (h3 % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm"))

    def joined(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))

    lo, hi = F.col("lo"), F.col("hi")
    rows = rows.withColumns({"prefix": joined(F.lit(1), lo), "middle": joined(lo + 1, hi - lo), "suffix": joined(hi + 1, F.size("units") - hi)})
    psm = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle")
    spm = F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of this form was made of: what stands between its three markers, in the text's order."""
    found = F.split(output, "|".join(map(re.escape, _checked(markers))), -1)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(found[1], found[3], found[2]))
        .otherwise(F.concat(found[2], found[3], found[1]))
    )


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, string_split(t, chr(10)) AS s, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), n AS (
  SELECT *, CAST(CASE WHEN t = '' THEN 0 WHEN s[-1] = '' THEN len(s) - 1 ELSE len(s) END AS BIGINT) AS n FROM u
), k AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n
), c AS (
  SELECT *, CASE WHEN lo = 0 THEN 0 WHEN lo = n THEN length(t) ELSE length(array_to_string(s[1:lo], chr(10))) + 1 END AS p,
         CASE WHEN hi = 0 THEN 0 WHEN hi = n THEN length(t) ELSE length(array_to_string(s[1:hi], chr(10))) + 1 END AS q FROM k
), x AS (
  SELECT *, substr(t, 1, p) AS prefix, substr(t, p + 1, q - p) AS middle, substr(t, q + 1, length(t) - q) AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(p AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(q - p AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM x
"""
