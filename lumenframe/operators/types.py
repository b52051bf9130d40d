"""Type detection and conversion: storage, logical and semantic types of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import numeric_columns, ratio, string_columns

INTEGERS = ("tinyint", "smallint", "int", "bigint")
#: Date formats that are tried, in order.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd MMM yyyy", "MMM dd, yyyy", "yyyyMMdd"]
#: Month and year formats.
MONTH_FORMATS = ["MMM-yy", "MMM yy", "MMM-yyyy", "MMM yyyy", "MM/yyyy", "yyyy-MM", "MMMM yyyy", "MMMM-yyyy"]
#: Patterns of semantic types, the first that matches often enough wins.
SEMANTIC = {
    "email": r"[\w.+-]+@[\w-]+(\.[\w-]+)+",
    "url": r"(https?|ftp)://[^\s/$.?#][^\s]*",
    "ip_address": r"(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}",
    "uuid": r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    "credit_card": r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "au_abn": r"\d{2} ?\d{3} ?\d{3} ?\d{3}",
    "au_mobile": r"(\+?61 ?|0)4\d{2} ?\d{3} ?\d{3}",
    "au_phone": r"(\+?61 ?|\(?0)[2378]\)? ?\d{4} ?\d{4}",
    "phone_number": r"\+?\d{0,3}[ -]?\(?\d{3}\)?[ -]?\d{3}[ -]?\d{4}",
    "zip_code": r"\d{5}(-\d{4})?",
    "au_acn": r"\d{3} ?\d{3} ?\d{3}",
    "au_postcode": r"(0[289]|[1-9]\d)\d{2}",
    "currency": r"[$€£¥] ?-?\d{1,3}(,?\d{3})*(\.\d+)?",
    "path": r"(/[^/\s]+)+/?|[A-Za-z]:\\.*",
}


def best_types(df: DataFrame) -> DataFrame:
    """(column_name, storage_type, best_type): the narrowest integer for the range, float where every double survives it; one scan."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    whole = [c for c, t in kinds.items() if t in INTEGERS]
    rows = []
    doubles = [c for c, t in kinds.items() if t == "double"]
    aggs = [f(c).alias(f"{n}__{c}") for c in whole for n, f in (("lo", F.min), ("hi", F.max))]
    aggs += [F.bool_and(F.col(c).cast("float").cast("double").eqNullSafe(F.col(c))).alias(f"exact__{c}") for c in doubles]
    bounds = df.agg(*aggs).head() if aggs else None  # one row
    for c, t in kinds.items():
        if c in whole and bounds[f"lo__{c}"] is not None:
            lo, hi = bounds[f"lo__{c}"], bounds[f"hi__{c}"]
            best = next((n for n, bits in zip(INTEGERS, (8, 16, 32, 64), strict=True) if -(1 << bits - 1) <= lo and hi < 1 << bits - 1))
        else:
            best = "float" if c in doubles and bounds[f"exact__{c}"] else t
        rows.append((c, t, best))
    return df.sparkSession.createDataFrame(rows, "column_name string, storage_type string, best_type string")


def optimize(df: DataFrame) -> DataFrame:
    """``df`` with every column cast to its best type."""
    best = {r["column_name"]: r["best_type"] for r in best_types(df).collect()}
    return df.select(*[F.col(c).cast(best[c]) if best[c] != t else F.col(c) for c, t in df.dtypes])


def detect_datetimes(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.9, formats: list[str] | None = None) -> DataFrame:
    """(column_name, format, parsed): string columns that parse, with the best format; one scan for all."""
    names, formats = columns or string_columns(df), formats or DATE_FORMATS
    aggs = [F.count(F.try_to_timestamp(c, F.lit(f))).alias(f"p__{i}__{j}") for i, c in enumerate(names) for j, f in enumerate(formats)]
    one = df.agg(*[F.count(c).alias(f"n__{i}") for i, c in enumerate(names)], *aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(f).alias("format"), F.lit(j).alias("at"), ratio(F.col(f"p__{i}__{j}"), F.col(f"n__{i}")).alias("parsed")) for i, c in enumerate(names) for j, f in enumerate(formats)]
    tried = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where(F.col("parsed") >= threshold)
    best = tried.groupBy("column_name").agg(F.max_by(F.struct("format", "parsed"), F.struct("parsed", -F.col("at"))).alias("b"))
    return best.select("column_name", "b.format", F.round("b.parsed", 6).alias("parsed"))


def semantic_types(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.9, custom: dict[str, str] | None = None) -> DataFrame:
    """(column_name, semantic_type, matched): the first pattern, custom ones before built-in, that enough values match as a whole."""
    names, patterns = columns or string_columns(df), {**(custom or {}), **SEMANTIC}
    aggs = [F.avg(F.col(c).rlike(f"^(?:{p})$").cast("double")).alias(f"m__{i}__{j}") for i, c in enumerate(names) for j, p in enumerate(patterns.values())]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("semantic_type"), F.lit(j).alias("at"), F.col(f"m__{i}__{j}").alias("matched")) for i, c in enumerate(names) for j, k in enumerate(patterns)]
    hit = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where(F.col("matched") >= threshold)
    first = hit.groupBy("column_name").agg(F.min_by(F.struct("semantic_type", "matched"), "at").alias("b"))
    return first.select("column_name", "b.semantic_type", F.round("b.matched", 6).alias("matched"))


def parse_month_year(c: Column) -> Column:
    """The first day of the month; two-digit years from 69 on are 19xx."""
    found = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in MONTH_FORMATS]).cast("date")
    short = c.rlike(r"^\D+\d{2}$") & (F.year(found) >= 2069)
    return F.when(short, F.add_months(found, -1200)).otherwise(found)


def from_excel_serial(c: Column) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), c.cast("int"))


def logical_types(df: DataFrame) -> DataFrame:
    """(column_name, storage_type, logical_type): categorical by few values, continuous numbers, strings, datetimes."""
    numbers = numeric_columns(df)
    stats = df.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}__{c}") for c in df.columns for n, f in (("v", F.count), ("u", F.count_distinct))]).head()  # one row
    rows = []
    for c, t in df.dtypes:
        v, u = stats[f"v__{c}"], stats[f"u__{c}"]
        if not v:
            kind = "null"
        elif c in numbers:
            few = u <= 20 or u / v < 0.05
            kind = ("categorical_" if few else "continuous_") + ("integer" if t in INTEGERS else "float")
        elif t.startswith(("timestamp", "date")):
            kind = "datetime"
        elif t == "boolean":
            kind = "boolean"
        else:
            kind = "categorical" if u <= 20 or u / v < 0.1 else "string"
        rows.append((c, t, kind))
    return df.sparkSession.createDataFrame(rows, "column_name string, storage_type string, logical_type string")


def convert(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    """Cast columns by plan: a Spark type name, ``date:<format>``, ``month_year``, ``excel`` or ``pad:<n>``; failures become NULL."""

    def one(c: str, how: str) -> Column:
        if how.startswith("date:"):
            return F.try_to_timestamp(c, F.lit(how[5:]))
        if how.startswith("pad:"):
            return F.lpad(F.col(c).cast("string"), int(how[4:]), "0")
        special = {"month_year": parse_month_year, "excel": from_excel_serial}.get(how)
        return special(F.col(c)) if special else F.col(c).try_cast(how)

    return df.withColumns({c: one(c, how) for c, how in plan.items()}) if plan else df


def coalesce_formats(c: Column, formats: list[str]) -> Column:
    return reduce(lambda a, b: F.coalesce(a, b), [F.try_to_timestamp(c, F.lit(f)) for f in formats])
