"""Null-safe column helpers; all are built-in expressions that stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType, TimestampNTZType, TimestampType


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (TimestampType, TimestampNTZType)) or f.dataType.typeName() == "date"]


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN where the type has it."""
    c = F.col(name)
    return (c.isNull() | F.isnan(c)) if isinstance(df.schema[name].dataType, (FloatType, DoubleType)) else c.isNull()


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, NULL when b is 0 or NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def epoch_seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def long_form(df: DataFrame, keys: list[str], columns: list[str], name: str = "column_name", value: str = "value") -> DataFrame:
    """(keys, column_name, value): one row per column; values are cast to their common type by the caller."""
    return df.unpivot(keys, columns, name, value)


#: The rows of one group are dealt to so many tasks.
SALTS = 64


def with_group_extremes(df: DataFrame, keys: list[str], spread: Column, extremes: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with the least ("min"), greatest ("max") or total ("sum") value of each row's group; ``keys`` hold no NULL (a struct may).

    Rows of a group meet in parts dealt by a hash of ``spread``, and only the parts' extremes meet in one task, so a group
    may hold any share of the table.
    """
    pick = {"min": F.min, "max": F.max, "sum": F.sum}
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    parts = dealt.groupBy(*keys, "_salt").agg(*[pick[how](c).alias(n) for n, (how, c) in extremes.items()])
    whole = parts.groupBy(*keys).agg(*[pick[how](n).alias(n) for n, (how, _) in extremes.items()])
    return dealt.join(parts.select(*keys, "_salt").join(whole, keys), [*keys, "_salt"]).drop("_salt")


def pairs_within(df: DataFrame, id_col: str, keys: list[str], block: int = 1_000) -> DataFrame:
    """(a, b), a < b: pairs of ids that share a group, once each. A group larger than a block becomes pairs of blocks."""
    rows = df.select(F.col(id_col).alias("_id"), *keys)
    blocks = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("_k"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    own = rows.join(blocks, keys).withColumn("_own", F.pmod(F.xxhash64("_id"), F.col("_k").cast("long")).cast("int"))
    cells = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    cells = cells.select("_id", "_own", *keys, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    left = cells.where("_own = _i").select(*keys, "_i", "_j", F.col("_id").alias("_x"))
    right = cells.where("_own = _j").select(*keys, "_i", "_j", F.col("_id").alias("_y"))
    met = left.join(right, [*keys, "_i", "_j"]).where("_i < _j AND _x <> _y OR _x < _y")
    return met.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).distinct()


def running_totals(df: DataFrame, keys: list[str], value: str, sums: list[str], ranges: int = 256) -> DataFrame:
    """``df`` with, for every c of ``sums``, run_c (its total up to this number, inclusive) and all_c, and next_value.

    ``df`` has one row per key and number. A key's numbers are cut into ranges at approximate quantiles; rows are only put in
    order within a range, and the totals before it come from a table of at most ``ranges`` + 1 rows per key.
    """
    bounds = df.groupBy(*keys).agg(F.percentile_approx(value, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10_000).alias("_bounds"))
    held = df.join(F.broadcast(bounds), keys or F.lit(True))
    held = held.withColumn("_range", F.lit(0))
    for step in (1 << i for i in reversed(range((ranges - 1).bit_length()))):  # bounds below the number, by halving: NULL lies beyond them
        beyond = F.get("_bounds", F.col("_range") + (step - 1)) < F.col(value)
        held = held.withColumn("_range", F.col("_range") + F.when(beyond, step).otherwise(0))
    held = held.drop("_bounds")
    parts = held.groupBy(*keys, "_range").agg(*[F.sum(c).alias(c) for c in sums], F.min(value).alias("_least"))
    in_order, all_parts = W.partitionBy(*keys).orderBy("_range"), W.partitionBy(*keys)
    parts = parts.select(
        *keys,
        "_range",
        *[(F.sum(c).over(in_order) - F.col(c)).alias(f"_before_{c}") for c in sums],
        *[F.sum(c).over(all_parts).alias(f"all_{c}") for c in sums],
        F.lead("_least").over(in_order).alias("_after"),
    )
    inside = W.partitionBy(*keys, "_range").orderBy(value)
    out = held.join(F.broadcast(parts), [*keys, "_range"])
    runs = [(F.col(f"_before_{c}") + F.sum(c).over(inside)).alias(f"run_{c}") for c in sums]
    return out.select(*df.columns, *runs, *[f"all_{c}" for c in sums], F.coalesce(F.lead(value).over(inside), "_after").alias("next_value"))
