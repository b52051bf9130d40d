"""Feature engineering and encoders; recipes are immutable and names say what a column holds."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.expr import ratio

EPS = 1e-10


def polynomial(df: DataFrame, columns: list[str], degree: int = 2, interaction_only: bool = False, prefix: str = "poly") -> DataFrame:
    """Products of up to ``degree`` columns, named ``poly_a^2`` and ``poly_a*b``; originals stay."""
    new = {}
    for k in range(2, degree + 1):
        for group in (combinations if interaction_only else combinations_with_replacement)(columns, k):
            powers = {c: group.count(c) for c in dict.fromkeys(group)}
            name = "*".join(c if n == 1 else f"{c}^{n}" for c, n in powers.items())
            product = F.lit(1.0)
            for c in group:
                product = product * F.col(c)
            new[f"{prefix}_{name}"] = product
    return df.withColumns(new)


def interactions(df: DataFrame, pairs: list[tuple[str, str]], operations: list[str], prefix: str = "int") -> DataFrame:
    """multiply, add, subtract, divide (a / b) and ratio (both ways) of column pairs; denominators get a small constant."""
    new = {}
    for a, b in pairs:
        x, y = F.col(a), F.col(b)
        known = {"multiply": {f"{a}_x_{b}": x * y}, "add": {f"{a}_plus_{b}": x + y}, "subtract": {f"{a}_minus_{b}": x - y}, "divide": {f"{a}_div_{b}": ratio(x, y + EPS)}, "ratio": {f"{a}_div_{b}": ratio(x, y + EPS), f"{b}_div_{a}": ratio(y, x + EPS)}}
        for op in operations:
            new.update({f"{prefix}_{n}": c for n, c in known[op].items()})
    return df.withColumns(new)


def datetime_features(df: DataFrame, column: str, features: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Calendar parts and sine / cosine pairs of a timestamp; Monday is 0."""
    c, p = F.col(column), prefix or column
    wave = lambda x, n: {"sin": F.sin(2 * math.pi * x / n), "cos": F.cos(2 * math.pi * x / n)}
    month_end = F.last_day(c) == c.cast("date")
    known = {
        "year": F.year(c), "quarter": F.quarter(c), "month": F.month(c), "day": F.dayofmonth(c), "weekday": F.weekday(c), "dayofyear": F.dayofyear(c),
        "week": F.weekofyear(c), "hour": F.hour(c), "minute": F.minute(c), "second": F.second(c), "days_in_month": F.dayofmonth(F.last_day(c)),
        "is_weekend": (F.weekday(c) >= 5).cast("int"), "is_month_start": (F.dayofmonth(c) == 1).cast("int"), "is_month_end": month_end.cast("int"),
        "is_quarter_start": ((F.dayofmonth(c) == 1) & (F.month(c) % 3 == 1)).cast("int"), "is_quarter_end": (month_end & (F.month(c) % 3 == 0)).cast("int"),
        "is_year_start": (F.dayofyear(c) == 1).cast("int"), "is_year_end": ((F.month(c) == 12) & (F.dayofmonth(c) == 31)).cast("int"),
        **{f"month_{k}": v for k, v in wave(F.month(c), 12).items()}, **{f"weekday_{k}": v for k, v in wave(F.weekday(c), 7).items()},
        **{f"hour_{k}": v for k, v in wave(F.hour(c), 24).items()}, **{f"day_{k}": v for k, v in wave(F.dayofmonth(c), 31).items()},
    }
    return df.withColumns({f"{p}_{k}": known[k] for k in features or known})


def binned(df: DataFrame, column: str, n_bins: int = 5, strategy: str = "uniform") -> DataFrame:
    """``df`` with <column>_bin, codes from 0: right-closed equal-width bins, bins at exact quantiles without repeated edges, or k-means cells."""
    if strategy == "uniform":
        s = df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
        width = (F.col("_hi") - F.col("_lo")) / n_bins
        code = F.greatest(F.lit(0), F.ceil(F.try_divide(F.col(column) - F.col("_lo"), width)) - 1)
        return df.join(F.broadcast(s), F.lit(True)).withColumn(f"{column}_bin", F.when(F.col(column).isNotNull(), F.least(F.lit(n_bins - 1), F.coalesce(code, F.lit(0)))).cast("int")).drop("_lo", "_hi")
    if strategy == "kmeans":
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import VectorAssembler

        x = VectorAssembler(inputCols=[column], outputCol="_v").transform(df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias(column)))
        centres = sorted(float(c[0]) for c in KMeans(k=n_bins, seed=42, featuresCol="_v").fit(x).clusterCenters())
        edges = [(lo + hi) / 2 for lo, hi in zip(centres, centres[1:], strict=False)]
        code = sum((F.when(F.col(column) > e, 1).otherwise(0) for e in edges), F.lit(0))
        return df.withColumn(f"{column}_bin", F.when(F.col(column).isNotNull(), code))
    if strategy != "quantile":
        raise ValueError(f"unknown strategy {strategy!r}")
    edges = sorted({x for x in exact_quantiles(df, {column: F.col(column)}, [i / n_bins for i in range(n_bins + 1)])[column] if x is not None})
    code = sum((F.when(F.col(column) > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return df.withColumn(f"{column}_bin", F.when(F.col(column).isNotNull(), code))


def lagged(df: DataFrame, columns: list[str], lags: list[int], order_by: list[str], partition_by: list[str] | None = None) -> DataFrame:
    w = W.partitionBy(*(partition_by or [])).orderBy(*order_by)
    return df.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in lags if k > 0})


ROLLING: dict[str, Callable[[str], Column]] = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def rolling(df: DataFrame, columns: list[str], windows: list[int], metrics: list[str], order_by: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """Trailing windows that include the current row and accept shorter starts."""
    w = W.partitionBy(*(partition_by or [])).orderBy(*order_by)
    return df.withColumns({f"{c}_rolling_{m}_{n}": ROLLING[m](c).over(w.rowsBetween(1 - n, 0)) for c in columns for n in windows for m in metrics})


def differences(df: DataFrame, columns: list[str], periods: list[int], order_by: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """diff_p and pct_change_p; a change from 0 is NULL."""
    w = W.partitionBy(*(partition_by or [])).orderBy(*order_by)
    new = {}
    for c in columns:
        for p in periods:
            before = F.lag(c, p).over(w)
            new[f"{c}_diff_{p}"] = F.col(c) - before
            new[f"{c}_pct_change_{p}"] = ratio(F.col(c), before) - 1
    return df.withColumns(new)


def lag_plan(strategy: str, most: int) -> list[int]:
    """Lags up to ``most``: all, fibonacci (1, 2, 3, 5, ...) or exponential (1, 2, 4, ...)."""
    if strategy == "all":
        return list(range(1, most + 1))
    a, b = (1, 2)
    out = []
    while a <= most:
        out.append(a)
        a, b = (b, a + b) if strategy == "fibonacci" else (a * 2, b)
    return out


@dataclass(frozen=True)
class Recipe:
    """An ordered list of table-to-table steps; adding a step gives a new recipe."""

    steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()

    def add(self, step: Callable[[DataFrame], DataFrame]) -> Recipe:
        return Recipe((*self.steps, step))

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.transform(step)
        return df


# encoders: fit returns a small mapping table, apply joins it


def categories(df: DataFrame, column: str, max_categories: int = 10_000) -> list[str]:
    """Sorted categories; an error beyond ``max_categories``, where columns per category make no sense."""
    found = [r[0] for r in df.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).distinct().orderBy(column).limit(max_categories + 1).collect()]
    if len(found) > max_categories:
        raise ValueError(f"{column} has more than {max_categories} categories")
    return found


def one_hot(df: DataFrame, column: str, values: list[str], drop_first: bool = True) -> DataFrame:
    """<column>_<value> columns at the end; unknown values have 0 everywhere."""
    new = {f"{column}_{v}": F.coalesce((F.col(column).cast("string") == v).cast("int"), F.lit(0)) for v in values[drop_first:]}
    return df.withColumns(new).drop(column)


def ordinal_mapping(df: DataFrame, column: str) -> DataFrame:
    """(column, code): codes by sorted value, through one window over distinct values."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().withColumn("code", (F.row_number().over(W.orderBy(column)) - 1).cast("int"))


def encode(df: DataFrame, column: str, mapping: DataFrame, value: str, default) -> DataFrame:
    """``df`` with <column>_encoded from a mapping (column, value); unknown and NULL get ``default``."""
    m = mapping.select(F.col(column).alias("_k"), F.col(value).alias("_v"))
    return df.join(m, F.col(column) == F.col("_k"), "left").withColumn(f"{column}_encoded", F.coalesce("_v", F.lit(default))).drop("_k", "_v")


def target_mapping(df: DataFrame, column: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """(column, mean): (n * mean + s * global) / (n + s)."""
    whole = df.agg(F.avg(target).alias("_g"))
    g = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(target).alias("_n"), F.sum(target).alias("_s"))
    return g.join(F.broadcast(whole), F.lit(True)).select(column, ((F.col("_s") + smoothing * F.col("_g")) / (F.col("_n") + smoothing)).alias("mean"))


def target_out_of_fold(df: DataFrame, column: str, target: str, fold: Column, smoothing: float = 10.0) -> DataFrame:
    """``df`` with <column>_encoded from all other folds: totals less the fold's own, in one shuffle by the column."""
    whole = df.agg(F.avg(target).alias("_g"))
    cells = df.groupBy(F.col(column).alias("_c"), fold.alias("_f")).agg(F.count(target).alias("_n"), F.sum(target).alias("_s"))
    w = W.partitionBy("_c")
    rest = cells.select("_c", "_f", (F.sum("_n").over(w) - F.col("_n")).alias("_n"), (F.sum("_s").over(w) - F.col("_s")).alias("_s"))
    out = df.withColumn("_fold", fold).join(rest, F.col(column).eqNullSafe(F.col("_c")) & (F.col("_fold") == F.col("_f"))).join(F.broadcast(whole), F.lit(True))
    return out.withColumn(f"{column}_encoded", (F.col("_s") + smoothing * F.col("_g")) / (F.col("_n") + smoothing)).drop("_c", "_f", "_n", "_s", "_g", "_fold")


def binary_bits(df: DataFrame, column: str, mapping: DataFrame, bits: int) -> DataFrame:
    """<column>_0 ... from the bits of code + 1, the highest first; unknown values are 0."""
    out = encode(df, column, mapping, "code", -1)
    code = F.col(f"{column}_encoded") + 1
    return out.withColumns({f"{column}_{i}": F.shiftright(code, bits - 1 - i).bitwiseAND(F.lit(1)) for i in range(bits)}).drop(f"{column}_encoded")


def hashed(df: DataFrame, columns: list[str], n_components: int = 8) -> DataFrame:
    """col_0 ... col_{n-1}: how many of the columns' values fall in each md5 bucket."""
    at = {c: F.conv(F.substring(F.md5(F.coalesce(F.col(c).cast("string"), F.lit(""))), 25, 8), 16, 10).cast("long") % n_components for c in columns}
    return df.withColumns({f"col_{i}": sum((F.when(b == i, 1).otherwise(0) for b in at.values()), F.lit(0)) for i in range(n_components)})


def woe_mapping(df: DataFrame, column: str, target: str, regularization: float = 0.5) -> DataFrame:
    """(column, woe): ln of the share of events over the share of non-events, with ``regularization`` added to counts."""
    r = regularization
    g = df.groupBy(column).agg(F.sum(target).alias("_e"), F.sum(1 - F.col(target)).alias("_o"))
    t = g.agg(F.sum("_e").alias("_te"), F.sum("_o").alias("_to"))
    return g.join(F.broadcast(t), F.lit(True)).select(column, F.log(((F.col("_e") + r) / (F.col("_te") + 2 * r)) / ((F.col("_o") + r) / (F.col("_to") + 2 * r))).alias("woe"))
