"""Drift between a reference and a current table."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import datetime_columns, epoch_seconds, numeric_columns, running_totals, string_columns


def _sides(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(side, feature, value): both tables unpivoted, missing values left out."""
    one = lambda df, side: df.select(*[F.col(c).cast("double") for c in columns]).unpivot([], columns, "feature", "value").withColumn("side", F.lit(side))
    return one(reference, 0).unionAll(one(current, 1)).where("value IS NOT NULL AND NOT isnan(value)")


def numeric_distances(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n_ref, n_cur, ks, wasserstein): from cumulative counts over distinct values.

    Counts are combined before the shuffle, and windows hold the distinct values of a range.
    """
    steps = _sides(reference, current, columns).groupBy("feature", "value").agg(F.sum(1 - F.col("side")).alias("r"), F.sum("side").alias("c"))
    steps = running_totals(steps, ["feature"], "value", ["r", "c"])
    cdf = steps.select(
        "feature",
        (F.col("run_r") / F.col("all_r")).alias("fr"),
        (F.col("run_c") / F.col("all_c")).alias("fc"),
        (F.col("next_value") - F.col("value")).alias("width"),
        "r", "c",
    )
    gap = F.abs(F.col("fr") - F.col("fc"))
    return cdf.groupBy("feature").agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"), F.max(gap).alias("ks"), F.coalesce(F.sum(gap * F.col("width")), F.lit(0.0)).alias("wasserstein"))


def ks_p_value(ks: float, n: int, m: int) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    x = ks * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))))


def detect_numeric_drift(reference: DataFrame, current: DataFrame, columns: list[str], threshold: float = 0.05, method: str = "ks") -> DataFrame:
    """numeric_distances with means, p-value and verdict; ks by p-value, wasserstein by a tenth of the larger range."""
    dist = numeric_distances(reference, current, columns)
    side = _sides(reference, current, columns).groupBy("feature").agg(
        *[f(F.when(F.col("side") == s, F.col("value"))).alias(f"{n}_{name}") for s, name in ((0, "ref"), (1, "cur")) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    )
    out = dist.join(side, "feature")
    x = F.col("ks") * F.sqrt(F.col("n_ref") * F.col("n_cur") / (F.col("n_ref") + F.col("n_cur")))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * F.pow(k * x, F.lit(2))))
    out = out.withColumn("p_value", F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series))))
    reach = F.greatest(F.col("max_ref") - F.col("min_ref"), F.col("max_cur") - F.col("min_cur"))
    return out.withColumn("drift", F.col("p_value") < threshold if method == "ks" else F.col("wasserstein") > 0.1 * reach)


#: Coefficients of the critical values by level (fixed values).
AD_LEVELS = (0.25, 0.1, 0.05, 0.025, 0.01, 0.005, 0.001)
AD_B0 = (0.675, 1.281, 1.645, 1.96, 2.326, 2.573, 3.085)
AD_B1 = (-0.245, 0.25, 0.678, 1.149, 1.822, 2.364, 3.615)
AD_B2 = (-0.105, -0.305, -0.362, -0.391, -0.396, -0.345, -0.154)


def _ad_harmonics(n: int) -> tuple[float, float]:
    """Sums over 1 / i and 1 / ((n - i) j) that the variance takes; beyond a million rows their limits, right to five digits."""
    if n > 1_000_000:
        return math.log(n - 1) + 0.5772156649015329 + 1 / (2 * (n - 1)), math.pi**2 / 6
    tail = np.cumsum(1 / np.arange(n - 1, 1, -1, dtype=float))
    return float(tail[-1] + 1), float((tail / np.arange(2, n)).sum())


def anderson_p_value(a2: float, n: int, m: int) -> tuple[float, float]:
    """(standardised statistic, p-value held between 0.001 and 0.25) of two samples of n and m rows."""
    total = n + m
    if n < 1 or m < 1 or total < 4:
        return math.nan, math.nan
    k, inverse = 2, 1 / n + 1 / m
    h, g = _ad_harmonics(total)
    a = (4 * g - 6) * (k - 1) + (10 - 6 * g) * inverse
    b = (2 * g - 4) * k**2 + 8 * h * k + (2 * g - 14 * h - 4) * inverse - 8 * h + 4 * g - 6
    c = (6 * h + 2 * g - 2) * k**2 + (4 * h - 4 * g + 6) * k + (2 * h - 6) * inverse + 4 * h
    d = (2 * h + 6) * k**2 - 4 * h * k
    variance = (a * total**3 + b * total**2 + c * total + d) / ((total - 1.0) * (total - 2.0) * (total - 3.0))
    statistic = (a2 - (k - 1)) / math.sqrt(variance)
    critical = np.array(AD_B0) + np.array(AD_B1) + np.array(AD_B2)
    if not critical[0] < statistic < critical[-1]:
        return statistic, AD_LEVELS[0] if statistic <= critical[0] else AD_LEVELS[-1]
    return statistic, float(np.exp(np.polyval(np.polyfit(critical, np.log(AD_LEVELS), 2), statistic)))


def anderson_darling(reference: DataFrame, current: DataFrame, columns: list[str], threshold: float = 0.05) -> DataFrame:
    """(feature, n_ref, n_cur, a2, statistic, p_value, drift): the two-sample test with midranks, from cumulative counts of distinct values.

    One row per feature comes to the driver for its p-value; features without values on both sides have NULL.
    """
    steps = _sides(reference, current, columns).groupBy("feature", "value").agg(F.sum(1 - F.col("side")).alias("r"), F.sum("side").alias("c"))
    x = running_totals(steps, ["feature"], "value", ["r", "c"])
    n, here = (F.col("all_r") + F.col("all_c")).cast("double"), F.col("r") + F.col("c")
    upto = F.col("run_r") + F.col("run_c") - here / 2
    part = lambda s: here / n * F.pow(n * (F.col(f"run_{s}") - F.col(s) / 2) - upto * F.col(f"all_{s}"), F.lit(2.0)) / F.nullif(upto * (n - upto) - n * here / 4, F.lit(0.0)) / F.nullif(F.col(f"all_{s}"), F.lit(0))
    sums = x.groupBy("feature").agg(F.max("all_r").alias("n_ref"), F.max("all_c").alias("n_cur"), (F.sum(part("r") + part("c")) * F.max((n - 1) / n)).alias("a2"))
    out = []
    for r in sums.collect():
        stat, p = anderson_p_value(r["a2"], r["n_ref"], r["n_cur"]) if r["a2"] is not None else (math.nan, math.nan)
        known = not math.isnan(p)
        out.append((r["feature"], r["n_ref"], r["n_cur"], r["a2"], stat if known else None, p if known else None, p < threshold if known else None))
    return reference.sparkSession.createDataFrame(out, "feature string, n_ref long, n_cur long, a2 double, statistic double, p_value double, drift boolean")


def psi_numeric(reference: DataFrame, current: DataFrame, column: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """One row (feature, psi): equal-width bins over the reference's range; current values outside it stay in the denominator."""
    lo_hi = reference.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    both = _sides(reference, current, [column]).join(F.broadcast(lo_hi), F.lit(True))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("value") == F.col("hi"), bins - 1).otherwise(F.floor(F.try_divide(F.col("value") - F.col("lo"), width)))
    inside = F.col("value").between(F.col("lo"), F.col("hi"))
    counts = both.groupBy(F.when(inside, at).cast("int").alias("bin")).agg(F.sum(1 - F.col("side")).alias("r"), F.sum("side").alias("c"))
    totals = counts.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    grid = reference.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").na.fill(0, ["r", "c"])
    share = lambda n, d: n / (d + eps) + eps
    p = grid.join(F.broadcast(totals), F.lit(True)).select(share(F.col("c"), F.col("nc")).alias("pc"), share(F.col("r"), F.col("nr")).alias("pr"))
    return p.agg(F.sum((F.col("pc") - F.col("pr")) * F.log(F.col("pc") / F.col("pr"))).alias("psi")).select(F.lit(column).alias("feature"), "psi")


def categorical_drift(reference: DataFrame, current: DataFrame, column: str, max_categories: int = 20) -> DataFrame:
    """One row (feature, n_categories, chi2, dof, psi, js, reason); with too many categories the statistics are NULL and ``reason`` says so.

    Counts of 0 become 1 for chi-square; 2 x 2 tables use Yates' correction.
    """
    tally = reference.select(F.col(column).cast("string").alias("v"), F.lit(0).alias("s")).unionAll(current.select(F.col(column).cast("string").alias("v"), F.lit(1).alias("s")))
    counts = tally.where("v IS NOT NULL").groupBy("v").agg(F.sum(1 - F.col("s")).alias("r"), F.sum("s").alias("c"))
    counts = counts.withColumns({"r1": F.greatest("r", F.lit(1)).cast("double"), "c1": F.greatest("c", F.lit(1)).cast("double")})
    sums = counts.agg(F.count("*").alias("k"), *[F.sum(x).alias(f"s_{x}") for x in ("r", "c", "r1", "c1")])
    x = counts.join(F.broadcast(sums), F.lit(True))
    n = F.col("s_r1") + F.col("s_c1")
    expect = lambda s: (F.col("r1") + F.col("c1")) * F.col(s) / n
    off = lambda o, e: F.abs(F.col(o) - e) - F.when(F.col("k") == 2, F.least(F.lit(0.5), F.abs(F.col(o) - e))).otherwise(0.0)
    chi = F.sum(F.pow(off("r1", expect("s_r1")), 2) / expect("s_r1") + F.pow(off("c1", expect("s_c1")), 2) / expect("s_c1"))
    pr, pc = F.col("r") / F.col("s_r") + 1e-6, F.col("c") / F.col("s_c") + 1e-6
    psi = F.sum((pc - pr) * F.log(pc / pr))
    jr = (F.col("r") / F.col("s_r") + 1e-10) / (1 + F.col("k") * 1e-10)
    jc = (F.col("c") / F.col("s_c") + 1e-10) / (1 + F.col("k") * 1e-10)
    mid = (jr + jc) / 2
    js = F.sum(jr * F.log(jr / mid) + jc * F.log(jc / mid)) / 2
    out = x.agg(F.max("k").alias("n_categories"), chi.alias("chi2"), psi.alias("psi"), js.alias("js"))
    few = F.col("n_categories") <= max_categories
    held = {"chi2": F.col("chi2"), "dof": F.col("n_categories") - 1, "psi": F.col("psi"), "js": F.col("js")}
    reason = F.when(few, F.lit(None).cast("string")).otherwise(F.lit(f"over {max_categories} categories"))
    return out.select(F.lit(column).alias("feature"), "n_categories", *[F.when(few, v).alias(n) for n, v in held.items()], reason.alias("reason"))


def datetime_drift(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """One row: KS on epoch seconds and the shift of the mean in days."""
    r, c = (df.select(epoch_seconds(F.col(column)).alias(column)) for df in (reference, current))
    return detect_numeric_drift(r, c, [column]).select("feature", "ks", "p_value", ((F.col("mean_cur") - F.col("mean_ref")) / 86400).alias("mean_shift_days"), "drift")


def detect_all_drift(
    reference: DataFrame,
    current: DataFrame,
    numeric: list[str] | None = None,
    categorical: list[str] | None = None,
    threshold: float = 0.05,
    datetimes: list[str] | None = None,
) -> DataFrame:
    """(feature, kind, statistic, drift) of all features: numbers and datetimes by KS, categories by PSI of 0.2 or more.

    Without any list the columns of both tables are dealt by their type. A categorical feature with too many categories has
    NULL in both.
    """
    if numeric is None and categorical is None and datetimes is None:
        both = set(current.columns)
        numeric, categorical, datetimes = ([c for c in f(reference) if c in both] for f in (numeric_columns, string_columns, datetime_columns))
    numeric, categorical = numeric or [], categorical or []
    parts = [detect_numeric_drift(reference, current, numeric, threshold).select("feature", F.lit("numeric").alias("kind"), F.col("ks").alias("statistic"), "drift")] if numeric else []
    parts += [categorical_drift(reference, current, c).select("feature", F.lit("categorical").alias("kind"), F.col("psi").alias("statistic"), (F.col("psi") >= 0.2).alias("drift")) for c in categorical]
    parts += [datetime_drift(reference, current, c).select("feature", F.lit("datetime").alias("kind"), F.col("ks").alias("statistic"), "drift") for c in datetimes or []]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
