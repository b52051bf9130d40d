"""Unit-root and stationarity tests of an ordered series, from sums that blocks with halo rows add up.

The augmented Dickey-Fuller regression needs only the products of the lagged
columns: each block gives one Gram matrix, their sum has the answer for every
number of lags at once. The KPSS test needs lagged products of the deviations
and their running sums. The driver solves systems of a few dozen unknowns.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered
from .timeseries import in_order

#: Published approximations for one series with a constant (fixed values): polynomials of the normal quantile of p on either
#: side of a statistic, the range beyond which p is 0 or 1, and critical values by powers of 1 / n.
ADF_TURN, ADF_RANGE = -1.61, (-18.83, 2.74)
ADF_BELOW = (2.1659, 1.4412, 0.038269)
ADF_ABOVE = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_CRITICAL = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040), "10%": (-2.56677, -1.5384, -2.809, 0.0)}
#: Critical values of the level-stationary KPSS statistic (fixed values): probability -> statistic.
KPSS_CRITICAL = {0.10: 0.347, 0.05: 0.463, 0.025: 0.574, 0.01: 0.739}


def adf_p_value(statistic: float) -> float:
    """The approximate p-value of a Dickey-Fuller statistic with a constant."""
    if statistic > ADF_RANGE[1]:
        return 1.0
    if statistic < ADF_RANGE[0]:
        return 0.0
    side = ADF_BELOW if statistic <= ADF_TURN else ADF_ABOVE
    return NormalDist().cdf(sum(c * statistic**k for k, c in enumerate(side)))


def kpss_p_value(statistic: float) -> float:
    """The p-value between the tabulated ones by straight lines, held at 0.1 and 0.01."""
    return float(np.interp(statistic, list(KPSS_CRITICAL.values()), list(KPSS_CRITICAL)))


def _block_sums(o: Ordered, before: int, fn, size: int) -> np.ndarray:
    """The sum over all blocks of ``fn(values with their halo, how many are halo, first number)``, ``size`` numbers each."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        own = table.column("_own").to_numpy(zero_copy_only=False)
        halo = int((~own).sum())
        return pa.table({"at": np.arange(size), "x": fn(table.column("v").to_numpy(), halo, int(table.column("pos")[0].as_py()))})

    parts = o.blocks(before).select("_block", "_own", "pos", "v").groupBy("_block").applyInArrow(run, "at long, x double")
    out = np.zeros(size)
    for r in parts.groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out


def _gram(o: Ordered, lags: int, mean: float) -> np.ndarray:
    """Products of (1, last value, last ``lags`` changes, change) over all rows that have them."""
    width = lags + 3

    def products(v: np.ndarray, halo: int, first: int) -> np.ndarray:
        rows = np.arange(max(halo, lags + 1 - first, 0), len(v))
        rows = rows[first + rows >= lags + 1]
        d = np.diff(v - mean, prepend=0.0)
        z = np.stack([np.ones(len(rows)), v[rows - 1] - mean, *[d[rows - k] for k in range(1, lags + 1)], d[rows]]) if len(rows) else np.zeros((width, 0))
        return (z @ z.T).ravel()

    return _block_sums(o, lags + 1, products, width * width).reshape(width, width)


def _fit(gram: np.ndarray, used: int) -> tuple[float, float]:
    """(squared residuals, t statistic of the last value) with the constant, the last value and ``used`` changes."""
    k = used + 2
    a, b = gram[:k, :k], gram[:k, -1]
    beta = np.linalg.solve(a, b)
    rest = max(gram[-1, -1] - beta @ b, 0.0)
    n = gram[0, 0]
    error = math.sqrt(rest / (n - k) * np.linalg.inv(a)[1, 1])
    return rest, beta[1] / error if error else -math.inf


def adf(series: DataFrame, max_lag: int | None = None, choose: bool = True) -> DataFrame:
    """One row: statistic, p_value, lag, n, critical values and the verdict of the augmented Dickey-Fuller test with a constant.

    The number of lagged changes is the one with the least Akaike criterion up to ``max_lag`` (by default
    12 (n / 100)^(1/4)), or ``max_lag`` itself. A series of fewer than eight values or without change gives NULL.
    """
    o = in_order(series)
    spark, n = series.sparkSession, o.n
    names = "statistic double, p_value double, lag int, n long, critical_1 double, critical_5 double, critical_10 double, stationary boolean"
    mean, least, most = o.rows.agg(F.avg("v"), F.min("v"), F.max("v")).head() if n else (0.0, 0.0, 0.0)
    if n < 8 or least == most:
        return spark.createDataFrame([(None, None, None, n, None, None, None, None)], names)
    top = max_lag if max_lag is not None else math.ceil(12 * (n / 100) ** 0.25)
    top = used = max(0, min(top, n // 2 - 2))
    if choose:
        gram = _gram(o, top, mean)
        rows = gram[0, 0]
        used = min(range(top + 1), key=lambda k: (rows * math.log(max(_fit(gram, k)[0], 1e-300) / rows) + 2 * (k + 2), k))
    gram = _gram(o, used, mean)
    rows, (_, statistic) = int(gram[0, 0]), _fit(gram, used)
    critical = [sum(c / rows**k for k, c in enumerate(row)) for row in ADF_CRITICAL.values()]
    p = adf_p_value(statistic)
    return spark.createDataFrame([(float(statistic), p, used, rows, *critical, p < 0.05)], names)


def kpss(series: DataFrame, lags: int | None = None) -> DataFrame:
    """One row: statistic, p_value, lags, n and the verdict of the KPSS test of a level.

    The long-run variance takes ``lags`` with falling weights; by default as many as the data ask for (Hobijn, Franses and Ooms).
    """
    o = in_order(series)
    spark, n = series.sparkSession, o.n
    names = "statistic double, p_value double, lags int, n long, stationary boolean"
    mean, spread = o.rows.agg(F.avg("v"), F.var_pop("v")).head() if n else (0.0, 0.0)
    if n < 8 or not spread:
        return spark.createDataFrame([(None, None, None, n, None)], names)

    def lagged(top: int) -> np.ndarray:
        """Sums of products of deviations 0 .. top rows apart."""

        def products(v: np.ndarray, halo: int, first: int) -> np.ndarray:
            x = v - mean
            size = 1 << (2 * len(x)).bit_length()
            own = np.concatenate([np.zeros(halo), x[halo:]])
            both = np.fft.irfft(np.fft.rfft(own, size) * np.conj(np.fft.rfft(x, size)), size)[: top + 1]
            return np.concatenate([both, np.zeros(max(0, top + 1 - len(both)))])

        return _block_sums(o, top, products, top + 1)

    if lags is None:
        first = int(n ** (2 / 9))
        products = lagged(first)
        s0 = products[0] / n + 2 * products[1:].sum() / n
        s1 = 2 * (np.arange(1, first + 1) * products[1:]).sum() / n
        lags = int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)) if s0 else 0
    lags = min(lags, n - 1)
    products = lagged(lags)
    long_run = (products[0] + 2 * ((1 - np.arange(1, lags + 1) / (lags + 1)) * products[1:]).sum()) / n
    run = Ordered(o.rows.withColumn("x", F.col("v") - F.lit(mean)), n, o.starts).running("x")
    statistic = run.agg(F.sum(F.col("run_x") * F.col("run_x"))).head()[0] / n**2 / long_run
    p = kpss_p_value(statistic)
    return spark.createDataFrame([(float(statistic), p, lags, n, p >= 0.05)], names)


def stationarity(series: DataFrame) -> DataFrame:
    """One row: both statistics and p-values, and what they say together about the series."""
    a = adf(series).select(F.col("statistic").alias("adf"), F.col("p_value").alias("adf_p"), F.col("lag").alias("adf_lag"), F.col("stationary").alias("_a"))
    k = kpss(series).select(F.col("statistic").alias("kpss"), F.col("p_value").alias("kpss_p"), F.col("lags").alias("kpss_lags"), F.col("stationary").alias("_k"))
    says = F.when(F.col("_a") & F.col("_k"), "stationary").when(F.col("_a"), "trend stationary").when(F.col("_k"), "difference stationary").when(F.col("_a").isNotNull(), "non-stationary")
    return a.join(k, F.lit(True)).select("adf", "adf_p", "adf_lag", "kpss", "kpss_p", "kpss_lags", says.alias("status"))  # one row each
