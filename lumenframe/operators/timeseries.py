"""Time series: resampling, trend, autocorrelation, seasonality, forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio
from .ordered import Ordered, by_pos, ordered


def resample(df: DataFrame, ts: str, value: str, freq: str = "day", how=F.avg) -> DataFrame:
    """(ts, value): buckets of a date_trunc unit; buckets without rows have NULL."""
    grouped = df.where(F.col(ts).isNotNull()).groupBy(F.date_trunc(freq, F.col(ts)).alias("ts")).agg(how(value).alias("value"))
    ends = grouped.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    spine = ends.select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL 1 {freq}"))).alias("ts"))
    return spine.join(grouped, "ts", "left")


def in_order(series: DataFrame) -> Ordered:
    """The (ts, v) rows of a (ts, value) series with a value, numbered by ts."""
    return ordered(series.where("value IS NOT NULL").select("ts", F.col("value").cast("double").alias("v")), ["ts"])


def trend(series: DataFrame) -> DataFrame:
    """One row of a (ts, value) series: n, first, middle, last, percentage change and its direction."""
    o = in_order(series)
    at = lambda k: F.max(F.when(F.col("pos") == k, F.col("v")))
    out = o.rows.agg(F.lit(o.n).cast("long").alias("n"), at(0).alias("first"), at(o.n // 2).alias("middle"), at(o.n - 1).alias("last"))
    change = ratio((F.col("last") - F.col("first")) * 100, F.abs("first"))
    return out.withColumn("pct_change", change).withColumn("trend", F.when(change > 0, "increasing").when(change < 0, "decreasing").otherwise("flat"))


def _autocorrelation(o: Ordered, lags: int) -> DataFrame:
    mean = o.rows.agg(F.avg("v").alias("m"))
    x = F.col("v") - F.col("m")
    wide = o.blocks(lags).join(F.broadcast(mean), F.lit(True)).withColumn("x", x).select("x", "_own", *[F.lag("x", k).over(by_pos()).alias(f"l{k}") for k in range(1, lags + 1)])
    one = wide.where("_own").agg(F.sum(F.col("x") * F.col("x")).alias("d"), *[F.sum(F.col("x") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, lags + 1)])
    rows = [F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"s{k}"), F.col("d")).alias("acf")) for k in range(1, lags + 1)]
    out = one.select(F.explode(F.array(*rows)).alias("r"))
    return out.where("r.acf IS NOT NULL").select("r.lag", "r.acf", (F.abs("r.acf") > 2 / F.sqrt(F.lit(float(o.n)))).alias("significant"))


def autocorrelation(series: DataFrame, lags: int = 20) -> DataFrame:
    """(lag, acf, significant): the biased estimate around the global mean; significant beyond 2 / sqrt(n)."""
    return _autocorrelation(in_order(series), lags)


def candidate_periods(acf: DataFrame) -> DataFrame:
    """Lags whose autocorrelation is significant, positive and the highest of its neighbourhood."""
    near = acf.select(F.explode(F.array(*[F.col("lag") + k for k in range(-2, 3)])).alias("lag"), F.col("acf").alias("other"))
    peaks = near.groupBy("lag").agg(F.max("other").alias("peak"))
    return acf.join(peaks, "lag").where("significant AND acf > 0 AND acf = peak AND lag > 1").select("lag", "acf")


def partial_autocorrelation(series: DataFrame, lags: int = 20) -> DataFrame:
    """(lag, pacf, significant) by the Durbin-Levinson recursion over the autocorrelations (one row per lag)."""
    o = in_order(series)
    r, n = [row["acf"] for row in _autocorrelation(o, lags).orderBy("lag").collect()], o.n
    phi: list[float] = []
    out = []
    for k in range(len(r)):
        rest = 1 - sum(p * x for p, x in zip(phi, r, strict=False))
        last = (r[k] - sum(p * x for p, x in zip(phi, reversed(r[:k]), strict=True))) / rest if rest else 0.0
        phi = [p - last * q for p, q in zip(phi, reversed(phi), strict=True)] + [last]
        out.append((k + 1, float(last), bool(abs(last) > 2 / n**0.5)))
    return series.sparkSession.createDataFrame(out, "lag int, pacf double, significant boolean")


def suggest_lags(series: DataFrame, lags: int = 20, top: int = 5, partial: bool = True) -> DataFrame:
    """(lag, strength): the significant lags with the strongest (partial) autocorrelation."""
    found = partial_autocorrelation(series, lags).withColumnRenamed("pacf", "r") if partial else autocorrelation(series, lags).withColumnRenamed("acf", "r")
    return found.where("significant").select("lag", F.abs("r").alias("strength")).orderBy(F.desc("strength"), "lag").limit(top)


def suggest_windows(series: DataFrame, lags: int = 40, defaults: tuple = (3, 7, 14)) -> list[int]:
    """Rolling windows: the candidate periods and their halves, or defaults that fit the series."""
    periods = [r["lag"] for r in candidate_periods(autocorrelation(series, lags)).orderBy(F.desc("acf"), "lag").limit(3).collect()]
    n = series.where("value IS NOT NULL").count()
    return sorted({w for p in periods for w in (p, p // 2) if w > 1} or {w for w in defaults if 2 * w < n})


def decompose(series: DataFrame, period: int, multiplicative: bool = False) -> DataFrame:
    """(ts, value, trend, seasonal, residual): centred moving average and normalised means by position."""
    o, half = in_order(series), period // 2
    s, w = o.blocks(half, half).withColumnRenamed("v", "value"), by_pos()
    full = F.count("value").over(w.rowsBetween(-half, half)) == 2 * half + 1
    if period % 2:
        mean = F.avg("value").over(w.rowsBetween(-half, half))
    else:  # two moving averages of the period, half weight at the ends
        inner = F.sum("value").over(w.rowsBetween(-half + 1, half - 1))
        mean = (inner + (F.lag("value", half).over(w) + F.lead("value", half).over(w)) / 2) / period
    s = s.withColumn("trend", F.when(full, mean)).where("_own")
    off = ratio(F.col("value"), F.col("trend")) if multiplicative else F.col("value") - F.col("trend")
    means = s.withColumn("off", off).groupBy((F.col("pos") % period).alias("phase")).agg(F.avg("off").alias("m"))
    centre = means.agg(F.avg("m").alias("c"))
    means = means.join(F.broadcast(centre), F.lit(True)).select("phase", (ratio(F.col("m"), F.col("c")) if multiplicative else F.col("m") - F.col("c")).alias("seasonal"))
    out = s.withColumn("phase", F.col("pos") % period).join(F.broadcast(means), "phase")
    rest = ratio(F.col("value"), F.col("trend") * F.col("seasonal")) if multiplicative else F.col("value") - F.col("trend") - F.col("seasonal")
    return out.select("ts", "value", "trend", "seasonal", rest.alias("residual"))


def variance_stability(series: DataFrame) -> DataFrame:
    """One row: standard deviations of both halves and whether one is more than twice the other."""
    o = in_order(series)
    sd = lambda k: F.stddev_samp(F.when(F.col("half") == k, F.col("v")))
    out = o.rows.withColumn("half", o.ntile(2)).agg(sd(1).alias("sd_first"), sd(2).alias("sd_second"))
    r = F.greatest(ratio(F.col("sd_first"), F.col("sd_second")), ratio(F.col("sd_second"), F.col("sd_first")))
    return out.withColumn("unstable", r > 2)


def forecast_baselines(series: DataFrame, test_size: float = 0.2) -> DataFrame:
    """(method, mae, rmse, mape) of naive, mean and drift forecasts on the last part of a series."""
    o = in_order(series)
    s = o.rows.select("ts", "v", (F.col("pos") + 1).alias("rn"), F.lit(o.n).alias("n"))
    cut = F.col("n") - F.floor(F.col("n") * test_size)
    train = s.where(F.col("rn") <= cut).agg(F.max(cut).alias("k"), F.avg("v").alias("mean"), F.max_by("v", "rn").alias("last"), F.min_by("v", "rn").alias("first"))
    test = s.where(F.col("rn") > cut).join(F.broadcast(train), F.lit(True))
    slope = ratio(F.col("last") - F.col("first"), F.col("k") - 1)
    guess = F.explode(F.array(F.struct(F.lit("naive").alias("method"), F.col("last").alias("p")), F.struct(F.lit("mean").alias("method"), F.col("mean").alias("p")), F.struct(F.lit("drift").alias("method"), (F.col("last") + slope * (F.col("rn") - F.col("k"))).alias("p"))))
    e = test.select("v", guess.alias("g")).select("v", "g.method", (F.col("v") - F.col("g.p")).alias("e"))
    return e.groupBy("method").agg(F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs(F.try_divide(F.col("e"), F.nullif(F.col("v"), F.lit(0.0)))) * 100).alias("mape"))
