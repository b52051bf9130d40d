"""Queries over time-series operators."""

from pyspark.sql import functions as F

from ..operators import stationarity as S
from ..operators import stl as STL
from ..operators import timeseries as T
from .base import query, table
from .stats import rounded

HOURS = "h AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1)"


def hours(spark, d):
    return T.resample(table(spark, d, "events"), "ts", "value", "hour")


@query("resample_hourly", f"WITH {HOURS}, s AS (SELECT unnest(generate_series((SELECT min(ts) FROM h), (SELECT max(ts) FROM h), INTERVAL 1 HOUR)) AS ts) SELECT s.ts, round(value, 6) AS value FROM s LEFT JOIN h USING (ts)")
def resample_hourly(spark, d):
    return rounded(hours(spark, d).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query("trend_summary", f"WITH {HOURS}, r AS (SELECT value, row_number() OVER (ORDER BY ts) AS rn, count(*) OVER () AS n FROM h), x AS (SELECT any_value(n) AS n, max(value) FILTER (rn = 1) AS first, max(value) FILTER (rn = n // 2 + 1) AS middle, max(value) FILTER (rn = n) AS last FROM r) SELECT n, round(first, 6) AS first, round(middle, 6) AS middle, round(last, 6) AS last, round((last - first) * 100 / abs(first), 4) AS pct_change, CASE WHEN last > first THEN 'increasing' WHEN last < first THEN 'decreasing' ELSE 'flat' END AS trend FROM x")
def trend_summary(spark, d):
    out = T.trend(hours(spark, d))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("first", "middle", "last")], F.round("pct_change", 4).alias("pct_change"), "trend")


@query("autocorrelation", f"WITH {HOURS}, x AS (SELECT ts, value - (SELECT avg(value) FROM h) AS x FROM h), l AS (" + " UNION ALL ".join(f"SELECT {k} AS lag, x, lag(x, {k}) OVER (ORDER BY ts) AS y FROM x" for k in range(1, 13)) + ") SELECT lag, round(sum(x * y) / (SELECT sum(x * x) FROM x), 6) AS acf, abs(sum(x * y) / (SELECT sum(x * x) FROM x)) > 2 / sqrt((SELECT count(*) FROM x)) AS significant FROM l GROUP BY lag")
def autocorrelation(spark, d):
    return rounded(T.autocorrelation(hours(spark, d), 12))


@query("decompose_daily", f"""WITH {HOURS}, p AS (SELECT ts, value, row_number() OVER w - 1 AS pos, sum(value) OVER (ORDER BY ts ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING) AS inn, lag(value, 12) OVER w AS a, lead(value, 12) OVER w AS b FROM h WINDOW w AS (ORDER BY ts)),
 t AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (inn + (a + b) / 2) / 24 END AS trend FROM p), m AS (SELECT pos % 24 AS phase, avg(value - trend) AS m FROM t GROUP BY 1), s AS (SELECT phase, m - (SELECT avg(m) FROM m) AS seasonal FROM m)
 SELECT ts, round(value + 1.23456e-7::DOUBLE, 5) AS value, round(trend + 1.23456e-7::DOUBLE, 5) AS trend, round(seasonal + 1.23456e-7::DOUBLE, 5) AS seasonal, round(value - trend - seasonal + 1.23456e-7::DOUBLE, 5) AS residual FROM t JOIN s ON pos % 24 = phase""")
def decompose_daily(spark, d):
    out = T.decompose(hours(spark, d), 24)
    off_ties = F.lit(1.23456e-7)  # both engines round means of cents; a shift keeps exact halves apart
    return out.select(F.col("ts").cast("timestamp_ntz").alias("ts"), *[F.round(F.col(c) + off_ties, 5).alias(c) for c in ("value", "trend", "seasonal", "residual")])


@query("variance_stability", f"WITH {HOURS}, n AS (SELECT value, ntile(2) OVER (ORDER BY ts) AS half FROM h), s AS (SELECT stddev_samp(value) FILTER (half = 1) AS a, stddev_samp(value) FILTER (half = 2) AS b FROM n) SELECT round(a, 6) AS sd_first, round(b, 6) AS sd_second, greatest(a / b, b / a) > 2 AS unstable FROM s")
def variance_stability(spark, d):
    return rounded(T.variance_stability(hours(spark, d)))


@query("forecast_baselines", f"""WITH {HOURS}, r AS (SELECT value AS v, row_number() OVER (ORDER BY ts) AS rn, count(*) OVER () AS n FROM h), k AS (SELECT *, n - floor(n * .2) AS k FROM r), t AS (SELECT avg(v) AS mean, arg_max(v, rn) AS last, arg_min(v, rn) AS first, any_value(k) AS k FROM k WHERE rn <= k),
 g AS (SELECT v, unnest(['naive', 'mean', 'drift']) AS method, unnest([last, mean, last + (last - first) / (t.k - 1) * (rn - t.k)]) AS p FROM k, t WHERE rn > k.k)
 SELECT method, round(avg(abs(v - p)), 5) AS mae, round(sqrt(avg((v - p) ** 2)), 5) AS rmse, round(avg(abs((v - p) / nullif(v, 0))) * 100, 3) AS mape FROM g GROUP BY 1""")
def forecast_baselines(spark, d):
    return T.forecast_baselines(hours(spark, d)).select("method", F.round("mae", 5).alias("mae"), F.round("rmse", 5).alias("rmse"), F.round("mape", 3).alias("mape"))


LAGS = f"""x AS (SELECT value - avg(value) OVER () AS x, row_number() OVER (ORDER BY ts) AS i FROM events),
 k AS (SELECT unnest(range(1, 169)) AS lag), a AS (SELECT lag, sum(p.x * q.x) / (SELECT sum(x * x) FROM x) AS acf, (SELECT count(*) FROM x) AS n FROM k, x p JOIN x q ON q.i = p.i - lag GROUP BY lag)"""


@query("seasonal_periods", f"WITH {LAGS}, m AS (SELECT *, max(acf) OVER (ORDER BY lag ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS peak FROM a) SELECT lag::INT AS lag, round(acf, 6) AS acf FROM m WHERE abs(acf) > 2 / sqrt(n) AND acf > 0 AND acf = peak AND lag > 1")
def seasonal_periods(spark, d):
    return T.candidate_periods(T.autocorrelation(raw(spark, d), 168)).select("lag", F.round("acf", 6).alias("acf"))


@query("partial_autocorrelation", f"WITH {LAGS.replace("169", "3")}, r AS (SELECT max(acf) FILTER (lag = 1) AS r1, max(acf) FILTER (lag = 2) AS r2, max(n) AS n FROM a), p AS (SELECT 1 AS lag, r1 AS pacf, n FROM r UNION ALL SELECT 2, (r2 - r1 * r1) / (1 - r1 * r1), n FROM r) SELECT lag, round(pacf, 6) AS pacf, abs(pacf) > 2 / sqrt(n) AS significant FROM p")
def partial_autocorrelation(spark, d):
    return T.partial_autocorrelation(raw(spark, d), 2).select("lag", F.round("pacf", 6).alias("pacf"), "significant")


@query("suggest_lags")
def suggest_lags(spark, d):
    return T.suggest_lags(raw(spark, d), 168)


def raw(spark, d):
    return table(spark, d, "events").select("ts", "value")


@query("autocorrelation_events", "WITH x AS (SELECT value - avg(value) OVER () AS x, row_number() OVER (ORDER BY ts) AS i FROM events), l AS (" + " UNION ALL ".join(f"SELECT {k} AS lag, x, lag(x, {k}) OVER (ORDER BY i) AS y FROM x" for k in range(1, 9)) + ") SELECT lag, round(sum(x * y) / (SELECT sum(x * x) FROM x), 6) AS acf, abs(sum(x * y) / (SELECT sum(x * x) FROM x)) > 2 / sqrt((SELECT count(*) FROM x)) AS significant FROM l GROUP BY lag")
def autocorrelation_events(spark, d):
    """Of every event in order of time, not of hourly means."""
    return rounded(T.autocorrelation(raw(spark, d), 8))


@query("trend_events", "WITH r AS (SELECT value, row_number() OVER (ORDER BY ts) AS rn, count(*) OVER () AS n FROM events), x AS (SELECT any_value(n) AS n, max(value) FILTER (rn = 1) AS first, max(value) FILTER (rn = n // 2 + 1) AS middle, max(value) FILTER (rn = n) AS last FROM r) SELECT n, first, middle, last, round((last - first) * 100 / abs(first), 4) AS pct_change, CASE WHEN last > first THEN 'increasing' WHEN last < first THEN 'decreasing' ELSE 'flat' END AS trend FROM x")
def trend_events(spark, d):
    return T.trend(raw(spark, d)).withColumn("pct_change", F.round("pct_change", 4))


@query("interpolate_events", """WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 7 = 0 OR event_id < 3 THEN NULL ELSE value END AS v, row_number() OVER (ORDER BY ts) AS rn FROM events),
 k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER (ORDER BY rn) AS a, first_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM e)
 SELECT k.event_id, round(CASE WHEN k.v IS NOT NULL THEN k.v WHEN k.a IS NULL THEN NULL WHEN k.b IS NULL THEN x.v ELSE x.v + (y.v - x.v) * (k.rn - k.a) / (k.b - k.a) END, 6) AS value FROM k LEFT JOIN e x ON x.rn = k.a LEFT JOIN e y ON y.rn = k.b""")
def interpolate_events(spark, d):
    """A value in seven is missing, and the first ones; all events in one order."""
    from ..operators.quality import impute

    e = table(spark, d, "events").withColumn("value", F.expr("CASE WHEN event_id % 7 = 0 OR event_id < 3 THEN NULL ELSE value END"))
    return impute(e, ["value"], "interpolate", order_by=["ts"]).select("event_id", F.round("value", 6).alias("value"))


@query("stl_hourly")
def stl_hourly(spark, d):
    """Hourly means with a daily period, robust."""
    return STL.stl(hours(spark, d), 24, robust=True, outer=3).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stl_strengths")
def stl_strengths(spark, d):
    return STL.strengths(STL.stl(hours(spark, d), 24))


@query("stl_two_periods")
def stl_two_periods(spark, d):
    """Daily and weekly seasons of hourly means at once."""
    return STL.multiple_stl(hours(spark, d), [24, 168]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("dickey_fuller", """WITH e AS (SELECT value - lag(value) OVER (ORDER BY ts) AS d, lag(value) OVER (ORDER BY ts) AS l FROM events),
 f AS (SELECT regr_slope(d, l) AS b, regr_sxx(d, l) AS sxx, regr_syy(d, l) AS syy, regr_count(d, l)::BIGINT AS n FROM e), t AS (SELECT b / sqrt((syy - b * b * sxx) / (n - 2) / sxx) AS t, n FROM f)
 SELECT round(t, 5) AS statistic, n, 0 AS lag, t < -2.86154 - 2.8903 / n - 4.234 / n ** 2 - 40.04 / n ** 3 AS below_5 FROM t""")
def dickey_fuller(spark, d):
    """Of all events in order of time, without lagged changes."""
    out = S.adf(raw(spark, d), 0, choose=False)
    return out.select(F.round("statistic", 5).alias("statistic"), "n", "lag", (F.col("statistic") < F.col("critical_5")).alias("below_5"))


@query("kpss", """WITH x AS (SELECT value - avg(value) OVER () AS x, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM events), s AS (SELECT x, n, sum(x) OVER (ORDER BY i) AS s, lag(x, 1) OVER (ORDER BY i) AS x1, lag(x, 2) OVER (ORDER BY i) AS x2, lag(x, 3) OVER (ORDER BY i) AS x3 FROM x)
 SELECT round(sum(s * s) / any_value(n) ** 2 / ((sum(x * x) + 2 * (0.75 * sum(x * x1) + 0.5 * sum(x * x2) + 0.25 * sum(x * x3))) / any_value(n)), 5) AS statistic, 3 AS lags, any_value(n) AS n FROM s""")
def kpss(spark, d):
    return S.kpss(raw(spark, d), 3).select(F.round("statistic", 5).alias("statistic"), "lags", "n")


@query("stationarity")
def stationarity(spark, d):
    """Both tests on all events, with the numbers of lags that the data ask for."""
    return S.stationarity(raw(spark, d))
