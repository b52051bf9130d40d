"""Queries over drift operators: the first half of events against the second."""

from pyspark.sql import functions as F

from ..operators import drift as D
from .base import query, table


def halves(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    first = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return e.where(first), e.where(~first)


SIDES = "e AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS s, * FROM events)"
CDF = f"""WITH {SIDES}, g AS (SELECT value, sum(1 - s) AS r, sum(s) AS c FROM e GROUP BY value),
 f AS (SELECT value, sum(r) OVER w / (SELECT sum(r) FROM g) AS fr, sum(c) OVER w / (SELECT sum(c) FROM g) AS fc, lead(value) OVER w - value AS width FROM g WINDOW w AS (ORDER BY value))"""


@query("drift_numeric_ks", CDF + " SELECT 'value' AS feature, round(max(abs(fr - fc)), 6) AS ks FROM f")
def drift_numeric_ks(spark, d):
    return D.numeric_distances(*halves(spark, d), ["value"]).select("feature", F.round("ks", 6).alias("ks"))


@query("drift_wasserstein", CDF + " SELECT 'value' AS feature, round(sum(abs(fr - fc) * width), 5) AS wasserstein FROM f")
def drift_wasserstein(spark, d):
    return D.numeric_distances(*halves(spark, d), ["value"]).select("feature", F.round("wasserstein", 5).alias("wasserstein"))


@query("drift_anderson", f"""WITH {SIDES}, g AS (SELECT value, sum(1 - s)::DOUBLE AS r, sum(s)::DOUBLE AS c FROM e GROUP BY value), t AS (SELECT sum(r) AS n, sum(c) AS m, sum(r + c) AS k FROM g),
 f AS (SELECT r, c, sum(r) OVER w AS ur, sum(c) OVER w AS uc, n, m, k FROM g, t WINDOW w AS (ORDER BY value)), b AS (SELECT *, ur + uc - (r + c) / 2 AS b FROM f)
 SELECT 'value' AS feature, any_value(n)::BIGINT AS n_ref, any_value(m)::BIGINT AS n_cur, round(any_value((k - 1) / k) * sum((r + c) / k * ((k * (ur - r / 2) - b * n) ** 2 / n + (k * (uc - c / 2) - b * m) ** 2 / m) / (b * (k - b) - k * (r + c) / 4)), 6) AS a2 FROM b""")
def drift_anderson(spark, d):
    return D.anderson_darling(*halves(spark, d), ["value"]).select("feature", "n_ref", "n_cur", F.round("a2", 6).alias("a2"))


@query("drift_psi_numeric", f"""WITH {SIDES}, b AS (SELECT min(value) AS lo, max(value) AS hi FROM e WHERE s = 0),
 k AS (SELECT s, CASE WHEN value = hi THEN 9 WHEN value BETWEEN lo AND hi THEN floor((value - lo) / ((hi - lo) / 10))::INT END AS bin FROM e, b),
 n AS (SELECT bin, count(*) FILTER (s = 0) AS r, count(*) FILTER (s = 1) AS c FROM k GROUP BY bin), t AS (SELECT sum(r) AS nr, sum(c) AS nc FROM n),
 p AS (SELECT coalesce(r, 0) / (nr + 1e-6::DOUBLE) + 1e-6::DOUBLE AS pr, coalesce(c, 0) / (nc + 1e-6::DOUBLE) + 1e-6::DOUBLE AS pc FROM range(10) g(i) LEFT JOIN n ON bin = i, t)
 SELECT 'value' AS feature, round(sum((pc - pr) * ln(pc / pr)), 6) AS psi FROM p""")
def drift_psi_numeric(spark, d):
    return D.psi_numeric(*halves(spark, d), "value").select("feature", F.round("psi", 6).alias("psi"))


@query("drift_categorical", f"""WITH {SIDES}, g AS (SELECT event_type AS v, sum(1 - s)::DOUBLE AS r, sum(s)::DOUBLE AS c FROM e GROUP BY 1), t AS (SELECT sum(r) AS nr, sum(c) AS nc, sum(greatest(r, 1)) AS nr1, sum(greatest(c, 1)) AS nc1, count(*) AS k FROM g),
 x AS (SELECT k, greatest(r, 1) AS r1, greatest(c, 1) AS c1, (greatest(r, 1) + greatest(c, 1)) * nr1 / (nr1 + nc1) AS er, (greatest(r, 1) + greatest(c, 1)) * nc1 / (nr1 + nc1) AS ec, r / nr AS p, c / nc AS q FROM g, t),
 j AS (SELECT *, (p + 1e-10::DOUBLE) / (1 + k * 1e-10::DOUBLE) AS jp, (q + 1e-10::DOUBLE) / (1 + k * 1e-10::DOUBLE) AS jq FROM x)
 SELECT 'event_type' AS feature, max(k) AS n_categories, round(sum((r1 - er) ** 2 / er + (c1 - ec) ** 2 / ec), 5) AS chi2, max(k) - 1 AS dof,
 round(sum((q - p) * ln((q + 1e-6::DOUBLE) / (p + 1e-6::DOUBLE))), 6) AS psi, round(sum(jp * ln(jp / ((jp + jq) / 2)) + jq * ln(jq / ((jp + jq) / 2))) / 2, 6) AS js FROM j""")
def drift_categorical(spark, d):
    out = D.categorical_drift(*halves(spark, d), "event_type")
    return out.select("feature", "n_categories", F.round("chi2", 5).alias("chi2"), "dof", F.round("psi", 6).alias("psi"), F.round("js", 6).alias("js"))


@query("drift_datetime", f"WITH {SIDES} SELECT 'ts' AS feature, 1.0::DOUBLE AS ks, round((avg(epoch(ts)) FILTER (s = 1) - avg(epoch(ts)) FILTER (s = 0)) / 86400, 5) AS mean_shift_days, true AS drift FROM e")
def drift_datetime(spark, d):
    out = D.datetime_drift(*halves(spark, d), "ts")
    return out.select("feature", F.round("ks", 6).alias("ks"), F.round("mean_shift_days", 5).alias("mean_shift_days"), "drift")


@query("drift_all", CDF + f""", k AS (SELECT max(abs(fr - fc)) AS ks FROM f), m AS (SELECT ks, ks * sqrt((SELECT sum(r) FROM g)::DOUBLE * (SELECT sum(c) FROM g) / (SELECT sum(r) + sum(c) FROM g)) AS x FROM k),
 v AS (SELECT ks, CASE WHEN x < .2 THEN 1 ELSE least(1, greatest(0, (SELECT sum(CASE WHEN i % 2 = 1 THEN 2 ELSE -2 END * exp(-2 * (i * x) ** 2)) FROM range(1, 101) t(i)))) END AS p FROM m),
 t AS (SELECT event_type, sum(1 - s) / (SELECT sum(1 - s) FROM e) AS p, sum(s) / (SELECT sum(s) FROM e) AS q FROM e GROUP BY 1), c AS (SELECT sum((q - p) * ln((q + 1e-6::DOUBLE) / (p + 1e-6::DOUBLE))) AS psi FROM t)
 SELECT 'value' AS feature, 'numeric' AS kind, round(ks, 6)::DOUBLE AS statistic, p < .05 AS drift FROM v UNION ALL SELECT 'event_type', 'categorical', round(psi, 6)::DOUBLE, psi >= .2 FROM c
 UNION ALL SELECT 'ts', 'datetime', 1, true UNION ALL SELECT 'event_id', 'categorical', NULL, false""")
def drift_all(spark, d):
    return D.detect_all_drift(*halves(spark, d), ["value"], ["event_type", "event_id"], datetimes=["ts"]).withColumns({"statistic": F.round("statistic", 6), "drift": F.coalesce("drift", F.lit(False))})
