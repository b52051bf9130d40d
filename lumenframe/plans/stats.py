"""Queries over exploratory statistics."""

from pyspark.sql import functions as F

from ..operators.rank import kendall
from ..operators import stats as S
from .base import query, table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _num(c):
    qs = ", ".join(f"round(quantile_cont({c}, {q})::DOUBLE, 4) AS p{round(q * 100):02d}" for q in S.PERCENTILES)
    return f"SELECT '{c}' AS column_name, count({c}) AS n, count(*) - count({c}) AS n_missing, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, count(*) FILTER ({c} = 0) AS n_zero, count(*) FILTER ({c} < 0) AS n_negative, {qs} FROM lineitem"


@query("numeric_summary", " UNION ALL ".join(map(_num, NUM)))
def numeric_summary(spark, d):
    return rounded(S.numeric_summary(table(spark, d, "lineitem"), NUM), 4)


@query("histogram", """WITH s AS (SELECT min(l_quantity)::DOUBLE AS lo, max(l_quantity)::DOUBLE AS hi, least(50, ceil(log2(count(*))) + 1) AS k FROM lineitem)
 SELECT least(k - 1, floor((l_quantity - lo) / ((hi - lo) / k)))::INT AS bin, count(*) AS n FROM lineitem, s GROUP BY 1""")
def histogram(spark, d):
    return S.histogram(table(spark, d, "lineitem"), "l_quantity").select("bin", "n")


@query("datetime_summary", "SELECT count(*) AS n, min(o_orderdate) AS min, max(o_orderdate) AS max, floor((epoch(max(o_orderdate)) - epoch(min(o_orderdate))) / 86400)::BIGINT AS range_days, count(DISTINCT year(o_orderdate)) AS n_years, count(DISTINCT month(o_orderdate)) AS n_months FROM orders")
def datetime_summary(spark, d):
    return S.datetime_summary(table(spark, d, "orders"), "o_orderdate")


@query("datetime_parts", "SELECT 'year' AS part, year(o_orderdate)::INT AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'month', month(o_orderdate)::INT, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'weekday', (isodow(o_orderdate) - 1)::INT, count(*) FROM orders GROUP BY 2")
def datetime_parts(spark, d):
    return S.datetime_parts(table(spark, d, "orders"), "o_orderdate")


PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1 :]]


@query("correlation_pearson", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in PAIRS))
def correlation_pearson(spark, d):
    return rounded(S.pearson(table(spark, d, "lineitem"), NUM))


RANKS = "r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in NUM[:3]) + " FROM lineitem)"


@query("correlation_spearman", f"WITH {RANKS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM r" for a, b in PAIRS if "l_tax" not in (a, b)))
def correlation_spearman(spark, d):
    return rounded(S.spearman(table(spark, d, "lineitem"), NUM[:3]))


@query("correlation_network", "WITH e AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in PAIRS) + ") SELECT node, count(*) AS degree, round(count(*) / 3.0, 6)::DOUBLE AS centrality FROM (SELECT unnest([a, b]) AS node FROM e WHERE abs(r) >= 0.5) GROUP BY node")
def correlation_network(spark, d):
    return rounded(S.correlation_network(table(spark, d, "lineitem"), NUM))


@query("assoc_num_num", "SELECT regr_count(l_extendedprice, l_quantity)::BIGINT AS n, round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def assoc_num_num(spark, d):
    out = S.numeric_association(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select("n", F.round("pearson", 6).alias("pearson"), F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"))


ANOVA = "g AS (SELECT {c} AS c, count(*) AS n, avg({v}) AS m, var_pop({v}) * count(*) AS ss FROM {t} GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(ss) AS w, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS b FROM g)"


@query("assoc_cat_num", "WITH " + ANOVA.format(c="o_orderpriority", v="o_totalprice", t="orders") + " SELECT k, n::BIGINT AS n, round((b / (k - 1)) / (w / (n - k)), 4) AS f_statistic, round(b / (b + w), 6) AS eta_squared FROM t")
def assoc_cat_num(spark, d):
    out = S.anova(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    return out.select("k", "n", F.round("f_statistic", 4).alias("f_statistic"), F.round("eta_squared", 6).alias("eta_squared"))


@query("bivariate", "WITH " + ANOVA.format(c="o_orderstatus", v="o_totalprice", t="orders") + " SELECT 'o_orderstatus' AS feature, 'eta_squared' AS measure, round(b / (b + w), 6) AS value FROM t UNION ALL SELECT 'o_custkey', 'pearson', round(corr(o_custkey, o_totalprice), 6) FROM orders")
def bivariate(spark, d):
    return S.bivariate(table(spark, d, "orders"), ["o_orderstatus", "o_custkey"], "o_totalprice").select("feature", "measure", F.round("value", 6).alias("value"))


@query("assoc_num_cat", "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 3) AS mean, round(stddev_samp(l_extendedprice), 3) AS std FROM lineitem GROUP BY 1")
def assoc_num_cat(spark, d):
    return rounded(S.group_stats(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice"), 3)


@query("crosstab", "WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL) SELECT a, b, n, round(n * 100.0 / sum(n) OVER (PARTITION BY a), 3)::DOUBLE AS row_pct, round(n * 100.0 / sum(n) OVER (PARTITION BY b), 3)::DOUBLE AS col_pct FROM c")
def crosstab(spark, d):
    return S.crosstab(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


CHI = """WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {t} GROUP BY ALL), ra AS (SELECT a, sum(n)::DOUBLE AS na FROM c GROUP BY a), cb AS (SELECT b, sum(n)::DOUBLE AS nb FROM c GROUP BY b),
 t AS (SELECT sum(n)::DOUBLE AS n, (SELECT count(*) FROM ra)::DOUBLE AS r, (SELECT count(*) FROM cb)::DOUBLE AS k FROM c),
 x AS (SELECT abs(coalesce(c.n, 0) - na * nb / t.n) AS o, na * nb / t.n AS e, t.n, r, k FROM ra, cb LEFT JOIN c ON c.a = ra.a AND c.b = cb.b, t),
 y AS (SELECT sum((o - CASE WHEN r = 2 AND k = 2 THEN least(.5, o) ELSE 0 END) ** 2 / e) AS chi2, any_value(n) AS n, any_value(r) AS r, any_value(k) AS k FROM x)
 SELECT round(chi2, 5) AS chi2, ((r - 1) * (k - 1))::BIGINT AS dof, n::BIGINT AS n, round(sqrt(greatest(0, chi2 / n - (r - 1) * (k - 1) / (n - 1)) / (least(r - (r - 1) ** 2 / (n - 1), k - (k - 1) ** 2 / (n - 1)) - 1)), 6) AS cramers_v FROM y"""

for _n, _t, _a, _b in (("assoc_cat_cat", "lineitem", "l_returnflag", "l_linestatus"), ("assoc_cat_cat_2x2", "labels", "quality", "toxic")):

    @query(_n, CHI.format(a=_a, b=_b, t=_t))
    def assoc_cat_cat(spark, d, t=_t, a=_a, b=_b):
        out = S.chi_square(table(spark, d, t), a, b)
        return out.select(F.round("chi2", 5).alias("chi2"), "dof", "n", F.round("cramers_v", 6).alias("cramers_v"))


@query("pca_variance")
def pca_variance(spark, d):
    return S.pca(table(spark, d, "lineitem"), NUM, 3)


@query("feature_importance_forest")
def feature_importance_forest(spark, d):
    return S.feature_importance(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", trees=5)


@query("pca_scores")
def pca_scores(spark, d):
    return S.pca_scores(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"])[0]


@query("correlation_kendall", """WITH p AS (SELECT p_partkey AS i, p_size AS x, p_retailprice AS y, length(p_name) AS z FROM part), s AS (SELECT sign(a.x - b.x) AS x, sign(a.y - b.y) AS y, sign(a.z - b.z) AS z FROM p a JOIN p b ON a.i < b.i),
 t AS (SELECT unnest(['p_size', 'p_size', 'p_retailprice']) AS a, unnest(['p_retailprice', 'name_length', 'name_length']) AS b, unnest([sum(x * y) / sqrt(sum(abs(x))) / sqrt(sum(abs(y))), sum(x * z) / sqrt(sum(abs(x))) / sqrt(sum(abs(z))), sum(y * z) / sqrt(sum(abs(y))) / sqrt(sum(abs(z)))]) AS tau FROM s)
 SELECT a, b, (SELECT count(*) FROM p) AS n, round(tau, 6) AS tau FROM t""")
def correlation_kendall(spark, d):
    p = table(spark, d, "part").withColumn("name_length", F.length("p_name"))
    return kendall(p, ["p_size", "p_retailprice", "name_length"]).select("a", "b", "n", F.round("tau", 6).alias("tau"))
