"""Queries over data-quality operators."""

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import types as Y
from .base import query, table


def lines(spark, d):
    df = table(spark, d, "lineitem")
    gap = F.nullif(F.col("l_linenumber") % 7, F.lit(0))
    return df.select("l_orderkey", "l_linenumber", F.when(gap.isNotNull() & (F.col("l_orderkey") % 5 != 0), F.col("l_quantity")).alias("l_quantity"), F.when(F.col("l_partkey") % 4 != 0, F.col("l_returnflag")).alias("l_returnflag"))


LINES = """lines AS (SELECT l_orderkey, l_linenumber, CASE WHEN nullif(l_linenumber % 7, 0) IS NOT NULL AND l_orderkey % 5 <> 0 THEN l_quantity END AS l_quantity,
 CASE WHEN l_partkey % 4 <> 0 THEN l_returnflag END AS l_returnflag FROM lineitem)"""
EVENTS = "e AS (SELECT event_id, event_type, ts, CASE WHEN event_id % 10 <> 0 THEN value END AS value, CASE WHEN event_id % 9 <> 0 THEN event_type END AS kind FROM events)"


def events(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", "ts", F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("kind"))


def _missing(c):
    return f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_missing, round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 6)::DOUBLE AS pct_missing FROM lines"


@query("missing_profile", f"WITH {LINES} " + " UNION ALL ".join(map(_missing, ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"])))
def missing_profile(spark, d):
    return Q.missing_profile(lines(spark, d))


@query("type_counts", "SELECT * FROM (VALUES ('datetime', 1::BIGINT), ('numeric', 3::BIGINT), ('string', 2::BIGINT)) t(kind, n)")
def type_counts(spark, d):
    return Q.column_kinds(table(spark, d, "orders")).groupBy("kind").agg(F.count("*").alias("n"))


@query("castable_mix", "SELECT CASE WHEN event_id % 3 = 0 THEN 'long' WHEN event_id % 3 = 1 THEN 'double' ELSE 'string' END AS kind, count(*) AS n FROM events GROUP BY 1")
def castable_mix(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, F.concat(F.col("event_id").cast("string"), F.lit(".5"))).otherwise(F.col("event_type"))
    return Q.castable_mix(e.select(text.alias("v")), "v")


DUPES = """WITH g AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
SELECT sum(n)::BIGINT AS n_rows, sum({f})::BIGINT AS n_duplicates, count(*) AS n_unique, round(sum({f}) * 100.0 / sum(n), 6)::DOUBLE AS pct_duplicates FROM g"""


@query("duplicates_first", DUPES.format(f="n - 1"))
def duplicates_first(spark, d):
    return Q.detect_duplicates(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"])


@query("duplicates_none", DUPES.format(f="CASE WHEN n > 1 THEN n ELSE 0 END"))
def duplicates_none(spark, d):
    return Q.detect_duplicates(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], keep=None)


@query("duplicate_value_counts", "SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_value_counts(spark, d):
    return Q.duplicate_value_counts(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"])


for _keep, _sql in (("first", "row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1"), ("last", "row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) = 1"), (None, "count(*) OVER (PARTITION BY o_custkey, o_orderstatus) = 1")):

    @query(f"remove_duplicates_{_keep or 'all'}", f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders QUALIFY {_sql}")
    def remove_duplicates(spark, d, keep=_keep):
        df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        return Q.remove_duplicates(df, ["o_custkey", "o_orderstatus"], ["o_orderkey"], keep)


@query("flag_exact_duplicates", "SELECT o_orderkey, o_orderkey <> min(o_orderkey) OVER w AS is_duplicate, min(o_orderkey) OVER w AS group_id FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority)")
def flag_exact_duplicates(spark, d):
    return Q.flag_duplicates(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderkey"]).select("o_orderkey", "is_duplicate", "group_id")


def _card(c):
    r = f"count(DISTINCT {c}) * 1.0 / count({c})"
    return f"""SELECT '{c}' AS column_name, count({c}) AS n_values, count(DISTINCT {c}) AS n_unique, round({r}, 6)::DOUBLE AS unique_ratio,
 CASE WHEN {r} < .01 THEN 'very_low' WHEN {r} < .05 THEN 'low' WHEN {r} < .2 THEN 'medium' WHEN {r} < .5 THEN 'high' WHEN {r} < 1 THEN 'very_high' ELSE 'unique' END AS cardinality FROM customer"""


@query("cardinality_classes", " UNION ALL ".join(map(_card, ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])))
def cardinality_classes(spark, d):
    df = table(spark, d, "customer")
    return Q.cardinality(df, df.columns)


@query("top_values_with_other", f"""WITH {EVENTS}, c AS (SELECT coalesce(kind, 'Missing') AS value, count(*) AS n FROM e GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, value LIMIT 3),
 u AS (SELECT * FROM t UNION ALL SELECT 'Other', (SELECT sum(n) FROM c) - (SELECT sum(n) FROM t))
 SELECT value, n::BIGINT AS n, round(n * 100.0 / (SELECT sum(n) FROM c), 6)::DOUBLE AS pct FROM u""")
def top_values_with_other(spark, d):
    return Q.top_values(events(spark, d), "kind", 3)


for _s, _sql in (("mean", "avg(value)"), ("median", "quantile_cont(value, .5)")):

    @query(f"impute_{_s}", f"WITH {EVENTS} SELECT event_id, round(coalesce(value, (SELECT {_sql} FROM e)), 6) AS value FROM e")
    def impute_number(spark, d, how=_s):
        return Q.impute(events(spark, d), ["value"], how).select("event_id", F.round("value", 6).alias("value"))


@query("impute_mode", f"WITH {EVENTS} SELECT event_id, coalesce(kind, (SELECT kind FROM e WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)) AS kind FROM e")
def impute_mode(spark, d):
    return Q.impute(events(spark, d), ["kind"], "mode").select("event_id", "kind")


@query("impute_constant", f"WITH {EVENTS} SELECT event_id, coalesce(kind, 'MISSING') AS kind FROM e")
def impute_constant(spark, d):
    return Q.impute(events(spark, d), ["kind"], "constant", "MISSING").select("event_id", "kind")


@query("impute_drop", f"WITH {EVENTS} SELECT event_id, kind, value FROM e WHERE kind IS NOT NULL AND value IS NOT NULL")
def impute_drop(spark, d):
    return Q.impute(events(spark, d), ["kind", "value"], "drop").select("event_id", "kind", "value")


@query("impute_interpolate", f"""WITH {EVENTS}, r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM e),
 x AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS va, last_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS ra,
  first_value(value IGNORE NULLS) OVER f AS vb, first_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS rb FROM r
  WINDOW b AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT event_id, round(CASE WHEN value IS NOT NULL THEN value WHEN va IS NULL THEN NULL WHEN vb IS NULL THEN va ELSE va + (vb - va) * (rn - ra) / (rb - ra) END, 6) AS value FROM x""")
def impute_interpolate(spark, d):
    return Q.impute(events(spark, d), ["value"], "interpolate", order_by=["event_id"], partition_by=["event_type"]).select("event_id", F.round("value", 6).alias("value"))


OUT = {
    "iqr": "SELECT quantile_cont(l_extendedprice, .25) - 1.5 * (quantile_cont(l_extendedprice, .75) - quantile_cont(l_extendedprice, .25)) AS lo, quantile_cont(l_extendedprice, .75) + 1.5 * (quantile_cont(l_extendedprice, .75) - quantile_cont(l_extendedprice, .25)) AS hi FROM lineitem",
    "zscore": "SELECT avg(l_extendedprice) - 1.5 * stddev_samp(l_extendedprice) AS lo, avg(l_extendedprice) + 1.5 * stddev_samp(l_extendedprice) AS hi FROM lineitem",
    "modified_zscore": "SELECT m - 1.5 * d / .6745 AS lo, m + 1.5 * d / .6745 AS hi FROM (SELECT any_value(m) AS m, quantile_cont(abs(l_extendedprice - m), .5) AS d FROM lineitem, (SELECT quantile_cont(l_extendedprice, .5) AS m FROM lineitem))",
}
for _m, _sql in OUT.items():

    @query(f"outliers_{_m}", f"WITH b AS ({_sql}) SELECT l_orderkey, l_linenumber, l_extendedprice < lo OR l_extendedprice > hi AS outlier_l_extendedprice FROM lineitem, b")
    def outliers(spark, d, method=_m):
        out = Q.detect_outliers(table(spark, d, "lineitem"), ["l_extendedprice"], method)
        return out.select("l_orderkey", "l_linenumber", "outlier_l_extendedprice")


@query("drop_outliers_iqr", f"WITH b AS ({OUT['iqr']}) SELECT count(*) AS n_kept FROM lineitem, b WHERE NOT (l_extendedprice < lo OR l_extendedprice > hi)")
def drop_outliers_iqr(spark, d):
    return Q.drop_outliers(table(spark, d, "lineitem"), ["l_extendedprice"]).agg(F.count("*").alias("n_kept"))


# types


def _int_fit(c):
    return f"SELECT '{c}' AS column_name, CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS best_type FROM lineitem"


@query("optimize_dtypes", " UNION ALL ".join(map(_int_fit, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])) + "".join(f" UNION ALL SELECT '{c}', CASE WHEN bool_and({c}::FLOAT::DOUBLE = {c}) THEN 'float' ELSE 'double' END FROM lineitem" for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def optimize_dtypes(spark, d):
    return Y.best_types(table(spark, d, "lineitem")).where("best_type NOT IN ('string', 'timestamp_ntz')").select("column_name", "best_type")


STRINGS = """s AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%d/%m/%Y') AS eu, o_orderpriority AS other,
 'u' || o_custkey || '@mail.example.com' AS mail, '10.0.' || (o_custkey % 256) || '.' || (o_orderkey % 256) AS ip, strftime(o_orderdate, '%b-%y') AS my FROM orders)"""


def strings(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("eu"), F.col("o_orderpriority").alias("other"), F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit("@mail.example.com")).alias("mail"), F.concat(F.lit("10.0."), (F.col("o_custkey") % 256).cast("string"), F.lit("."), (F.col("o_orderkey") % 256).cast("string")).alias("ip"), F.date_format("o_orderdate", "MMM-yy").alias("my"))


@query("detect_datetime_columns", f"WITH {STRINGS} SELECT 'eu' AS column_name, 'dd/MM/yyyy' AS format, 1.0::DOUBLE AS parsed UNION ALL SELECT 'iso', 'yyyy-MM-dd', 1.0::DOUBLE")
def detect_datetime_columns(spark, d):
    return Y.detect_datetimes(strings(spark, d), ["iso", "eu", "other"])


@query("semantic_types", f"WITH {STRINGS} SELECT 'mail' AS column_name, 'email' AS semantic_type, 1.0::DOUBLE AS matched UNION ALL SELECT 'ip', 'ip_address', 1.0::DOUBLE")
def semantic_types(spark, d):
    return Y.semantic_types(strings(spark, d), ["mail", "ip", "other"])


@query("month_year_parse", f"WITH {STRINGS} SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month FROM orders")
def month_year_parse(spark, d):
    return strings(spark, d).select("o_orderkey", F.date_format(Y.parse_month_year(F.col("my")), "yyyy-MM-dd").alias("month"))


def _logical(c, kind):
    few = f"count(DISTINCT {c}) <= 20 OR count(DISTINCT {c}) / count({c}) < {0.1 if kind == 'string' else 0.05}"
    names = ("categorical", "string") if kind == "string" else (f"categorical_{kind}", f"continuous_{kind}")
    return f"SELECT '{c}' AS column_name, CASE WHEN {few} THEN '{names[0]}' ELSE '{names[1]}' END AS logical_type FROM customer"


@query("logical_types", " UNION ALL ".join(_logical(*x) for x in [("c_custkey", "integer"), ("c_name", "string"), ("c_nationkey", "integer"), ("c_acctbal", "float"), ("c_mktsegment", "string")]))
def logical_types(spark, d):
    return Y.logical_types(table(spark, d, "customer")).select("column_name", "logical_type")


@query("excel_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def excel_dates(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).alias("serial"))
    return o.select("o_orderkey", F.date_format(Y.from_excel_serial(F.col("serial")), "yyyy-MM-dd").alias("day"))
