"""Queries over feature engineering and encoders."""


from pyspark.sql import functions as F

from ..operators import features as X
from .base import query, table
from .stats import rounded


def items(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("poly_features", 'SELECT l_orderkey, l_linenumber, l_quantity, l_discount, round(l_quantity * l_quantity, 4) AS "poly_l_quantity^2", round(l_quantity * l_discount, 4) AS "poly_l_quantity*l_discount", round(l_discount * l_discount, 4) AS "poly_l_discount^2" FROM lineitem')
def poly_features(spark, d):
    return rounded(X.polynomial(items(spark, d), ["l_quantity", "l_discount"]), 4)


@query("interaction_features", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount, 5) AS int_l_quantity_x_l_discount, round(l_quantity + l_discount, 5) AS int_l_quantity_plus_l_discount, round(l_discount / (l_quantity + 1e-10::DOUBLE), 5) AS int_l_discount_div_l_quantity FROM lineitem")
def interaction_features(spark, d):
    out = X.interactions(items(spark, d), [("l_quantity", "l_discount")], ["multiply", "add", "ratio"])
    return rounded(out.drop("l_quantity", "l_discount", "int_l_quantity_div_l_discount"), 5)


PARTS = ["year", "quarter", "month", "day", "weekday", "dayofyear", "week", "days_in_month", "is_weekend", "is_month_start", "is_month_end", "is_quarter_end", "month_sin", "month_cos"]


@query("datetime_features", """SELECT o_orderkey, year(o)::INT AS d_year, quarter(o)::INT AS d_quarter, month(o)::INT AS d_month, day(o)::INT AS d_day, (isodow(o) - 1)::INT AS d_weekday, dayofyear(o)::INT AS d_dayofyear, week(o)::INT AS d_week, day(last_day(o))::INT AS d_days_in_month,
 (isodow(o) >= 6)::INT AS d_is_weekend, (day(o) = 1)::INT AS d_is_month_start, (last_day(o) = o::DATE)::INT AS d_is_month_end, (last_day(o) = o::DATE AND month(o) % 3 = 0)::INT AS d_is_quarter_end, round(sin(2 * pi() * month(o) / 12), 6) AS d_month_sin, round(cos(2 * pi() * month(o) / 12), 6) AS d_month_cos FROM (SELECT o_orderkey, o_orderdate AS o FROM orders)""")
def datetime_features(spark, d):
    out = X.datetime_features(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", PARTS, "d")
    return rounded(out.drop("o_orderdate"))


@query("binned_uniform", "WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, least(4, greatest(0, ceil((l_extendedprice - lo) / ((hi - lo) / 5)) - 1))::INT AS l_extendedprice_bin FROM lineitem, s")
def binned_uniform(spark, d):
    return X.binned(table(spark, d, "lineitem"), "l_extendedprice").select("l_orderkey", "l_linenumber", "l_extendedprice_bin")


@query("binned_quantile", "WITH s AS (SELECT quantile_cont(l_extendedprice, [.2, .4, .6, .8]) AS q FROM lineitem) SELECT l_orderkey, l_linenumber, ((l_extendedprice > q[1])::INT + (l_extendedprice > q[2])::INT + (l_extendedprice > q[3])::INT + (l_extendedprice > q[4])::INT)::INT AS l_extendedprice_bin FROM lineitem, s")
def binned_quantile(spark, d):
    return X.binned(table(spark, d, "lineitem"), "l_extendedprice", strategy="quantile").select("l_orderkey", "l_linenumber", "l_extendedprice_bin")


EV = ["event_id", "user_id", "value"]
OVER = "WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"


def events(spark, d):
    return table(spark, d, "events").select(*EV)


@query("lag_features", f"SELECT event_id, user_id, value, lag(value, 1) OVER w AS value_lag_1, lag(value, 3) OVER w AS value_lag_3 FROM events {OVER}")
def lag_features(spark, d):
    return X.lagged(events(spark, d), ["value"], [1, 3, 0], ["event_id"], ["user_id"])


@query("rolling_features", """SELECT event_id, round(avg(value) OVER w, 6) AS value_rolling_mean_3, round(stddev_samp(value) OVER w, 6) AS value_rolling_std_3, min(value) OVER w AS value_rolling_min_3, max(value) OVER w AS value_rolling_max_3, round(sum(value) OVER w, 6) AS value_rolling_sum_3, count(value) OVER w AS value_rolling_count_3
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def rolling_features(spark, d):
    out = X.rolling(events(spark, d), ["value"], [3], list(X.ROLLING), ["event_id"], ["user_id"])
    return rounded(out.drop("user_id", "value"))


@query("diff_features", f"SELECT event_id, round(value - lag(value) OVER w, 6) AS value_diff_1, round(value / nullif(lag(value) OVER w, 0) - 1, 5) AS value_pct_change_1 FROM events {OVER}")
def diff_features(spark, d):
    out = X.differences(events(spark, d), ["value"], [1], ["event_id"], ["user_id"])
    return out.select("event_id", F.round("value_diff_1", 6).alias("value_diff_1"), F.round("value_pct_change_1", 5).alias("value_pct_change_1"))




@query("encode_onehot", "SELECT o_orderkey, (l = 'O')::INT AS l_O, (l = 'P')::INT AS l_P FROM (SELECT o_orderkey, o_orderstatus AS l FROM orders)")
def encode_onehot(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("l"))
    return X.one_hot(df, "l", ["F", "O", "P"])


@query("encode_onehot_fitted")
def encode_onehot_fitted(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return X.one_hot(df, "c_mktsegment", X.categories(df, "c_mktsegment"))


@query("encode_ordinal", "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS c_mktsegment_encoded FROM customer")
def encode_ordinal(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return X.encode(df, "c_mktsegment", X.ordinal_mapping(df, "c_mktsegment"), "code", -1).drop("c_mktsegment")


@query("encode_target", "WITH g AS (SELECT c_nationkey AS k, count(*) AS n, sum(c_acctbal) AS s FROM customer GROUP BY 1) SELECT c_custkey, round((s + 10 * (SELECT avg(c_acctbal) FROM customer)) / (n + 10), 4) AS c_nationkey_encoded FROM customer JOIN g ON k = c_nationkey")
def encode_target(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    out = X.encode(df, "c_nationkey", X.target_mapping(df, "c_nationkey", "c_acctbal"), "mean", 0.0)
    return out.select("c_custkey", F.round("c_nationkey_encoded", 4).alias("c_nationkey_encoded"))


@query("encode_target_oof", """WITH g AS (SELECT c_nationkey AS k, c_custkey % 5 AS f, count(*) AS n, sum(c_acctbal) AS s FROM customer GROUP BY ALL), r AS (SELECT k, f, sum(n) OVER (PARTITION BY k) - n AS n, sum(s) OVER (PARTITION BY k) - s AS s FROM g)
 SELECT c_custkey, round((s + 10 * (SELECT avg(c_acctbal) FROM customer)) / (n + 10), 4) AS c_nationkey_encoded FROM customer JOIN r ON k = c_nationkey AND f = c_custkey % 5""")
def encode_target_oof(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    out = X.target_out_of_fold(df, "c_nationkey", "c_acctbal", F.col("c_custkey") % 5)
    return out.select("c_custkey", F.round("c_nationkey_encoded", 4).alias("c_nationkey_encoded"))


@query("encode_binary", "WITH c AS (SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) AS k FROM customer) SELECT c_custkey, ((k >> 2) & 1)::INT AS c_mktsegment_0, ((k >> 1) & 1)::INT AS c_mktsegment_1, (k & 1)::INT AS c_mktsegment_2 FROM c")
def encode_binary(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return X.binary_bits(df, "c_mktsegment", X.ordinal_mapping(df, "c_mktsegment"), 3).drop("c_mktsegment")


@query("encode_hashing", "SELECT c_custkey, " + ", ".join(f"((('0x' || md5(c_mktsegment)[25:32])::BIGINT % 4 = {i})::INT + (('0x' || md5(c_nationkey::VARCHAR)[25:32])::BIGINT % 4 = {i})::INT)::INT AS col_{i}" for i in range(4)) + " FROM customer")
def encode_hashing(spark, d):
    return X.hashed(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), ["c_mktsegment", "c_nationkey"], 4).drop("c_mktsegment", "c_nationkey")


@query("encode_woe", "WITH t AS (SELECT c_mktsegment, (c_acctbal > 5000)::INT AS y FROM customer), g AS (SELECT c_mktsegment, sum(y) AS e, sum(1 - y) AS o FROM t GROUP BY 1) SELECT c_mktsegment, round(ln(((e + .5) / (sum(e) OVER () + 1)) / ((o + .5) / (sum(o) OVER () + 1))), 6)::DOUBLE AS woe FROM g")
def encode_woe(spark, d):
    df = table(spark, d, "customer").select("c_mktsegment", (F.col("c_acctbal") > 5000).cast("int").alias("y"))
    return rounded(X.woe_mapping(df, "c_mktsegment", "y"))


@query("bin_kmeans")
def bin_kmeans(spark, d):
    return X.binned(table(spark, d, "part"), "p_retailprice", 4, "kmeans").select("p_partkey", "p_retailprice_bin")
