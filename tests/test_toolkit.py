"""Operators on small literal tables with known results."""

import math

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import dedup, drift, features, modeling, quality, stats, text, timeseries, types
from lumenframe.sources import tables


def column(df, name, order):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.fixture(scope="module")
def missing(spark):
    return spark.createDataFrame([(0, 1.0, None, "a"), (1, 2.0, 2.0, "b"), (2, None, 3.0, None), (3, 4.0, 4.0, "d"), (4, 5.0, 5.0, "e")], "id int, a double, b double, c string")


def test_missing_profile_counts_null_and_nan(spark, missing):
    got = {r["column_name"]: r["n_missing"] for r in quality.missing_profile(missing).collect()}
    assert got == {"id": 0, "a": 1, "b": 1, "c": 1}
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert quality.missing_profile(nan).head()["n_missing"] == 2


def test_imputation(missing):
    assert column(quality.impute(missing, ["a", "b", "c"], "drop"), "id", "id") == [1, 3, 4]
    mean = quality.impute(missing, ["a", "b"], "mean")
    assert column(mean, "a", "id")[2] == 3.0 and column(mean, "b", "id")[0] == 3.5
    assert column(quality.impute(missing, ["c"], "constant", "MISSING"), "c", "id")[2] == "MISSING"
    line = quality.impute(missing, ["a", "b"], "interpolate", order_by=["id"])
    assert column(line, "a", "id") == [1.0, 2.0, 3.0, 4.0, 5.0] and column(line, "b", "id")[0] is None
    with pytest.raises(ValueError):
        quality.impute(missing, ["c"], "constant")
    with pytest.raises(ValueError):
        quality.impute(missing, ["a"], "interpolate")


def test_outliers(spark):
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate([(1, 5), (2, 6), (3, 7), (4, 8), (100, 9)])], "id int, a double, b double")
    assert column(quality.detect_outliers(df, ["a", "b"]), "outlier_a", "id") == [False] * 4 + [True]
    assert quality.drop_outliers(df, ["a", "b"]).count() == 4
    same = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None)], "id int, a double")
    for method in ("iqr", "zscore", "modified_zscore"):
        assert column(quality.detect_outliers(same, ["a"], method), "outlier_a", "id") == [False] * 3


def test_duplicates(spark):
    df = spark.createDataFrame(list(enumerate("xyxzxy")), "id int, b string").withColumn("a", F.expr("element_at(array(1, 2, 1, 3, 4, 2), id + 1)"))
    whole = quality.detect_duplicates(df, ["a", "b"]).head()
    assert (whole["n_duplicates"], whole["n_unique"]) == (2, 4)
    assert quality.detect_duplicates(df, ["b"]).head()["n_duplicates"] == 3
    assert column(quality.remove_duplicates(df, ["b"], ["id"]), "id", "id") == [0, 1, 3]
    assert column(quality.remove_duplicates(df, ["b"], ["id"], "last"), "id", "id") == [3, 4, 5]
    assert column(quality.remove_duplicates(df, ["b"], ["id"], None), "id", "id") == [3]
    none = quality.detect_duplicates(df.limit(0), ["b"]).head()
    assert none["n_unique"] == 0


def test_cardinality_classes(spark):
    df = spark.range(100).select("id", (F.col("id") % 10).alias("ten"), F.lit(1).alias("one"), F.when(F.col("id") % 20 != 0, F.col("id")).alias("most"), F.lit(None).cast("string").alias("none"))
    got = {r["column_name"]: r["cardinality"] for r in quality.cardinality(df, df.columns).collect()}
    assert got == {"id": "unique", "ten": "medium", "one": "low", "most": "unique", "none": "empty"}


def test_types(spark):
    df = spark.createDataFrame([("a@b.co", "2024-01-02", "Aug-75", "800", "x"), ("c@d.org", "2023-12-31", "Jan-24", "0850", "y")], "mail string, day string, my string, code string, other string")
    assert types.detect_datetimes(df).collect() == [("day", "yyyy-MM-dd", 1.0)]
    assert {r["column_name"]: r["semantic_type"] for r in types.semantic_types(df).collect()}["mail"] == "email"
    out = types.convert(df, {"day": "date:yyyy-MM-dd", "my": "month_year", "code": "pad:4", "other": "double"}).collect()
    assert [str(r["my"]) for r in out] == ["1975-08-01", "2024-01-01"] and [r["code"] for r in out] == ["0800", "0850"]
    assert out[0]["other"] is None and out[0]["day"].year == 2024
    small = spark.createDataFrame([(1, 300, 1.5)], "a bigint, b bigint, c double")
    assert dict(types.optimize(small).dtypes) == {"a": "tinyint", "b": "smallint", "c": "float"}


def test_drift_direction(spark):
    base = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"), F.when(F.col("id") % 10 < 6, "a").otherwise("b").alias("k"))
    moved = spark.range(1000).select((F.col("id") % 100 + 50).cast("double").alias("x"), F.when(F.col("id") % 10 < 2, "a").otherwise("b").alias("k"))
    far, near = drift.detect_numeric_drift(base, moved, ["x"]).head(), drift.detect_numeric_drift(base, base, ["x"]).head()
    assert far["drift"] and far["ks"] == pytest.approx(0.5) and far["wasserstein"] == pytest.approx(50)
    assert not near["drift"] and near["p_value"] == 1.0
    assert far["p_value"] == pytest.approx(drift.ks_p_value(0.5, 1000, 1000), abs=1e-9)
    assert drift.categorical_drift(base, moved, "k").head()["psi"] > 0.2
    assert drift.psi_numeric(base, base, "x").head()["psi"] == pytest.approx(0, abs=1e-6)
    many = drift.categorical_drift(base, base, "k", max_categories=1).head()  # a row that says why, instead of none
    assert many["psi"] is None and many["n_categories"] == 2 and many["reason"] == "over 1 categories"


def test_text_keys_and_similarities(spark):
    df = spark.createDataFrame([(1, "This is  Sample text"), (2, "other"), (3, "this is sample text "), (4, None), (5, "")], "id int, t string")
    got = {r["id"]: (r["group_id"], r["is_duplicate"]) for r in dedup.hash_groups(df, "id", "t").collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (1, True), 4: (4, False), 5: (4, True)}
    longest = {r["id"] for r in dedup.hash_groups(df, "id", "t", "longest").where("is_duplicate").collect()}
    assert longest == {3, 5}
    pair = spark.createDataFrame([("kitten", "sitting"), ("", "a"), ("x", "x")], "a string, b string")
    assert [r[0] for r in pair.select(dedup.levenshtein_similarity(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 - 3 / 7), 0.0, 1.0]
    assert [r[0] for r in pair.select(dedup.jaccard_similarity(F.col("a"), F.col("b"), 1)).collect()] == [pytest.approx(3 / 7), 0.0, 1.0]


def test_signatures(spark):
    import hashlib

    df = spark.createDataFrame([(1, "hello world"), (2, "ab"), (3, None)], "id int, t string")
    grams = {"hello world"[i : i + 3] for i in range(9)}
    expected = [min(int(hashlib.md5(f"{g}_{i}".encode()).hexdigest(), 16) % 2147483647 for g in grams) for i in range(5)]
    got = {r["id"]: r["signature"] for r in dedup.minhash_exact(df, "id", "t", 5).collect()}
    assert got == {1: expected, 2: [0] * 5, 3: [0] * 5}
    votes = [0] * 64
    for i in range(9):
        h = int(hashlib.md5("hello world"[i : i + 3].encode()).hexdigest(), 16)
        votes = [v + (1 if h >> b & 1 else -1) for b, v in enumerate(votes)]
    bits = sum(1 << b for b, v in enumerate(votes) if v > 0)
    sim = {r["id"]: r["simhash"] for r in dedup.simhash(df, "id", "t").collect()}
    assert sim[1] % (1 << 64) == bits and sim[2] == 0
    assert dedup.optimal_bands(100, 0.7)[0] * dedup.optimal_bands(100, 0.7)[1] == 100


def test_lsh_groups_and_components(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank"
    df = spark.createDataFrame([(1, base), (2, base + "s"), (3, "completely different words in this sentence here"), (4, base), (5, "")], "id int, t string")
    got = {r["id"]: r["group_id"] for r in dedup.lsh_groups(df, "id", "t", 0.7, 60).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}
    edges = spark.createDataFrame([(2, 1), (3, 2), (9, 8), (4, 3)], "a int, b int")
    assert dict(dedup.connected_components(edges).collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_similar_records(spark):
    df = spark.createDataFrame([(1, "Ann", 10.0), (2, "Ann", 10.5), (3, "Bob", 99.0), (4, None, 10.0)], "id int, n string, v double")
    pairs = dedup.similar_records(df, "id", {"n": "text", "v": "number"}, F.array(F.lit("x")), 0.9)
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [(1, 2)]
    flags = {r["id"]: (r["group_id"], r["is_duplicate"]) for r in dedup.flag_similar_records(df, "id", pairs).collect()}
    assert flags == {1: (1, False), 2: (1, True), 3: (3, False), 4: (4, False)}


def test_statistics(spark):
    df = spark.createDataFrame([(float(i), float(2 * i), "a" if i < 5 else "b") for i in range(10)] + [(None, 1.0, "a")], "x double, y double, g string")
    r = {(s["a"], s["b"]): s["r"] for s in stats.pearson(df, ["x", "y"]).collect()}
    assert r["x", "y"] == pytest.approx(1)
    assert stats.spearman(df, ["x", "y"]).head()["r"] == pytest.approx(1)
    s = stats.numeric_summary(df, ["x"]).head()
    assert (s["n"], s["n_missing"], s["p50"], s["n_zero"]) == (10, 1, 4.5, 1)
    assert stats.anova(df, "g", "x").head()["eta_squared"] == pytest.approx(0.757575757)
    two = spark.createDataFrame([("a", "x")] * 8 + [("a", "y")] * 2 + [("b", "x")] * 3 + [("b", "y")] * 7, "a string, b string")
    assert stats.chi_square(two, "a", "b").head()["chi2"] == pytest.approx(3.2323, abs=1e-3)


def test_time_series(spark):
    rows = [(i, 10 + i + 5 * math.sin(2 * math.pi * i / 6)) for i in range(60)]
    series = spark.createDataFrame(rows, "ts int, value double")
    acf = {r["lag"]: r["acf"] for r in timeseries.autocorrelation(series, 3).collect()}
    v = [x for _, x in rows]
    m = sum(v) / 60
    assert acf[2] == pytest.approx(sum((v[i] - m) * (v[i - 2] - m) for i in range(2, 60)) / sum((x - m) ** 2 for x in v))
    parts = [r for r in timeseries.decompose(series, 6).orderBy("ts").collect() if r["residual"] is not None]
    assert len(parts) == 54 and max(abs(r["residual"]) for r in parts) < 1e-6
    assert {r["method"] for r in timeseries.forecast_baselines(series).collect()} == {"naive", "mean", "drift"}


def test_features_and_encoders(spark):
    df = spark.createDataFrame([(1, "A", 0), (2, "B", 1), (3, "C", 0), (4, "A", 1), (5, "B", 0)], "n int, c string, t int")
    hot = features.one_hot(df, "c", features.categories(df, "c"))
    assert hot.columns == ["n", "t", "c_B", "c_C"] and column(hot, "c_B", "n") == [0, 1, 0, 0, 1]
    unseen = spark.createDataFrame([(1, "A"), (2, "D"), (3, None)], "n int, c string")
    assert column(features.encode(unseen, "c", features.ordinal_mapping(df, "c"), "code", -1), "c_encoded", "n") == [0, -1, -1]
    target = {r["c"]: r["mean"] for r in features.target_mapping(df, "c", "t", 10).collect()}
    assert target["A"] == pytest.approx((1 + 10 * 0.4) / 12)
    assert "poly_n^2" in features.polynomial(df, ["n", "t"]).columns and "poly_n*t" in features.polynomial(df, ["n", "t"]).columns
    recipe = features.Recipe().add(lambda x: features.lagged(x, ["n"], [1], ["n"]))
    assert column(recipe.transform(df), "n_lag_1", "n") == column(recipe.transform(df), "n_lag_1", "n") == [None, 1, 2, 3, 4]
    assert features.lag_plan("fibonacci", 8) == [1, 2, 3, 5, 8] and features.lag_plan("exponential", 8) == [1, 2, 4, 8]
    assert column(features.binned(df, "n", 2, "quantile"), "n_bin", "n") == [0, 0, 0, 1, 1]
    with pytest.raises(ValueError):
        features.categories(df, "c", 2)


def test_text(spark):
    df = spark.createDataFrame([(1, "Hello, World! It's GREAT and good 42"), (2, ""), (3, None)], "id int, t string")
    assert column(df.select("id", text.clean(F.col("t")).alias("x")), "x", "id") == ["hello world great and good", "", ""]
    s = text.text_stats(df, "t").orderBy("id").collect()
    assert (s[0]["text_word_count"], s[0]["text_uppercase_count"], s[2]["text_word_count"]) == (7, 1, 0)
    assert column(df.select("id", text.sentiment(F.col("t")).alias("x")), "x", "id") == [1.0, 0.0, 0.0]
    assert column(text.readability(df, "t"), "text_fk_grade", "id")[1:] == [0.0, 0.0]
    mail = spark.createDataFrame([("write to a.b@c.org now",)], "t string")
    assert mail.select(text.anonymize(F.col("t"))).head()[0] == "write to [EMAIL] now"


def test_splits_and_metrics(spark):
    df = spark.range(100).select("id", (F.col("id") % 4).alias("g"), F.expr("date_add(date'2020-01-01', cast(id as int))").alias("d"))
    s = modeling.split_time(df, "d").groupBy("split").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect()
    by = {r["split"]: r for r in s}
    assert by["test"]["n"] == 20 and by["train"]["hi"] < by["test"]["lo"]
    assert modeling.split_hash(df, "id", 0.2, "g").where("split = 'test'").groupBy("g").count().select("count").distinct().collect() == [(5,)]
    p = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.3), (0, 0, 0.4)], "t int, p int, s double")
    m = modeling.classification_metrics(p, "t", "p").head()
    assert m["accuracy"] == 0.75 and m["precision"] == pytest.approx((1 + 2 / 3) / 2)
    assert modeling.auc(p, "t", "s").head()[0] == pytest.approx(0.875)
    assert modeling.optimal_threshold(p, "t", "s").head()["f1"] == pytest.approx(0.8)
    with pytest.raises(ValueError):
        modeling.make_model("nope", "regression")


def test_sources(spark, tmp_path):
    df = spark.range(25).select("id", F.col("id").cast("string").alias("s"))
    tables.save_chunks(df.coalesce(1), f"{tmp_path}/out", 10, "csv")
    assert len(list((tmp_path / "out").glob("part-*.csv"))) == 3
    assert tables.load_chunks(spark, f"{tmp_path}/out", "part-*.csv", "csv").count() == 25
    assert sum(1 for _ in tables.iterate_rows(df)) == 25
    assert tables.process_chunks(df, lambda b: b.assign(id=b["id"] * 2), "id long, s string").agg(F.sum("id")).head()[0] == 600
    assert {r["column_name"]: r["bytes"] for r in tables.estimate_bytes(df).collect()} == {"id": 200, "s": 40}
    with pytest.raises(ValueError):
        tables.load_chunks(spark, "x", file_format="feather")


def test_reports(spark):
    from lumenframe.operators import report

    df = spark.createDataFrame([(1, 2.0, "a|b"), (2, None, "<c>")], "id int, x double, s string")
    text_form = report.quality_report(df)
    assert "## Missing values" in text_form and "| x | 2 | 1 | 50 |" in text_form
    assert "&lt;c&gt;" in report.to_html(df) and "a\\|b" in report.to_markdown(df)
    assert "psi" not in report.drift_report(df, df) and "| s | categorical |" in report.drift_report(df, df)
    assert report.escape_markup("$5_") == "\\$5\\_"
