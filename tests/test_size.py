"""Whole results by plans that grow with the input."""

import hashlib
import random

from pyspark.sql import functions as F

from lumenframe.operators import dedup


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_simhash_votes_where_the_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PIECE", 50)
    r = random.Random(7)
    texts = ["", "ab", "abc", "été 😀 x", *["".join(r.choices("abc é", k=r.randint(0, 400))) for _ in range(20)]]

    def expected(t: str) -> int:
        hashes = [int.from_bytes(hashlib.md5(t[i : i + 3].encode()).digest()[8:], "big") for i in range(len(t) - 2)]
        value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        return value - (1 << 64) if value >> 63 else value

    assert dedup.simhashes(texts).tolist() == [expected(t) for t in texts]
    found = dedup.simhash(spark.createDataFrame(list(enumerate([*texts, None])), "id long, t string"), "id", "t")
    assert [x["simhash"] for x in found.orderBy("id").collect()] == [*[expected(t) for t in texts], 0]
    assert "Exchange" not in plan(found)


def test_supervised_pairs_learn_from_counts(spark):
    from lumenframe.plans.catalog import QUERIES

    rows = [(a, b, x, y, float(x == y)) for a in range(12) for b in range(a + 1, 12) for x, y in [(a % 3, b % 4)]]
    pairs = spark.createDataFrame(rows, "a long, b long, k_a int, k_b int, label double")
    found = dedup.supervised_pairs(pairs, pairs, {"k": "exact"})
    assert {(r["a"], r["b"]) for r in found.collect()} == {(a, b) for a, b, x, y, _ in rows if x == y}
    double = pairs.withColumn("w", F.lit(2))
    assert {tuple(r)[:2] for r in dedup.supervised_pairs(double, pairs, {"k": "exact"}, weight="w").collect()} == {tuple(r)[:2] for r in found.collect()}
    assert "supervised_duplicates" in QUERIES


def test_supervised_duplicates_pair_classes_of_copies(spark, tmp_path):
    from lumenframe.plans.catalog import QUERIES

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    n = part.count()
    part.unionAll(part.withColumn("p_partkey", F.col("p_partkey") + 1_000_000)).write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["supervised_duplicates"](spark, str(tmp_path)).collect()
    classes = part.select("p_name", "p_size", "p_brand", "p_type").distinct().count()
    assert sum(r["copy"] for r in found) == 2 * n - classes
    assert all(r["a"] < 1_000_000 and r["b"] < 1_000_000 for r in found if not r["copy"])  # pairs are of first keys
    assert any(not r["copy"] for r in found) and len({(r["a"], r["b"], r["copy"]) for r in found}) == len(found)


def test_split_is_exact_and_orders_only_the_cut(spark):
    from lumenframe.operators import modeling

    rows = spark.range(5000).select("id", (F.col("id") % 3).alias("s"))
    for share in (0.0, 0.2, 0.5, 1.0):
        for by in (None, "s"):
            found = modeling.split_hash(rows, "id", share, by).withColumn("h", modeling.hash_order("id"))
            for key, size in ([(None, 5000)] if by is None else [(0, 1667), (1, 1667), (2, 1666)]):
                own = found if key is None else found.where(F.col("s") == key)
                got = {(r["split"], r["n"]): (r["lo"], r["hi"]) for r in own.groupBy("split").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).collect()}
                test = int(size * share)
                assert set(got) == {x for x in (("test", test), ("train", size - test)) if x[1]}
                if len(got) == 2:
                    assert got["test", test][1] < got["train", size - test][0]
    text = modeling.split_hash(rows, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "(_p#" in text and "Union" in text  # rows outside the cut's part skip the window
    same = spark.createDataFrame([("x", 1)] * 10, "id string, v int")
    assert modeling.split_hash(same, "id", 0.3).where("split = 'test'").count() == 3


def test_steps_of_models_are_written_narrow(spark, monkeypatch):
    from lumenframe.operators import modeling

    written = {}

    def seen(df, name="step"):
        written[name] = df.columns
        return df

    monkeypatch.setattr(modeling, "materialize", seen)
    df = spark.range(400).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b"), (F.col("id") % 7 * 2 + F.col("id") % 5).alias("y"), F.lit("wide").alias("z"))
    fitted, _ = modeling.auto_model(df, "id", "y", ["a"], [])
    assert written["split"] == ["a", "y", "split"]
    assert modeling.recursive_elimination(df, "id", ["a", "b"], "y").count() == 2 and written["split"] == ["a", "b", "y", "split"]
    modeling.train_cross_validated(df, "id", "y", ["a", "b"])
    assert written["folds"] == ["a", "b", "y", "fold"]
    twice = df.withColumns({c: F.col(c).cast("double") for c in "aby"})
    found = {m: {r["feature"]: r["importance"] for r in modeling.permutation_importance(fitted, twice, "id", "y", ["a", "b"], m).collect()} for m in ("rmse", "median_ae")}
    assert found["rmse"]["a"] > 1 and found["median_ae"]["a"] > 0.5 and found["rmse"]["b"] == found["median_ae"]["b"] == 0


def test_explainer_equals_plain_values(spark):
    import numpy as np

    from lumenframe.operators import explain

    leaves = [explain.Leaf(1.0, (0, 2), (-np.inf, 0.5), (3.0, np.inf), (0.4, 0.7)), explain.Leaf(-2.0, (0,), (3.0,), (np.inf,), (0.6,)), explain.Leaf(0.5, (), (), (), ())]
    x = np.random.default_rng(1).choice([-1.0, 0.5, 0.6, 3.0, 4.0, np.inf, np.nan], size=(500, 3))
    one = explain.Explainer(leaves, 3)
    for part in (x[:10], x, x[::-1]):
        assert np.array_equal(one(part), explain.shapley(part, leaves))
    assert 0 < len(one.known) <= 4


def test_cohorts_count_rows_with_one_id_once(spark, tmp_path):
    from lumenframe.plans.catalog import QUERIES

    line = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(2000)
    line.withColumn("l_orderkey", F.lit(1)).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert QUERIES["shap_cohorts"](spark, str(tmp_path)).agg(F.sum("n")).head()[0] == 2000


def test_terms_are_counted_without_shuffling_them(spark):
    from lumenframe.operators import text

    rows = [(1, "Red red apple-pie 12", "en"), (2, "apple pie, pie", "en"), (3, None, "de"), (4, "to be", "de")]
    once = spark.createDataFrame(rows, "id long, t string, lang string")
    twice = spark.createDataFrame([*rows, (2, "blue apple", "en")], "id long, t string, lang string")
    assert {tuple(r) for r in text.term_counts(twice, "id", "t").collect()} == {(1, "red", 2), (1, "apple", 1), (1, "pie", 1), (2, "apple", 2), (2, "pie", 2), (2, "blue", 1)}
    found = text.document_terms(text.worded(once, "id", "t", "lang"), "id", "lang")
    assert "Exchange" not in plan(found) and found.count() == 5
    again = text.document_terms(text.worded(twice, "id", "t", "lang"), "id", "lang").groupBy("id", "term").count()
    assert {(r["id"], r["term"], r["count"]) for r in again.collect()} == {(1, "red", 1), (1, "apple", 1), (1, "pie", 1), (2, "apple", 2), (2, "pie", 2), (2, "blue", 2)}
    assert {(r["term"], r["id"], r["tf"], r["df"]) for r in text.bag_of_words(twice, "id", "t", 2).collect()} == {("apple", 1, 1, 2), ("apple", 2, 2, 2), ("pie", 1, 1, 2), ("pie", 2, 2, 2)}
    assert plan(text.term_counts(once, "id", "t")).count("Exchange") == 1
    for r in text.tfidf(twice, "id", "t").groupBy("id").agg(F.sum(F.col("tfidf") * F.col("tfidf")).alias("n")).collect():
        assert abs(r["n"] - 1) < 1e-9


def test_spearman_counts_rows_and_joins_them_to_few_ranks_only(spark, monkeypatch):
    import numpy as np

    from lumenframe.operators import stats

    r = random.Random(5)
    rows = [(r.choice([-1.0, -0.0, 0.0, 2.5]), 2**53 + r.randrange(40), r.gauss(0, 1), 7) for _ in range(300)]
    odd = [(None, 1, 1.0, 7), (float("nan"), 2, 2.0, 7), (1.0, None, 3.0, 7)]
    df = spark.createDataFrame(rows + odd, "x double, y long, z double, same int")

    def ranks(v: list) -> list:
        return [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]

    x, y, z = (ranks([t[i] for t in rows]) for i in range(3))
    expected = {("x", "y"): (x, y), ("x", "z"): (x, z), ("y", "z"): (y, z)}
    expected = {k: round(float(np.corrcoef(*v)[0, 1]), 12) for k, v in expected.items()}
    assert "SortMergeJoin" not in plan(stats.spearman(df, ["x", "y", "z"]))
    for few in (stats.BROADCAST_VALUES, 0):  # beyond it rows meet their ranks by shuffle
        monkeypatch.setattr(stats, "BROADCAST_VALUES", few)
        for columns in (["x", "y", "z"], ["z", "y", "x"]):
            found = {tuple(sorted((t["a"], t["b"]))): round(t["r"], 12) for t in stats.spearman(df, columns).collect()}
            assert found == expected
    assert [tuple(t) for t in stats.spearman(df, ["x", "same"]).collect()] == [("x", "same", None)]
    assert [t["r"] for t in stats.spearman(df.where("false"), ["x", "y", "z"]).collect()] == [None] * 3


def test_ranges_of_running_totals_are_found_by_halving(spark):
    from lumenframe.functions.expr import running_totals

    for ranges in (1, 2, 7, 256):
        df = spark.createDataFrame([(k, float(i * i), i % 3) for k in "ab" for i in range(-40, 41) if i <= 0 or k == "a" and i * i % 7], "k string, v double, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))
        found = running_totals(df, ["k"], "v", ["n"], ranges)
        assert "lambda" not in plan(found)
        kept = sorted(tuple(t) for t in df.collect())
        expected = [(k, v, n, sum(m for j, u, m in kept if j == k and u <= v), sum(m for j, _, m in kept if j == k), min((u for j, u, _ in kept if j == k and u > v), default=None)) for k, v, n in kept]
        assert sorted(tuple(t) for t in found.collect()) == expected
