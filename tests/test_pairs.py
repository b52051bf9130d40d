"""All pairs of rows, copies included, by plans that shuffle rows and not pairs."""

import random

from pyspark.sql import functions as F

from lumenframe.operators import dedup as D
from lumenframe.operators import record_lsh as R


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_simhash_pairs_hold_rows_of_one_hash(spark):
    r = random.Random(3)
    base = [r.getrandbits(63) for _ in range(12)]
    hashes = [r.choice(base) ^ sum(1 << b for b in r.sample(range(63), r.randint(0, 3))) for _ in range(150)] + [0] * 140 + [5, -1, -1]
    rows = list(enumerate(hashes))
    expected = {(a, b, (x ^ y).bit_count() if (x < 0) == (y < 0) else ((x ^ y) & (1 << 64) - 1).bit_count()) for a, x in rows for b, y in rows if a < b}
    expected = {t for t in expected if t[2] <= 3}
    found = [tuple(t) for t in D.simhash_pairs(spark.createDataFrame(rows, "id long, simhash long"), "id").collect()]
    assert set(found) == expected and len(found) == len(expected)
    assert sum(t[2] == 0 for t in found) >= 140 * 139 // 2


def test_listed_pairs_shuffle_rows_only(spark):
    rows = [(i, "xyz"[i % 3] if i % 11 else None, i % 2, "pq"[i % 2], "r|s" if i % 5 else "r") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, v int, m string, n string")
    keys = F.array(F.when(F.col("k").isNotNull(), F.concat_ws("|", "k", F.col("v").cast("string"))), F.concat_ws("|", "m", "n"))
    found = D.listed_pairs(df, "id", keys)
    expected = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[1] and a[1:3] == b[1:3] or a[3:] == b[3:]))
    assert sorted(map(tuple, found.collect())) == expected
    text = plan(found)
    assert "Generate explode(_rows_" in text and "Exchange" not in text[: text.index("SortMergeJoin")]  # nothing is shuffled after pairs have met


def test_list_keys_of_odd_parts(spark, tmp_path):
    from lumenframe.plans.catalog import QUERIES

    rows = [(1, "a|b", "c", "B", 5), (2, "a", "b|c", "C", 6), (3, "n", None, None, 5), (4, "m", "t", "B", None), (5, "o", "t", None, 5), (6, "B", "5", "D", 7), (7, "a", "b|c", "E", 8), (8, "q", "u", "B", 5)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(map(tuple, QUERIES["blocked_list_pairs"](spark, str(tmp_path)).collect())) == [(1, 8), (2, 7)]


def test_copies_are_multiplied_a_slice_at_a_time(spark):
    members = spark.range(1000).select("id", F.when(F.col("id") < 700, 0).otherwise(700).cast("long").alias("rep"))
    pairs = spark.createDataFrame([(0, 0, 1.0), (0, 700, 0.5)], "a long, b long, similarity double")
    found = D.expanded(pairs, members)
    assert found.distinct().count() == found.count() == 700 * 699 // 2 + 700 * 300
    assert plan(found).count("Generate explode(transform(sequence") == 2  # Spark holds the rows of one slice by another, not of whole chunks
    ids = spark.range(5).select(F.array(F.lit(1)).alias("c")).select(D._slices(F.col("c"), 2).alias("s")).head()
    assert ids["s"] == [[1]] and spark.range(1).select(D._slices(F.sequence(F.lit(1), F.lit(5)), 2).alias("s")).head()["s"] == [[1, 2], [3, 4], [5]]


def test_cosine_is_rounded_once_for_all_copies(spark):
    df = spark.range(60).selectExpr("id", "concat('name ', id % 3) AS t", "'one' AS k")
    found = D.cosine_trigram_pairs(df, "id", "t", F.col("k"), 0.5, digits=6)
    whole = plan(found)
    assert "round(" not in whole.split("Generate explode(_ys")[0]
    assert {r["similarity"] for r in found.collect()} == {round(r["similarity"], 6) for r in D.cosine_trigram_pairs(df, "id", "t", F.col("k"), 0.5).collect()}


def test_bundles_open_to_all_pairs(spark):
    rows = [(i, "xy"[i % 2], f"name {i % 3}" if i % 7 else None, i % 50) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k string, t string, v int")
    found = D.bundles(df, "id", ["k", "t"], ["v"], 16)
    assert found.count() < 60 and found.selectExpr("sum(size(_rows))").head()[0] == 200
    met = D.blocked_pairs(found, "id", F.col("k"), ["t", "_rows"], 5).unionByName(D.among(found, ["t"]))
    assert met.count() < 60 * 61 // 2  # names are compared once for the sizes of a bundle
    got = sorted(map(tuple, D.opened(met.withColumn("same", F.expr("t_a <=> t_b")), ["v"]).select("a", "b", "v_a", "v_b", "same").collect()))
    assert got == sorted((p[0], q[0], p[3], q[3], p[2] == q[2]) for p in rows for q in rows if p[0] < q[0] and p[1] == q[1])


def test_pairs_that_cannot_reach_the_threshold_are_left_before_they_are_opened(spark):
    rows = [(float(x), y / 10) for x in (0, 1) for y in range(11)]
    df = spark.createDataFrame(rows, "f_x double, f_y double").selectExpr("1L AS a", "2L AS b", "*")
    for model in (({"f_x": 5.0, "f_y": 3.0}, -6.0), ({"f_x": 1.0, "f_y": -3.0}, 0.5)):
        whole = {t["probability"] for t in D.predicted_pairs(df, {}, model).collect()}
        assert whole and {t["probability"] for t in D.predicted_pairs(df.where(D.may_reach(model, ["f_x"])), {}, model).collect()} == whole
    assert df.where(D.may_reach(({"f_x": 5.0, "f_y": 3.0}, -6.0), ["f_x"])).count() == 11


def test_letters_bound_the_similarity_of_texts(spark):
    r = random.Random(9)
    texts = ["", "A", "aaaaaaaaaa", "été", "😀 x", *["".join(r.choices("abcé19 ", k=r.randint(0, 12))) for _ in range(60)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("t"), R.letter_bag(F.col("t")).alias("g"), F.length(F.lower("t")).alias("n"))
    both = df.selectExpr("t AS t1", "g AS g1", "n AS n1").crossJoin(df.selectExpr("t AS t2", "g AS g2", "n AS n2"))
    bound = R.most_similar_texts(*map(F.col, ("g1", "g2", "n1", "n2")))
    found = both.select(bound.alias("most"), D.levenshtein_similarity(F.col("t1"), F.col("t2")).alias("s"), (F.col("t1") == F.col("t2")).alias("same")).collect()
    assert all(t["most"] >= t["s"] - 1e-12 for t in found) and all(t["most"] == 1 for t in found if t["same"])
    assert sum(t["most"] < 0.5 for t in found) > 500


def test_records_with_few_keys_are_not_shuffled_after_they_met(spark):
    df = spark.range(300).selectExpr("id", "concat('name ', lpad(id % 150, 6, '0')) AS t", "cast(id % 75 * 3 + 50 AS double) AS v", "'one' AS k")
    found = R.similar_pairs(df, "id", {"t": "text", "v": "number"}, 0.85, "block", F.col("k"))
    text = plan(found)
    assert "Exchange" not in text[: text.index("SortMergeJoin")]
    rows = [(t["id"], t["t"], t["v"]) for t in df.collect()]
    score = lambda p, q: sum(x != y for x, y in zip(p[1], q[1], strict=True)) / 11 / 2 + abs(p[2] - q[2]) / max(p[2], q[2]) / 2
    got = {(t["a"], t["b"]) for t in found.collect()}
    assert {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and score(p, q) <= 0.05} <= got and len(got) == found.count()


def test_minhash_shuffles_signatures_and_no_texts(spark, monkeypatch):
    rows = [(1, "The quick  brown fox"), (2, "the quick brown fox"), (3, "ab"), (4, None), (5, "abc"), (6, "other words here")]
    df = spark.createDataFrame(rows, "id long, t string")

    def never(*_):
        raise AssertionError("texts are written")

    monkeypatch.setattr(D, "materialize", never)
    found = D.minhash(df, "id", "t", 4)
    sig = {t["id"]: t["signature"] for t in found.collect()}
    assert sorted(sig) == [1, 2, 5, 6] and sig[1] == sig[2] and sig[5] == [spark.range(1).select(F.xxhash64(F.lit("abc"), F.lit(i))).head()[0] for i in range(4)]
    assert plan(D.minhash(df, "id", "t", 4)).count("Exchange") == 1
