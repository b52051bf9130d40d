"""Record pairs from typed keys against all pairs in plain Python."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import dedup as D
from lumenframe.operators import record_lsh as R

DAY0 = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, name string, amount double, day timestamp, kind string, block string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def one(kind, a, b):
    if a is None or b is None:
        return 0.0
    if kind == "number":
        most = max(abs(a), abs(b))
        return 1.0 if most == 0 else 1 - min(1, abs(a - b) / most)
    if kind == "date":
        return max(0.0, 1 - abs((a - b).total_seconds()) / 86400 / 30)
    if kind == "text":
        a, b = a.lower(), b.lower()
        return 1.0 if a == b else 0.0 if not a or not b else 1 - edits(a, b) / max(len(a), len(b))
    if kind == "ngram":
        a, b = a.lower(), b.lower()
        x, y = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (a, b))
        return 1.0 if a == b else len(x & y) / len(x | y) if x | y else 0.0
    return float(a == b)


def all_pairs(rows, columns, weights, threshold, same_block):
    whole = sum(weights.values())
    names = SCHEMA.replace(",", "").split()[::2]
    found = {}
    for i, p in enumerate(rows):
        for q in rows[i + 1 :]:
            if same_block and (p[5] is None or p[5] != q[5]):
                continue
            s = sum(weights[c] / whole * one(k, p[names.index(c)], q[names.index(c)]) for c, k in columns.items())
            if s >= threshold - 1e-9:
                found[min(p[0], q[0]), max(p[0], q[0])] = s
    return found


def records(r, n, length):
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:  # a record near an earlier one
            _, name, amount, day, kind, block = r.choice(rows)
            at = r.randrange(len(name) + 1) if name else 0
            name = None if name is None else r.choice([name, name[:at] + r.choice("xyz") + name[at:], name[:at] + name[at + 1 :], name[:at] + "q" + name[at + 1 :], name.upper()])
            amount = None if amount is None else amount * r.choice([1, 1.01, 0.97, 1.2, -1])
            day = None if day is None else day + datetime.timedelta(hours=r.choice([0, 1, 60, -100]))
        else:
            name = r.choice(["", None, "".join(r.choice("abcdefgh ") for _ in range(length))] if r.random() < 0.1 else ["".join(r.choice("abcdefgh ") for _ in range(length))])
            amount, day = r.choice([0.0, None, r.uniform(-50, 5000), r.uniform(0, 1)]), r.choice([None, DAY0 + datetime.timedelta(days=r.randrange(400))])
            kind, block = r.choice("uv"), r.choice(["p", "q", None])
        rows.append((i, name, amount, day, kind, block))
    return rows


@pytest.mark.parametrize(
    ("columns", "weights", "threshold"),
    [
        ({"name": "text", "amount": "number"}, {"name": 2.0, "amount": 1.0}, 0.96),
        ({"amount": "number", "day": "date", "kind": "exact"}, {"amount": 1.0, "day": 1.0, "kind": 2.0}, 0.9),
        ({"amount": "number"}, {"amount": 1.0}, 1.0),
        ({"name": "text"}, {"name": 1.0}, 0.94),
    ],
)
def test_keys_without_minhash_lose_no_pair(spark, columns, weights, threshold):
    rows = records(random.Random(4), 260, 16)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for candidates, same_block in (("lsh", False), ("intersection", True), ("block", True), ("union", False)):
        got = R.similar_pairs(df, "id", columns, threshold, candidates, None if candidates == "lsh" else F.col("block"), weights=weights).collect()
        expected = all_pairs(rows, columns, weights, threshold, same_block)
        assert len(got) == len(expected) > 0
        assert {(x["a"], x["b"]): x["similarity"] for x in got} == pytest.approx(expected)


@pytest.mark.parametrize("method", ["exact_subset", "fuzzy_subset"])
def test_keys_of_the_subset_methods(spark, method):
    df = spark.createDataFrame(records(random.Random(5), 200, 12), SCHEMA)
    columns, weights = {"name": "text", "amount": "number", "day": "date"}, {"name": 3.0, "amount": 1.0, "day": 1.0}
    by_block = R.similar_pairs(df, "id", columns, 0.75, "block", F.lit("one"), method, weights)
    by_keys = R.similar_pairs(df, "id", columns, 0.75, "lsh", None, method, weights, recall=0.9999)
    expected = sorted(map(tuple, by_block.collect()))
    assert sorted(map(tuple, by_keys.collect())) == expected and expected


@pytest.mark.parametrize("kind", ["text", "ngram"])
def test_minhash_keys_find_nearly_all(spark, kind):
    r = random.Random(7)
    rows = records(r, 400, 40)
    columns, weights = {"name": kind, "kind": "exact"}, {"name": 1.0, "kind": 1.0}
    got = {(x["a"], x["b"]) for x in R.similar_pairs(spark.createDataFrame(rows, SCHEMA), "id", columns, 0.92, weights=weights).collect()}
    expected = all_pairs(rows, columns, weights, 0.92, False)
    assert got <= set(expected) and len(got) >= 0.95 * len(expected) > 50


def test_groups_of_any_size(spark, monkeypatch):
    r = random.Random(8)
    rows = records(r, 150, 16)
    hot = (None, "the same record x", 70.0, DAY0, "u", "p")
    rows += [(1000 + i, *hot[1:]) for i in range(2500)] + [(9000, "the same record y", 70.0, DAY0, "u", "p"), (9001, None, 3.0, DAY0, "u", "p"), (9002, None, 3.0, DAY0, "u", "p")]
    df = spark.createDataFrame(rows, SCHEMA)
    columns, weights = {"name": "text", "amount": "number"}, {"name": 2.0, "amount": 1.0}
    got = {x["id"]: (x["group_id"], x["is_duplicate"], round(x["similarity"], 9)) for x in R.similar_groups(df, "id", columns, 0.95, weights=weights).collect()}
    links = all_pairs([x for x in rows if x[0] < 1002 or x[0] >= 9000], columns, weights, 0.95, False)
    root = {i: i for i in got}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    best = {}
    for (a, b), s in links.items():
        for i in (a, b):
            best[i] = max(best.get(i, 0), s)
    for i in got:
        if i < 1002 or i >= 9000:
            assert got[i] == (find(i), find(i) != i, round(best.get(i, 0), 9))
        else:
            assert got[i] == (1000, True, 1.0)
    assert got[9000][0] == 1000 and got[9002] == (9002, False, 0.0)


def test_wide_keys_and_no_keys(spark):
    df = spark.createDataFrame(records(random.Random(1), 30, 10), SCHEMA)
    with pytest.raises(ValueError):
        R.similar_pairs(df, "id", {"name": "text", "amount": "number"}, 0.3)
    with pytest.raises(ValueError):
        R.similar_pairs(df, "id", {"name": "text"}, 0.9, "union")
    empty = spark.createDataFrame([], SCHEMA)
    assert R.similar_groups(empty, "id", {"name": "text", "amount": "number"}, 0.9).count() == 0


def test_blocks_larger_than_a_cell(spark):
    df = spark.range(50).selectExpr("id", "array(id % 2, 7, null) AS k", "id * 2 AS v")
    for block in (3, 1000):
        got = sorted(map(tuple, D.blocked_pairs(df, "id", F.col("k"), ["v"], block).collect()))
        assert got == sorted((a, b, 2 * a, 2 * b) for a in range(50) for b in range(a + 1, 50))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_candidates_grow_in_proportion(spark):
    counts = []
    for sf in ("sf0.01", "sf0.1"):
        df = spark.read.parquet(f"/root/testdata/{sf}/customer.parquet")
        columns, weights = {"c_name": "text", "c_acctbal": "number"}, {"c_name": 2.0, "c_acctbal": 1.0}
        keys = R.record_keys(df, columns, weights, 0.955, within=F.array(F.col("c_nationkey").cast("string")))
        counts.append(D.blocked_pairs(df, "c_custkey", keys, []).count())
    assert 0 < counts[0] and counts[1] < 20 * counts[0]  # ten times the rows; all pairs of a nation grow a hundredfold


def names(spark, copies=7):
    texts = ["red bolt", "red bolts", "blue nut", None, "ab", "Red bolt", "grey gear"]
    return spark.createDataFrame([(i, texts[i % 7], "xyz"[i % 2] if i % 11 else None, i % 3) for i in range(7 * copies)], "id long, t string, k string, v int")


def test_classes_expand_to_all_pairs(spark):
    df = names(spark)
    score = D.levenshtein_similarity(F.col("t_a"), F.col("t_b"))
    by_rows = D.blocked_pairs(df, "id", F.col("k"), ["t"]).select("a", "b", score.alias("s")).where("s >= 0.7")
    met, members = D.class_pairs(df, "id", F.col("k"), ["t"], 2)
    for block in (2, 1000):
        got = sorted(map(tuple, D.expanded(met.select("a", "b", score.alias("s")).where("s >= 0.7"), members, block).collect()))
        assert got == sorted(map(tuple, by_rows.collect())) and len(got) > 50


def test_copies_are_scored_once_and_lists_of_keys_dedupe(spark):
    df = spark.range(600).selectExpr("id", "concat('k', id % 3) AS k", "concat('name ', id % 3) AS t", "array(concat('k', id % 3), concat('n', id % 2), null) AS ks")
    met, members = D.class_pairs(df, "id", F.col("k"), ["t"])
    assert met.count() == 3  # 59,700 pairs of rows
    assert D.expanded(met.select("a", "b"), members, 50).distinct().count() == 3 * 200 * 199 // 2
    got = D.expanded(*D.class_pairs(df, "id", F.col("ks"), []), 50)
    assert got.count() == got.distinct().count() == sum(1 for a in range(600) for b in range(a + 1, 600) if a % 3 == b % 3 or a % 2 == b % 2)


def test_pairs_meet_in_many_tasks_and_none_goes_to_the_driver(spark):
    df = spark.range(3000).selectExpr("id", "id % 2 AS k", "id AS v")
    made = D.blocked_pairs(df, "id", F.col("k"), ["v"], 100)
    assert made.count() == 2 * 1500 * 1499 // 2
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "REPARTITION_BY_NUM" in plan


def test_grams_of_classes(spark):
    df = names(spark)
    got = {(r["a"], r["b"]): r["similarity"] for r in D.cosine_trigram_pairs(df, "id", "t", F.col("k"), 0.5).collect()}
    rows = [r for r in df.collect() if r["k"] and r["t"] and len(r["t"]) > 2]

    def counts(t):
        grams = [t.lower()[i : i + 3] for i in range(len(t) - 2)]
        return {g: grams.count(g) for g in grams}

    expected = {}
    for p in rows:
        for q in rows:
            x, y = counts(p["t"]), counts(q["t"])
            s = sum(n * y.get(g, 0) for g, n in x.items()) / (sum(n * n for n in x.values()) * sum(n * n for n in y.values())) ** 0.5
            if p["id"] < q["id"] and p["k"] == q["k"] and s >= 0.5:
                expected[p["id"], q["id"]] = s
    assert got == pytest.approx(expected) and expected


def test_clusters_and_groups_of_classes(spark):
    df = names(spark)
    near = lambda a, b: 1 - D.levenshtein_similarity(F.col(a), F.col(b)) <= 0.3
    ids = df.select("id")
    by_rows = D.dbscan(ids, D.blocked_pairs(df, "id", F.col("k"), ["t"]).where(near("t_a", "t_b")).select("a", "b"), 7)
    met, members = D.class_pairs(df, "id", F.col("k"), ["t"])
    got = D.dbscan(ids, met.where(near("t_a", "t_b")).select("a", "b"), 7, members)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, by_rows.collect()))
    assert len({r["cluster"] for r in got.collect()}) == 3  # two clusters and noise
    rows = df.withColumn("_t", D.text_key(F.col("t")))
    links = D.blocked_pairs(rows, "id", F.col("k"), ["_t"]).select("a", "b", D.levenshtein_similarity(F.col("_t_a"), F.col("_t_b")).alias("similarity"))
    expected = D.flag_similar_records(df, "id", links.where("similarity >= 0.8")).select("id", "group_id", "is_duplicate")
    assert sorted(map(tuple, D.fuzzy_groups(df, "id", "t", 0.8, F.col("k")).collect())) == sorted(map(tuple, expected.collect()))


def test_blocks_are_searched_by_keys_that_lose_no_pair(spark):
    df = spark.range(400).selectExpr("id", "concat('name ', lpad(id, 6, '0')) AS t", "cast(id % 40 * 25 + 1 AS double) AS v", "'one' AS k")
    columns = {"t": "text", "v": "number"}
    for method, threshold in (("exact_subset", 0.5), ("fuzzy_subset", 1.0), ("composite", 0.95)):
        pairs = R.similar_pairs(df, "id", columns, threshold, "block", F.col("k"), method)
        keys, sure = R._keys_of(df.withColumn("_blocks", F.array("k")), columns, None, threshold, method, 30.0, 0.99, F.col("_blocks"), lossless=True)
        met = D.blocked_pairs(df.withColumn("_blocks", F.array("k")), "id", keys, []).count()
        assert sure and 0 < met < 400 * 399 / 2 / 4  # all pairs of the block met before
        rows = [(r["id"], r["t"], r["v"]) for r in df.collect()]
        w = {"exact_subset": lambda k, a, b: float(a == b), "fuzzy_subset": lambda k, a, b: float(one(k, a, b) >= 0.9), "composite": one}[method]
        expected = {(p[0], q[0]) for i, p in enumerate(rows) for q in rows[i + 1 :] if (w("text", p[1], q[1]) + w("number", p[2], q[2])) / 2 >= threshold - 1e-9}
        assert {(r["a"], r["b"]) for r in pairs.collect()} == expected
    assert D.threshold_sweep(pairs, [0.95, 0.99, 1.0]).count() <= 3


def test_union_needs_no_blocks_where_keys_lose_no_pair(spark):
    df = spark.range(1000).selectExpr("id", "concat('name ', lpad(id * 37, 6, '0')) AS t", "cast(id AS double) AS v", "'one' AS k")
    got = R.similar_pairs(df, "id", {"t": "text", "v": "number"}, 0.97, "union", F.col("k"), weights={"t": 2.0, "v": 1.0})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "concat(block" not in plan and got.count() >= 0
