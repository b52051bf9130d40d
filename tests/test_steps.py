"""Operators without SQL: trackers, pipelines of steps, projections, embeddings, bins, lags, trained models."""

import math
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from lumenframe.functions.expr import pairs_within, with_group_extremes
from lumenframe.operators import dedup, drift, features, modeling, pipeline, quality, report, stats, text, timeseries, types
from lumenframe.sources import tables


def test_tracker_over_several_steps(spark):
    df = spark.createDataFrame([(i, f"t{i % 4}") for i in range(8)], "id long, text string")
    first = dedup.hash_groups(df, "id", "text")
    second = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2)], "id long, group_id long")
    tracker = dedup.DedupTracker(df, "id").update(first).update(second)
    assert dict(tracker.map.collect()) == {i: i % 4 // 2 * 2 for i in range(8)}
    result = spark.createDataFrame([(0, 1.5), (2, 2.5)], "id long, score double")
    assert dict(tracker.map_to_original(result).select("id", "score").collect()) == {i: 1.5 if i % 4 < 2 else 2.5 for i in range(8)}
    tracker.update_kept(result.where("id = 0"))
    full = tracker.full_result(df, result, {"score": -1.0}).orderBy("id").collect()
    assert [r["score"] for r in full] == [1.5, 1.5, -1.0, -1.0] * 2 and len(full) == 8


def test_groups_and_pairs_of_hot_keys(spark, monkeypatch):
    rows = spark.range(300).select("id", F.when(F.col("id") < 250, 0).otherwise(F.col("id")).alias("k"))
    got = with_group_extremes(rows, ["k"], F.col("id"), {"lo": ("min", F.col("id")), "hi": ("max", F.col("id"))}).collect()
    assert len(got) == 300 and all((r["lo"], r["hi"]) == ((0, 249) if r["id"] < 250 else (r["id"], r["id"])) for r in got)
    for block in (7, 1000):
        pairs = pairs_within(rows, "id", ["k"], block)
        assert pairs.count() == 250 * 249 // 2 and pairs.where("a >= b").isEmpty()


def test_simhash_pairs_equal_all_pairs(spark):
    r = random.Random(4)
    base = [r.getrandbits(63) for _ in range(30)]
    values = base + [x ^ sum(1 << b for b in r.sample(range(63), r.randint(1, 5))) for x in base for _ in range(3)]
    hashes = spark.createDataFrame(list(enumerate(values)), "id long, simhash long")
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    ids = sorted(first.values())
    expected = {(a, b, d) for a in ids for b in ids if a < b and (d := (values[a] ^ values[b]).bit_count()) <= 3}
    assert {tuple(x) for x in dedup.simhash_pairs(hashes, "id").collect()} == expected and expected


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i + 1, i) for i in range(60)] + [(100 + i, 100) for i in range(1, 200)]
    got = dict(dedup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(200)}


def test_flags_with_nulls_in_the_subset(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "x"), (3, "a", "x"), (4, None, "y")], "id long, a string, b string")
    got = {r["id"]: (r["is_duplicate"], r["group_id"]) for r in quality.flag_duplicates(df, ["a", "b"], ["id"]).collect()}
    assert got == {1: (False, 1), 2: (True, 1), 3: (False, 3), 4: (False, 4)}


def test_text_dispatcher_and_columns(spark):
    df = spark.createDataFrame([(1, "One  text here"), (2, "one text here"), (3, "one text hers"), (4, "quite another"), (5, None)], "id long, text string")
    flags = lambda m, **p: {r["id"] for r in dedup.flag_text_duplicates(df, "id", "text", m, **p).where("is_duplicate").collect()}
    assert flags("hash") == {2} and flags("ngram") == {2} and flags("fuzzy") == {2, 3} and flags("lsh", threshold=0.6, num_perm=60) == {2, 3}
    assert {r["id"] for r in dedup.deduplicate_texts(df, "id", "text", "fuzzy").collect()} == {1, 4, 5}
    votes = dedup.add_duplicate_columns(df, "id", "text", {"hash": {}, "fuzzy": {}})
    assert {r["id"]: r["duplicate_votes"] for r in votes.collect()} == {1: 0, 2: 2, 3: 1, 4: 0, 5: 0}
    with pytest.raises(ValueError):
        dedup.flag_text_duplicates(df, "id", "text", "guess")


def test_projection_pairs(spark):
    r = random.Random(1)
    points = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(40)]
    points += [(100 + i, [x + 0.01 for x in v]) for i, v in points[:10]]
    got = {(x["a"], x["b"]) for x in dedup.projection_pairs(spark.createDataFrame(points, "id long, v array<double>"), "id", "v", 0.2).collect()}
    assert got == {(i, 100 + i) for i in range(10)}


def test_pipeline_is_saved_and_loaded(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), "ab"[i % 2]) for i in range(10)], "id long, x double, g string")
    made = pipeline.make_pipeline(pipeline.step("bins", "features.binned", column="x", n_bins=2), pipeline.step("first", "quality.remove_duplicates", subset=["x_bin", "g"], order_by=["id"]))
    model = made.fit(df)
    model.save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert sorted(r["id"] for r in again.transform(df).collect()) == sorted(r["id"] for r in model.transform(df).collect()) == [0, 1, 5, 6]
    found = pipeline.outputs(again, df)
    assert list(found) == ["bins", "first"] and found["bins"].count() == 10


def test_lags_of_an_autoregression(spark):
    r, x, values = random.Random(3), 0.0, []
    for i in range(400):
        x = 0.7 * x + r.gauss(0, 1)
        values.append((i, x))
    series = spark.createDataFrame(values, "ts long, value double")
    got = {p["lag"]: p["pacf"] for p in timeseries.partial_autocorrelation(series, 6).collect()}
    assert abs(got[1] - 0.7) < 0.1 and all(abs(got[k]) < 0.15 for k in range(2, 7))
    assert timeseries.suggest_lags(series, 6).first()["lag"] == 1
    wave = spark.createDataFrame([(i, math.sin(2 * math.pi * i / 12) + 0.01 * (i % 5)) for i in range(240)], "ts long, value double")
    assert 12 in timeseries.suggest_windows(wave, 30)


def test_mutual_information_bounds(spark):
    df = spark.createDataFrame([(i % 4, "abcd"[i % 4], i // 4 % 2, float(i)) for i in range(64)], "x int, same string, other int, wide double")
    one = modeling.mutual_information(df, "x", "same").head()
    assert one["mi"] == pytest.approx(math.log(4)) and one["nmi"] == pytest.approx(1)
    assert modeling.mutual_information(df, "other", "same").head()["mi"] == pytest.approx(0, abs=1e-12)
    kept, found = modeling.select_features(df, ["x", "other"], "same", "mutual_information", k=1)
    assert kept.columns == ["x", "same", "wide"] and found.first()["feature"] == "x"


def test_cross_validated_training(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(i, float(i % 7), r.random(), 3.0 * (i % 7) + 1 + r.gauss(0, 0.01)) for i in range(200)], "id long, a double, b double, y double")
    model, table = modeling.train_cross_validated(df, "id", "y", ["a", "b"], grid={"regParam": [0.0, 5.0]})
    scores = {x["params"]: x["rmse"] for x in table.collect()}
    assert scores["regParam=0.0"] < 0.05 < scores["regParam=5.0"]
    assert model.transform(df).select(F.abs(F.col("prediction") - F.col("y")).alias("e")).agg(F.max("e")).head()[0] < 0.1


def test_scores_bins_and_embeddings(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i, float(i % 3)) for i in range(30)], "id long, a double, b double, c double")
    scores, loadings = stats.pca_scores(df, "id", ["a", "b", "c"], 2)
    assert scores.count() == 30 and loadings.columns == ["feature", "pc1", "pc2"]
    first = {r["feature"]: abs(r["pc1"]) for r in loadings.collect()}
    assert first["a"] == pytest.approx(first["b"], abs=1e-6) and first["a"] > first["c"]
    points = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 1.1, 0.9, 9.0, 9.1, 20.0, 20.2, None])], "id long, v double")
    cells = {r["id"]: r["v_bin"] for r in features.binned(points, "v", 3, "kmeans").collect()}
    assert cells == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2, 7: None}
    docs = spark.createDataFrame([(i, "red green blue colour paint " * 5 if i % 2 else "one two three number count " * 5) for i in range(40)] + [(99, None)], "id long, text string")
    vectors, words = text.document_embeddings(docs, "id", "text", 8, iterations=3)
    assert vectors.count() == 41 and words.count() == 10 and {len(r["embedding"]) for r in vectors.collect()} == {8}


def test_no_feature_vanishes_and_no_digit_is_lost(spark):
    a, b = (spark.range(100).select(F.concat(F.lit(p), F.col("id")).alias("v"), F.lit("x").alias("w")) for p in "ab")
    got = {r["feature"]: r["drift"] for r in drift.detect_all_drift(a, b, [], ["v", "w"]).collect()}
    assert got == {"v": None, "w": False}
    df = spark.createDataFrame([(0.5, 0.1), (2.0, 16777217.0)], "half double, money double")
    assert {r["column_name"]: r["best_type"] for r in types.best_types(df).collect()} == {"half": "float", "money": "double"}


def test_shared_folder(spark, monkeypatch):
    assert tables.shared_folder(spark) == tables.shared_folder(spark)

    class Far:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda *_: None)}), Far()

    with pytest.raises(ValueError):
        tables.shared_folder(Session())


def test_exploration_in_one_call(spark):
    df = spark.sql("SELECT id, double(id % 5) AS x, double(id % 5) * 2 + id % 2 AS y, if(id % 2 = 0, 'even', 'odd') AS g, timestamp'2024-01-01' + make_interval(0, 0, 0, int(id)) AS at FROM range(50)")
    parts = report.eda_parts(df, "y")
    assert {"Missing values", "Numbers", "Values of g", "Range of at", "Against y", "Correlation", "Principal components"} == set(parts)
    assert {r["feature"]: r["measure"] for r in parts["Against y"].collect()} == {"id": "pearson", "x": "pearson", "g": "eta_squared"}
    assert "## Against y" in report.eda_report(df, "y") and "<h2>Numbers</h2>" in report.eda_report(df, form="html")


def test_chunks_and_local_tables(spark):
    df = spark.range(25).select("id")
    assert [len(c) for c in tables.iterate_chunks(df, 10)] == [10, 10, 5]
    total = tables.process_chunks(df, lambda p: p[["id"]].sum().to_frame().T, "id long", lambda t: t.agg(F.sum("id").alias("id")))
    assert total.head()["id"] == 300
    assert tables.frame_kind(df) == "spark" and tables.frame_kind(tables.to_local(df)) == "pandas" and tables.frame_kind(tables.to_local(df, "arrow")) == "arrow"
    with pytest.raises(ValueError):
        tables.to_local(df, max_rows=3)


def test_markup_round_trip():
    text = "a_b $x$ {50%} back\\slash ^"
    assert report.unescape_markup(report.escape_markup(text)) == text and "\\$" in report.escape_markup(text)


def test_drift_infers_types(spark):
    a = spark.sql("SELECT double(id) AS x, if(id % 2 = 0, 'a', 'b') AS g, timestamp'2024-01-01' + make_interval(0, 0, 0, int(id)) AS at FROM range(60)")
    b = spark.sql("SELECT double(id) + 40 AS x, if(id % 10 = 0, 'a', 'b') AS g, timestamp'2024-06-01' + make_interval(0, 0, 0, int(id)) AS at FROM range(60)")
    got = {r["feature"]: (r["kind"], r["drift"]) for r in drift.detect_all_drift(a, b).collect()}
    assert got == {"x": ("numeric", True), "g": ("categorical", True), "at": ("datetime", True)}


def test_projections_lose_no_pair(spark):
    r = random.Random(2)
    points = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(120)] + [(500, None), (501, [None] * 6)]
    points += [(200 + i, list(points[0][1])) for i in range(9)]
    df = spark.createDataFrame(points, "id long, v array<double>")
    dist = lambda p, q: sum((x - y) ** 2 for x, y in zip(p, q, strict=True)) ** 0.5
    known = [p for p in points if p[0] not in (500, 501)]
    expected = {(p[0], q[0]): dist(p[1], q[1]) for p in known for q in known if p[0] < q[0] and dist(p[1], q[1]) <= 1.5}
    for length, block in ((0.1, 7), (50.0, 2000)):
        got = dedup.projection_pairs(df, "id", "v", 1.5, bucket_length=length, tables=2, block=block).collect()
        assert {(x["a"], x["b"]): x["distance"] for x in got} == pytest.approx(expected) and len(got) == len(expected) > 50


def test_equal_texts_are_worked_out_once(spark):
    df = spark.range(400).selectExpr("id", "if(id % 5 = 4, null, concat('some text ', id % 4)) AS t")
    for fn, n in ((dedup.minhash, 4), (dedup.minhash_exact, 5), (dedup.ngram_fingerprints, 5)):
        seen = []
        real = dedup._by_text

        def spy(df, id_col, text, of_texts, real=real, seen=seen):
            return real(df, id_col, text, lambda texts: (seen.append(texts.count()), of_texts(texts))[1])

        dedup._by_text = spy
        try:
            rows = fn(df, "id", "t").collect()
        finally:
            dedup._by_text = real
        assert seen == [5] and len({str(r[1]) for r in rows}) == n and len(rows) == (320 if fn is dedup.minhash else 400)


def test_word_vectors_are_learned_in_several_tasks(spark, monkeypatch):
    from pyspark.ml import feature

    from lumenframe.operators import text

    asked, real = [], feature.Word2Vec.fit
    monkeypatch.setattr(feature.Word2Vec, "fit", lambda self, x: (asked.append(self.getNumPartitions()), real(self, x))[1])
    monkeypatch.setattr(text, "TRAINING_PART", 100)
    df = spark.range(40).selectExpr("id", "'one word and another word' AS t")
    assert text.document_embeddings(df, "id", "t", size=4)[0].count() == 40 and asked == [1 + 40 * 25 // 100]


def test_mutual_information_ties_go_by_name(spark):
    rows = [(x, y, 0 if (x, y) == (1, 1) and i == 0 else x, y) for x in (0, 1) for y in (0, 1) for i in range(1000)]
    df = spark.createDataFrame([(a, b, str(y)) for a, _, b, y in rows], "plain long, off long, y string")
    pick = lambda **p: modeling.select_by_mutual_information(df, ["plain", "off"], "y", k=1, **p).first()["feature"]
    assert pick(digits=5) == "off" and pick() == "off"
    renamed = df.withColumnsRenamed({"off": "z_off"})
    assert modeling.select_by_mutual_information(renamed, ["plain", "z_off"], "y", k=1, digits=5).first()["feature"] == "plain"
