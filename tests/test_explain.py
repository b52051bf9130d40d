"""Shapley values of tree models against the models themselves and against all subsets."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml import classification, regression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lumenframe.operators import explain as E

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    data = [(i, *(r.choice([r.gauss(0, 1), 0.5, -1.0]) for _ in FEATURES)) for i in range(300)]
    data = [(*x, x[1] * 2 + (3.0 if x[2] > 0 and x[3] > 0 else 0) + r.gauss(0, 0.1), float(x[1] + x[2] > 0)) for x in data]
    df = spark.createDataFrame(data, "id long, a double, b double, c double, d double, y double, k double")
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df).cache()


def worth(node, x, known, value):
    """What a tree expects when only the known features are: other splits go both ways, by training rows."""
    if node.numDescendants() == 0:
        return value(node)
    f, left, right = node.split().featureIndex(), node.leftChild(), node.rightChild()
    if f in known:
        return worth(left if x[f] <= node.split().threshold() else right, x, known, value)
    n = node.impurityStats().rawCount()
    return sum(c.impurityStats().rawCount() / n * worth(c, x, known, value) for c in (left, right))


def by_subsets(model, x, value):
    d = len(x)
    trees = [t._java_obj.rootNode() for t in getattr(model, "trees", [model])]
    whole = {s: sum(worth(t, x, s, value) for t in trees) / len(trees) for k in range(d + 1) for s in itertools.combinations(range(d), k)}
    out = []
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        out.append(sum(math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) * (whole[tuple(sorted((*s, i)))] - whole[s]) for k in range(d) for s in itertools.combinations(rest, k)))
    return out


@pytest.mark.parametrize("kind", ["tree", "forest", "classes"])
def test_shapley_values_equal_all_subsets(rows, kind):
    model = {
        "tree": lambda: regression.DecisionTreeRegressor(labelCol="y", maxDepth=4),
        "forest": lambda: regression.RandomForestRegressor(labelCol="y", maxDepth=3, numTrees=3, seed=1),
        "classes": lambda: classification.RandomForestClassifier(labelCol="k", maxDepth=3, numTrees=3, seed=1),
    }[kind]().fit(rows)
    value = (lambda n: list(n.impurityStats().stats())[1] / sum(n.impurityStats().stats())) if kind == "classes" else (lambda n: n.prediction())
    some = rows.limit(6).collect()
    got = {r["id"]: r for r in E.shap_values(rows, "id", FEATURES, model).collect()}
    for r in some:
        x = [r[f] for f in FEATURES]
        assert [got[r["id"]][f"shap_{f}"] for f in FEATURES] == pytest.approx(by_subsets(model, x, value), abs=1e-9)


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted", "classes", "boosted classes"])
def test_base_and_values_add_up_to_the_prediction(rows, kind):
    model = {
        "tree": lambda: regression.DecisionTreeRegressor(labelCol="y", maxDepth=6),
        "forest": lambda: regression.RandomForestRegressor(labelCol="y", maxDepth=5, numTrees=8, seed=1),
        "boosted": lambda: regression.GBTRegressor(labelCol="y", maxDepth=3, maxIter=8, seed=1),
        "classes": lambda: classification.RandomForestClassifier(labelCol="k", maxDepth=5, numTrees=8, seed=1),
        "boosted classes": lambda: classification.GBTClassifier(labelCol="k", maxDepth=3, maxIter=5, seed=1),
    }[kind]().fit(rows)
    says = F.col("prediction") if "classes" not in kind else vector_to_array("probability")[1] if kind == "classes" else vector_to_array("rawPrediction")[1]
    told = model.transform(rows).select("id", says.alias("says"))
    got = E.shap_values(rows, "id", FEATURES, model).join(told, "id").collect()
    assert len(got) == 300
    assert np.allclose([r["explained"] for r in got], [r["says"] for r in got]) or kind == "boosted classes" and np.allclose([2 * r["explained"] for r in got], [r["says"] for r in got])
    assert np.allclose([r["base"] + sum(r[f"shap_{f}"] for f in FEATURES) for r in got], [r["explained"] for r in got])


def test_importance_cohorts_and_odd_rows(spark, rows):
    model = regression.RandomForestRegressor(labelCol="y", maxDepth=4, numTrees=5, seed=1).fit(rows)
    values = E.shap_values(rows, "id", FEATURES, model)
    found = {r["feature"]: r["importance"] for r in E.shap_importance(values, FEATURES).collect()}
    assert max(found, key=found.get) == "a" and found["d"] < 0.2 * found["a"]
    groups = E.shap_cohorts(values.withColumn("half", F.col("id") % 2), "half", FEATURES).collect()
    assert sum(g["n"] for g in groups) == 300
    odd = spark.createDataFrame([(1, None, float("nan"), 1.0, float("inf"))], "id long, a double, b double, c double, d double")
    r = E.shap_values(odd, "id", FEATURES, model).head()
    assert math.isfinite(r["explained"]) and E.shap_values(odd.limit(0), "id", FEATURES, model).count() == 0
