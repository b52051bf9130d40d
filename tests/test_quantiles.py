"""Exact quantiles against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import quantiles

PROBS = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize(("buckets", "few"), [(1024, 512), (64, 4)])
def test_exact_quantiles(spark, monkeypatch, buckets, few):
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    monkeypatch.setattr(quantiles, "FEW", few)
    r = random.Random(4)
    n = 400
    columns = {
        "even": [r.uniform(-1, 1) for _ in range(n)],
        "ties": [float(r.choice([1, 1, 1, 2, 50])) for _ in range(n)],
        "wide": [r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300) for _ in range(n)],
        "one": [3.0] * n,
        "few": [None] * (n - 2) + [1.0, 2.0],
        "none": [None] * n,
        "nan": [math.nan if i % 3 else float(i) for i in range(n)],
        "ends": [math.inf if i % 5 == 0 else -math.inf if i % 5 == 1 else float(i) for i in range(n)],
    }
    rows = list(zip(*columns.values(), strict=True))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(3)
    got = quantiles.exact_quantiles(df, {c: F.col(c) for c in columns}, PROBS)
    for c, v in columns.items():
        known = sorted(x for x in v if x is not None and not math.isnan(x))
        if not known:
            assert got[c] == [None] * len(PROBS)
            continue
        if c == "ends":
            assert got[c][0] == got[c][1] == -math.inf and got[c][-1] == math.inf and got[c][4] == pytest.approx(np.median(known))
            continue
        assert got[c] == pytest.approx(np.quantile(known, PROBS).tolist(), rel=1e-12), c
    assert quantiles.exact_quantiles(df.limit(0), {"even": F.col("even")}, [0.5]) == {"even": [None]}
