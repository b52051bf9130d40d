"""Numbered ranges, halo blocks and what runs on them, against plain Python."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import modeling, quality, timeseries
from lumenframe.operators.ordered import by_pos, ordered


@pytest.fixture
def rows():
    r = random.Random(3)
    return [(i, r.choice([None, *range(40)]), r.choice("ab"), None if r.random() < 0.4 else r.uniform(-5, 5)) for i in range(300)]


SCHEMA = "id long, o int, g string, v double"


def test_numbers_are_dense_and_in_order(spark, rows):
    o = ordered(spark.createDataFrame(rows, SCHEMA).repartition(5), ["o"], ranges=7)
    got = o.rows.orderBy("pos").collect()
    assert o.n == 300 and [r["pos"] for r in got] == list(range(300))
    assert [r["o"] for r in got] == sorted((x[1] for x in rows), key=lambda x: (x is not None, x or 0))
    assert sorted(r["id"] for r in got) == list(range(300))
    for k in (1, 4, 7, 299, 300, 301):
        parts = [r["t"] for r in o.rows.select("pos", o.ntile(k).alias("t")).orderBy("pos").collect()]
        assert parts == [i + 1 for i, p in enumerate(np.array_split(np.arange(300), k)) for _ in p]
    run = {r["pos"]: r["run_v"] for r in o.running("v").collect()}
    assert [run[i] for i in range(300)] == pytest.approx(np.cumsum([r["v"] or 0 for r in got]))


@pytest.mark.parametrize("size", [1, 10, 64, 1000])
def test_windows_over_blocks_equal_windows_over_everything(spark, rows, size):
    o = ordered(spark.createDataFrame(rows, SCHEMA), ["id"], ranges=3)
    found = o.blocks(3, 5, size).withColumn("back", F.lag("v", 3).over(by_pos())).withColumn("sum", F.sum("v").over(by_pos().rowsBetween(-2, 5))).where("_own")
    got = sorted((r["id"], r["back"], r["sum"]) for r in found.collect())
    assert [g[:2] for g in got] == [(i, rows[i - 3][3] if i >= 3 else None) for i in range(300)]
    for i, _, s in got:
        near = [x[3] for x in rows[max(0, i - 2) : i + 6] if x[3] is not None]
        assert s == (pytest.approx(sum(near)) if near else None)


def test_empty_order(spark):
    o = ordered(spark.createDataFrame([], SCHEMA), ["o"])
    assert o.n == 0 and o.blocks(2, 2).count() == 0 and o.running("v").count() == 0


@pytest.mark.parametrize("groups", [[], ["g"]])
@pytest.mark.parametrize("gap", [0.4, 0.97])
def test_interpolation_over_ranges(spark, groups, gap):
    r = random.Random(int(gap * 100))
    data = [(i, r.choice("aabc") if groups else "x", None if r.random() < gap else float(r.randrange(100))) for i in range(200)]
    data.append((500, None, 7.0))
    df = spark.createDataFrame(data, "id long, g string, v double").repartition(4)
    got = {x["id"]: x["v"] for x in quality.impute(df, ["v"], "interpolate", order_by=["id"], partition_by=groups).collect()}
    for g in {x[1] for x in data} if groups else {0}:
        own = [x for x in data if not groups or x[1] == g]
        known = [(k, x[2]) for k, x in enumerate(own) if x[2] is not None]
        for k, (i, _, v) in enumerate(own):
            if not known or k < known[0][0]:
                assert got[i] is None
            else:
                assert got[i] == pytest.approx(np.interp(k, [a for a, _ in known], [b for _, b in known]) if v is None else v)


def test_interpolation_has_no_frame_to_the_last_row(spark):
    """Such a frame is counted anew for every row, which takes the square of a range's rows."""
    df = spark.range(300).selectExpr("id", "if(id % 7 = 0, null, id * 1.0) AS v")
    plan = quality.impute(df, ["v"], "interpolate", order_by=["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "unboundedfollowing" not in plan


def test_series_plans_have_no_window_over_everything(spark, rows):
    df = spark.createDataFrame([(i, x[3] or 1.0, float(i % 7)) for i, x in enumerate(rows)], "ts long, value double, x double")
    for plan in (timeseries.autocorrelation(df, 3), timeseries.decompose(df, 6), timeseries.trend(df), timeseries.variance_stability(df), timeseries.forecast_baselines(df), modeling.select_by_lag(df, ["x"], "value", ["ts"], 2), modeling.walk_forward(df, ["ts"]), quality.impute(df, ["value"], "interpolate", order_by=["ts"])):
        assert "Window" not in plan._jdf.queryExecution().executedPlan().toString() or not re.search(r"Window \[[^\n]*windowspecdefinition\((?!_block|_range|g#)", plan._jdf.queryExecution().optimizedPlan().toString())


def test_periods_of_a_wave(spark):
    wave = spark.createDataFrame([(i, math.sin(2 * math.pi * i / 12)) for i in range(240)], "ts long, value double")
    assert [r["lag"] for r in timeseries.candidate_periods(timeseries.autocorrelation(wave, 30)).orderBy("lag").collect()] == [12, 24]
    assert 1 in [r["lag"] for r in timeseries.suggest_lags(wave, 12).collect()]
