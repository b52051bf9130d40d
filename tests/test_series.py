"""STL, unit-root tests and rank correlation against plain Python."""

import math
import random
import statistics

import numpy as np
import pytest

from lumenframe.operators import ordered, stl


# STL by loops over the whole series


def plain_loess(y, w, width, x):
    total = len(y)
    n = min(width, total)
    start = min(max(x - (width - 1) // 2, 0), total - n)
    reach = max(x - start, start + n - 1 - x) + max(0, (width - total) // 2)
    weights = []
    for j in range(start, start + n):
        d = abs(j - x)
        weights.append((0 if d > 0.999 * reach else (1 - (d / reach) ** 3) ** 3 if d > 0.001 * reach else 1.0) * w[j])
    if sum(weights) <= 0:
        return y[min(max(x, 0), total - 1)]
    weights = [v / sum(weights) for v in weights]
    mean = sum(v * j for v, j in zip(weights, range(start, start + n), strict=True))
    spread = sum(v * (j - mean) ** 2 for v, j in zip(weights, range(start, start + n), strict=True))
    if math.sqrt(spread) > 0.001 * (total - 1):
        weights = [v * ((x - mean) / spread * (j - mean) + 1) for v, j in zip(weights, range(start, start + n), strict=True)]
    return sum(v * y[j] for v, j in zip(weights, range(start, start + n), strict=True))


def averages(x, n):
    return [sum(x[i : i + n]) / n for i in range(len(x) - n + 1)]


def plain_stl(y, p, inner, outer, seasonal=7):
    n, low = len(y), p + 1 + (p + 1) % 2 * 0 + (1 if (p + 1) % 2 == 0 else 0)
    wide = math.ceil(1.5 * p / (1 - 1.5 / seasonal))
    wide += wide % 2 == 0
    t, w = [0.0] * n, [1.0] * n
    for k in range(outer + 1):
        for _ in range(inner):
            off = [a - b for a, b in zip(y, t, strict=True)]
            cycle = [0.0] * (n + 2 * p)
            for phase in range(p):
                own, ow = off[phase::p], w[phase::p]
                for at in range(-1, len(own) + 1):
                    cycle[(at + 1) * p + phase] = plain_loess(own, ow, seasonal, at)
            smooth = averages(averages(averages(cycle, p), p), 3)
            s = [c - plain_loess(smooth, [1.0] * n, low, i) for i, c in enumerate(cycle[p:-p])]
            rest = [a - b for a, b in zip(y, s, strict=True)]
            t = [plain_loess(rest, w, wide, i) for i in range(n)]
        r = [abs(a - b - c) for a, b, c in zip(y, t, s, strict=True)]
        six = 6 * statistics.median(r)
        if k < outer:
            w = [1.0 if x <= 0.001 * six else (1 - (x / six) ** 2) ** 2 if x <= 0.999 * six else 0.0 for x in r]
    return t, s, w


def wave(n, p, seed, outliers=0):
    r = random.Random(seed)
    y = [0.05 * i + 3 * math.sin(2 * math.pi * i / p) + r.gauss(0, 0.3) for i in range(n)]
    for _ in range(outliers):
        y[r.randrange(n)] += r.choice([-15, 15])
    return y


@pytest.mark.parametrize(("n", "p", "robust", "size"), [(150, 6, False, 1000), (151, 5, True, 1000), (29, 12, False, 1000), (60, 12, True, 1000), (900, 4, False, 1), (500, 2, True, 1)])
def test_stl_equals_loops(spark, monkeypatch, n, p, robust, size):
    monkeypatch.setattr(ordered, "BLOCK", size)
    y = wave(n, p, n, 5 if robust else 0)
    df = spark.createDataFrame([(i * 10, v) for i, v in enumerate(y)] + [(7, None)], "ts long, value double").repartition(4)
    inner, outer = (1, 2) if robust else (2, 0)
    got = sorted(stl.stl(df, p, inner=inner, outer=outer).collect())
    t, s, w = plain_stl(y, p, inner, outer)
    assert [r["ts"] for r in got] == [10 * i for i in range(n)]
    for name, expected in (("trend", t), ("seasonal", s), ("weight", w)):
        assert np.allclose([r[name] for r in got], expected, atol=1e-9), name
    assert np.allclose([r["trend"] + r["seasonal"] + r["residual"] for r in got], y)


def test_stl_finds_the_parts(spark):
    df = spark.createDataFrame(list(enumerate(wave(300, 12, 1, 6))), "ts long, value double")
    found = stl.stl(df, 12, robust=True)
    one = stl.strengths(found).head()
    assert one["trend_strength"] > 0.5 and one["seasonal_strength"] > 0.4
    rows = sorted(found.collect())
    assert sum(abs(r["seasonal"] - 3 * math.sin(2 * math.pi * r["ts"] / 12)) for r in rows) / 300 < 0.3
    with pytest.raises(ValueError):
        stl.stl(df.limit(20), 12)


def test_two_periods_at_once(spark):
    y = [math.sin(2 * math.pi * i / 6) + 2 * math.cos(2 * math.pi * i / 24) for i in range(240)]
    rows = sorted(stl.multiple_stl(spark.createDataFrame(list(enumerate(y)), "ts long, value double"), [24, 6]).collect())
    assert max(abs(r["value"] - r["trend"] - r["seasonal_6"] - r["seasonal_24"] - r["residual"]) for r in rows) < 1e-9
    assert np.mean([abs(r["seasonal_6"] - math.sin(2 * math.pi * r["ts"] / 6)) for r in rows]) < 0.1
    assert np.mean([abs(r["seasonal_24"] - 2 * math.cos(2 * math.pi * r["ts"] / 24)) for r in rows]) < 0.15


# unit roots by least squares


def plain_adf(x, used=None):
    x = np.array(x)
    n, d = len(x), np.diff(x)

    def fit(lag, start):
        rows = range(start, n - 1)
        a = np.array([[1, x[i], *[d[i - k] for k in range(1, lag + 1)]] for i in rows])
        b = d[start:]
        beta, *_ = np.linalg.lstsq(a, b, rcond=None)
        rest = ((b - a @ beta) ** 2).sum()
        return rest, len(b), beta[1] / math.sqrt(rest / (len(b) - lag - 2) * np.linalg.inv(a.T @ a)[1, 1])

    top = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    if used is None:
        used = min(range(top + 1), key=lambda k: fit(k, top)[1] * math.log(fit(k, top)[0] / fit(k, top)[1]) + 2 * (k + 2))
    _, rows, t = fit(used, used)
    return t, used, rows


def plain_kpss(x, lags=None):
    x = np.array(x) - np.mean(x)
    n = len(x)
    product = lambda k: (x[k:] * x[: n - k]).sum()
    if lags is None:
        top = int(n ** (2 / 9))
        s0 = product(0) / n + sum(2 * product(k) / n for k in range(1, top + 1))
        s1 = sum(2 * k * product(k) / n for k in range(1, top + 1))
        lags = int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3))
    var = (product(0) + 2 * sum((1 - k / (lags + 1)) * product(k) for k in range(1, lags + 1))) / n
    return (np.cumsum(x) ** 2).sum() / n**2 / var, lags


@pytest.mark.parametrize("size", [1, 1000])
@pytest.mark.parametrize("kind", ["noise", "walk", "autoregressive"])
def test_unit_roots_equal_least_squares(spark, monkeypatch, kind, size):
    from lumenframe.operators import stationarity as S

    monkeypatch.setattr(ordered, "BLOCK", size)
    r = random.Random(5)
    x = [100.0]
    for _ in range(399):
        x.append({"noise": 100, "walk": x[-1], "autoregressive": 40 + 0.6 * x[-1]}[kind] + r.gauss(0, 1))
    df = spark.createDataFrame(list(enumerate(x)) + [(1000, None)], "ts long, value double").repartition(3)
    got, (t, lag, n) = S.adf(df).head(), plain_adf(x)
    assert (got["lag"], got["n"], got["stationary"]) == (lag, n, kind != "walk") and got["statistic"] == pytest.approx(t, rel=1e-6)
    assert S.adf(df, 3, choose=False).head()["statistic"] == pytest.approx(plain_adf(x, 3)[0], rel=1e-6)
    got, (s, lags) = S.kpss(df).head(), plain_kpss(x)
    assert got["lags"] == lags and got["statistic"] == pytest.approx(s, rel=1e-6) and got["stationary"] == (kind != "walk")
    assert S.kpss(df, 5).head()["statistic"] == pytest.approx(plain_kpss(x, 5)[0], rel=1e-6)
    assert S.stationarity(df).head()["status"] == ("non-stationary" if kind == "walk" else "stationary")


def test_p_values_at_tabulated_points_and_short_series(spark):
    from lumenframe.operators import stationarity as S

    assert [S.adf_p_value(x) for x in (-3.43, -2.86, -2.57, -25.0, 3.0)] == pytest.approx([0.01, 0.05, 0.1, 0, 1], abs=0.001)
    assert [S.kpss_p_value(x) for x in (0.1, 0.347, 0.463, 0.739, 2.0)] == pytest.approx([0.1, 0.1, 0.05, 0.01, 0.01])
    for rows in ([], [(1, 2.0)], [(i, 5.0) for i in range(50)]):
        df = spark.createDataFrame(rows, "ts long, value double")
        assert S.adf(df).head()["statistic"] is None and S.kpss(df).head()["statistic"] is None and S.stationarity(df).head()["status"] is None


# Kendall by all pairs


def plain_tau(rows):
    sign = lambda a, b: (a > b) - (a < b)
    s = [(sign(p[0], q[0]), sign(p[1], q[1])) for i, p in enumerate(rows) for q in rows[:i]]
    den = math.sqrt(sum(a != 0 for a, _ in s)) * math.sqrt(sum(b != 0 for _, b in s))
    return sum(a * b for a, b in s) / den if den else None


@pytest.mark.parametrize("size", [1, 16, 1000])
def test_kendall_equals_all_pairs(spark, monkeypatch, size):
    from lumenframe.operators import rank

    monkeypatch.setattr(ordered, "BLOCK", size)
    monkeypatch.setattr(rank, "BLOCKS", 12)
    r = random.Random(9)
    for values in (range(1000), range(3), [0, 0, 0, 0, 5]):
        rows = [(r.choice(values), None if r.random() < 0.1 else float(r.choice(values)), -i) for i in range(150)]
        df = spark.createDataFrame(rows, "x int, y double, z int").repartition(3)
        got = {(g["a"], g["b"]): g["tau"] for g in rank.kendall(df, ["x", "y", "z"]).collect()}
        for i, j, key in ((0, 1, ("x", "y")), (0, 2, ("x", "z")), (1, 2, ("y", "z"))):
            assert got[key] == pytest.approx(plain_tau([(p[i], p[j]) for p in rows if p[i] is not None and p[j] is not None]))
    assert rank.kendall_pair(spark.createDataFrame([(1, 2), (1, 3)], "x int, y int"), "x", "y")[:2] == (2, None)
    assert rank.kendall_pair(spark.createDataFrame([], "x int, y int"), "x", "y")[:2] == (0, None)


def test_inversions():
    from lumenframe.operators.rank import inversions

    r = random.Random(1)
    for n in (0, 1, 2, 3, 7, 64, 100):
        x = [r.randrange(max(1, n // 2)) for _ in range(n)]
        assert inversions(np.array(x, np.int64)) == sum(a > b for i, a in enumerate(x) for b in x[i + 1 :])


# Anderson-Darling by its definition


def plain_anderson(x, y):
    pooled, total = sorted(x + y), len(x) + len(y)
    out = 0.0
    for sample in (x, y):
        for z in sorted(set(pooled)):
            here, upto = pooled.count(z), sum(v < z for v in pooled) + pooled.count(z) / 2
            own = sum(v < z for v in sample) + sample.count(z) / 2
            out += here / total * (total * own - upto * len(sample)) ** 2 / (upto * (total - upto) - total * here / 4) / len(sample)
    return out * (total - 1) / total


def test_anderson_darling(spark):
    from lumenframe.operators import drift

    r = random.Random(6)
    x, y = [round(r.gauss(0, 1), 1) for _ in range(70)], [round(r.gauss(0.8, 1), 1) for _ in range(50)]
    frame = lambda v: spark.createDataFrame([(a, 1.0 if a is None else None) for a in v], "v double, w double")
    got = {g["feature"]: g for g in drift.anderson_darling(frame([*x, None]), frame(y), ["v", "w"]).collect()}
    assert got["v"]["a2"] == pytest.approx(plain_anderson(x, y)) and got["v"]["drift"] and got["v"]["p_value"] == 0.001
    same = drift.anderson_darling(frame(x[:35]), frame(x[35:]), ["v"]).head()
    assert not same["drift"] and same["p_value"] > 0.05
    # the sums over harmonic numbers against their definition, and their limits
    h, g = drift._ad_harmonics(40)
    assert h == pytest.approx(sum(1 / i for i in range(1, 40))) and g == pytest.approx(sum(1 / ((40 - i) * j) for i in range(1, 39) for j in range(i + 1, 40)))
    assert drift._ad_harmonics(1_000_000) == pytest.approx(drift._ad_harmonics(1_000_001), abs=2e-4)
    # at a tabulated statistic the p-value is the level
    assert drift.anderson_p_value(1.0, 500, 500)[1] == pytest.approx(0.25, abs=0.01)
