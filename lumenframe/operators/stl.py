"""Seasonal-trend decomposition by local regression (STL), in blocks of an ordered series.

Every step of an inner round, cycle-subseries smoothing, moving averages and
two local regressions, looks only so far around a row. A block therefore
carries a halo as wide as all inner rounds together, computes on it by numpy,
and keeps its own rows; one exchange serves all inner rounds. Robustness weights
need the median residual of the whole series and so a written table a round.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio
from ..sources.tables import materialize
from . import ordered as O

#: Points whose neighbourhoods are held at a time.
POINTS = 4096


@dataclass(frozen=True)
class Windows:
    """Period, and the odd widths of the seasonal, low-pass and trend regressions."""

    period: int
    seasonal: int = 7
    low_pass: int = 0
    trend: int = 0

    def __post_init__(self):
        if self.period < 2 or self.seasonal < 3:
            raise ValueError("STL needs a period of at least 2 and a seasonal window of at least 3")
        odd = lambda x: x + (x % 2 == 0)
        object.__setattr__(self, "seasonal", odd(self.seasonal))
        object.__setattr__(self, "low_pass", odd(self.low_pass or self.period + 1))
        object.__setattr__(self, "trend", odd(self.trend or math.ceil(1.5 * self.period / (1 - 1.5 / self.seasonal))))

    @property
    def reach(self) -> int:
        """Rows around one that an inner round looks at."""
        return (self.seasonal + 3) * self.period + self.low_pass + self.trend


def loess(y: np.ndarray, w: np.ndarray | None, lo: int, total: int, width: int, at: np.ndarray) -> np.ndarray:
    """Local lines at the places ``at`` of a series of ``total`` values, of which y holds those from ``lo`` on.

    The ``width`` nearest values count by the tricube of their distance, times w. NaN where a value is missing that counts.
    """
    n = min(width, total)
    out = np.full(len(at), np.nan)
    for k in range(0, len(at), POINTS):
        x = at[k : k + POINTS]
        start = np.clip(x - (width - 1) // 2, 0, total - n)
        held = (start >= lo) & (start + n <= lo + len(y))
        x, start = x[held], start[held]
        if not len(x):
            continue
        place = start[:, None] + np.arange(n)
        far = np.abs(place - x[:, None])
        reach = np.maximum(x - start, start + n - 1 - x) + max(0, (width - total) // 2)
        reach = reach[:, None].astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(far <= 0.999 * reach, np.where(far > 0.001 * reach, (1 - (far / reach) ** 3) ** 3, 1.0), 0.0)
        if w is not None:
            weight = weight * w[place - lo]
        whole = weight.sum(1)
        weight = weight / np.where(whole > 0, whole, 1)[:, None]
        mean = (weight * place).sum(1)
        spread = (weight * (place - mean[:, None]) ** 2).sum(1)
        slope = np.where((np.sqrt(spread) > 0.001 * (total - 1)) & (spread > 0), (x - mean) / np.where(spread > 0, spread, 1), 0.0)
        weight = weight * (slope[:, None] * (place - mean[:, None]) + 1)
        near = y[np.clip(x, lo, lo + len(y) - 1) - lo]
        got = np.full(len(held), np.nan)
        got[held] = np.where(whole > 0, (weight * y[place - lo]).sum(1), near)
        out[k : k + POINTS] = got
    return out


def rounds(y: np.ndarray, w: np.ndarray | None, trend: np.ndarray, lo: int, total: int, win: Windows, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """(trend, seasonal) after the inner rounds on the values from ``lo`` on; NaN within reach of an end that isn't the series'."""
    p, hi = win.period, lo + len(y)
    kernel = np.convolve(np.convolve(np.full(p, 1 / p), np.full(p, 1 / p)), np.full(3, 1 / 3))
    seasonal = np.zeros_like(y)
    for _ in range(inner):
        off = y - trend
        cycle = np.full(len(y) + 2 * p, np.nan)  # from lo - p on
        for phase in range(p):
            first = -(-(lo - phase) // p)
            own = np.arange(first * p + phase, hi, p)
            count = -(-(total - phase) // p)
            if not len(own):
                continue
            at = np.arange(first - (first == 0), first + len(own) + (first + len(own) == count))
            cycle[at * p + phase - lo + p] = loess(off[own - lo], None if w is None else w[own - lo], first, count, win.seasonal, at)
        smooth = np.convolve(cycle, kernel, "valid")
        places = np.arange(lo, hi)
        seasonal = cycle[p:-p] - loess(smooth, None, lo, total, win.low_pass, places)
        trend = loess(y - seasonal, w, lo, total, win.trend, places)
    return trend, seasonal


def stl(series: DataFrame, period: int, seasonal: int = 7, trend: int = 0, low_pass: int = 0, robust: bool = False, inner: int | None = None, outer: int | None = None) -> DataFrame:
    """(ts, value, trend, seasonal, residual, weight) of a (ts, value) series with at least two periods.

    Rows without a value are left out. robust: 15 outer rounds of 2 inner ones instead of none of 5.
    """
    win = Windows(period, seasonal, low_pass, trend)
    inner = inner if inner is not None else 2 if robust else 5
    outer = outer if outer is not None else 15 if robust else 0
    o = O.ordered(series.where("value IS NOT NULL").select("ts", F.col("value").cast("double").alias("v")), ["ts"])
    if o.n < 2 * period:
        raise ValueError(f"{o.n} values are fewer than two periods of {period}")
    total, halo = o.n, inner * win.reach

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        pos, y, w, t = (table.column(c).to_numpy() for c in ("pos", "v", "w", "t"))
        found, season = rounds(y, w, t, int(pos[0]), total, win, inner)
        out = pa.table({"ts": table.column("ts"), "pos": pos, "v": y, "w": w, "t": found, "s": season, "_range": table.column("_range")})
        return out.filter(table.column("_own"))

    spark, ts = series.sparkSession, series.schema["ts"].dataType.simpleString()
    schema = f"ts {ts}, pos long, v double, w double, t double, s double, _range int"
    state = o.rows.withColumns({"w": F.lit(1.0), "t": F.lit(0.0)})
    for k in range(outer + 1):
        blocks = O.Ordered(state, total, o.starts).blocks(halo, halo)
        state = materialize(blocks.groupBy("_block").applyInArrow(block, schema), "stl")
        if k < outer:
            r = F.abs(F.col("v") - F.col("t") - F.col("s"))
            by_size = O.ordered(state.select(r.alias("r")), ["r"])
            middle = [x["r"] for x in by_size.rows.where(F.col("pos").isin((total - 1) // 2, total // 2)).collect()]
            six = 6 * sum(middle) / len(middle)
            part = F.when(r <= 0.001 * six, 1.0).when(r <= 0.999 * six, (1 - (r / six) ** 2) ** 2).otherwise(0.0) if six else F.lit(1.0)
            state = state.withColumn("w", part).drop("s")
    return state.select("ts", F.col("v").alias("value"), F.col("t").alias("trend"), F.col("s").alias("seasonal"), (F.col("v") - F.col("t") - F.col("s")).alias("residual"), F.col("w").alias("weight"))


def multiple_stl(series: DataFrame, periods: list[int], rounds: int = 2) -> DataFrame:
    """(ts, value, trend, seasonal_<p> of every period, residual): STL of one period after another, on what the others leave."""
    periods = sorted(periods)
    held = series.where("value IS NOT NULL").select("ts", F.col("value").cast("double").alias("value"))
    found: dict[int, DataFrame] = {}
    for _ in range(rounds if len(periods) > 1 else 1):
        for k, p in enumerate(periods):
            left, rest = held, F.col("value")
            for q, s in found.items():
                if q != p:
                    left = left.join(s.select("ts", F.col("seasonal").alias(f"_s{q}")), "ts")
                    rest = rest - F.col(f"_s{q}")
            found[p] = stl(left.select("ts", rest.alias("value")), p, 7 + 4 * (k + 1) if len(periods) > 1 else 7)
    out = held
    for p in periods:
        own = found[p].select("ts", F.col("seasonal").alias(f"seasonal_{p}"), *([F.col("trend")] if p == periods[-1] else []))
        out = out.join(own, "ts")
    parts = [F.col(f"seasonal_{p}") for p in periods]
    residual = F.col("value") - F.col("trend")
    for s in parts:
        residual = residual - s
    return out.select("ts", "value", "trend", *[f"seasonal_{p}" for p in periods], residual.alias("residual"))


def strengths(decomposed: DataFrame) -> DataFrame:
    """One row: how much of the variance beside the residual is trend and season, from 0 to 1."""
    one = decomposed.agg(*[F.var_pop(c).alias(n) for n, c in (("r", F.col("residual")), ("t", F.col("trend") + F.col("residual")), ("s", F.col("seasonal") + F.col("residual")))])
    part = lambda c: F.greatest(F.lit(0.0), 1 - ratio(F.col("r"), F.col(c)))
    return one.select(part("t").alias("trend_strength"), part("s").alias("seasonal_strength"))
