"""Kendall's rank correlation of any number of rows, by exact counts of inversions over blocks.

Rows get their number by x (then y) and again by y (then the first number), two
orders without ties, so pairs tied in x or y never count as inverted. Pairs of
one x-block are counted inside it, pairs of one y-block but different x-blocks
inside that, all others from a table of counts per pair of blocks.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered as O

#: Blocks along each order at most; the table of counts has at most their square, on the driver.
BLOCKS = 1024


def inversions(x: np.ndarray) -> int:
    """Pairs of places i < j with x[i] > x[j], for numbers from 0 on; merges of growing sorted runs."""
    n = len(x)
    if n < 2:
        return 0
    size = 1 << (n - 1).bit_length()
    top = int(x.max()) + 1
    runs = np.concatenate([x.astype(np.int64), np.full(size - n, top, np.int64)])
    count, width = 0, 1
    while width < size:
        halves = runs.reshape(-1, 2, width)
        base = np.arange(len(halves), dtype=np.int64)[:, None] * (top + 1)
        left, right = (halves[:, 0] + base).ravel(), (halves[:, 1] + base).ravel()
        upto = np.searchsorted(left, right, "right") - np.repeat(np.arange(len(halves)) * width, width)
        count += int((width - upto).sum())
        width *= 2
        runs = np.sort(runs.reshape(-1, width), axis=1).ravel()
    return count


def _inverted(o: O.Ordered) -> int:
    """Inversions between the numbers p and pos of a table ordered by pos."""
    size = max(O.BLOCK, -(-o.n // BLOCKS))
    rows = o.rows.select("p", F.col("pos").alias("q"), F.expr(f"p div {size}").alias("pb"), F.expr(f"pos div {size}").alias("qb"))

    def counted(sort: str, take: str):
        def run(table: pa.Table) -> pa.Table:
            return pa.table({"n": [inversions(table.sort_by(sort).column(take).to_numpy())]})

        return run

    inside = rows.groupBy("pb").applyInArrow(counted("p", "q"), "n long")
    beside = rows.groupBy("qb").applyInArrow(counted("q", "pb"), "n long")
    found = inside.unionAll(beside).agg(F.sum("n")).head()[0] or 0
    cells = rows.groupBy("pb", "qb").agg(F.count("*").alias("n")).toPandas()
    blocks = -(-o.n // size)
    table = np.zeros((blocks, blocks), np.int64)
    table[cells["pb"], cells["qb"]] = cells["n"]
    before = np.zeros(blocks, np.int64)  # rows of the x-blocks so far, by y-block
    for row in table:
        above = before[::-1].cumsum()[::-1]
        found += int((row[:-1] * above[1:]).sum())
        before += row
    return found


def _ties(rows: DataFrame, *columns: str) -> int:
    n = F.col("_n").cast("decimal(38,0)")
    return int(rows.groupBy(*columns).agg(F.count("*").alias("_n")).agg(F.sum(n * (n - 1) / 2)).head()[0] or 0)


def kendall_pair(df: DataFrame, x: str, y: str) -> tuple[int, float | None, float | None]:
    """(rows, tau-b, two-sided p-value by the normal approximation) over rows where both are present; NULL without variation."""
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y")).na.drop()
    by_x = O.ordered(rows, ["x", "y"])
    n = by_x.n
    held = by_x.rows.select("x", "y", F.col("pos").alias("p"))
    total = n * (n - 1) // 2
    tx, ty, txy = _ties(held, "x"), _ties(held, "y"), _ties(held, "x", "y")
    if total in (tx, ty):
        return n, None, None
    over = total - tx - ty + txy - 2 * _inverted(O.ordered(held.select("p", "y"), ["y", "p"]))
    tau = over / math.sqrt(total - tx) / math.sqrt(total - ty)
    z = 3 * tau * math.sqrt(n * (n - 1)) / math.sqrt(2 * (2 * n + 5))
    return n, tau, 2 * NormalDist().cdf(-abs(z))


def kendall(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, tau, p_value) of every pair of columns, a before b."""
    found = [(a, b, *kendall_pair(df, a, b)) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.sparkSession.createDataFrame(found, "a string, b string, n long, tau double, p_value double")
