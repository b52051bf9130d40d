"""Exact quantiles of any number of rows: the wanted ranks are closed in on by counts, many columns at once.

A round counts, for every bracket that still holds a wanted rank, its values in
BUCKETS equal parts, with each part's least and greatest value; the part with
the rank is the next bracket. Counts meet by map-side combination, at most
BUCKETS rows a bracket. When a bracket holds few values they are fetched, so a
billion rows take two or three scans, and no task holds a column's values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
#: A bracket of at most so many values is fetched.
FEW = 512


def exact_quantiles(df: DataFrame, values: dict[str, Column], probs: list[float]) -> dict[str, list[float | None]]:
    """name -> its quantiles between the two nearest values by straight lines; NULL and NaN don't count, without values None.

    Brackets of infinite ends can't be cut into parts, so infinite values are only counted.
    """
    names = list(values)
    double = [values[n].cast("double") for n in names]
    clean = [F.when(~F.isnan(v) & v.isNotNull(), v) for v in double]
    finite = [F.when(F.abs(v) < float("inf"), v) for v in clean]
    first = df.agg(*[f.alias(f"{k}_{i}") for i, (c, v) in enumerate(zip(clean, finite, strict=True)) for k, f in (("n", F.count(v)), ("lo", F.min(v)), ("hi", F.max(v)), ("down", F.count(F.when(c == float("-inf"), 1))), ("up", F.count(F.when(c == float("inf"), 1))))]).head()
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), v.alias("v")) for i, v in enumerate(finite)])).alias("s")).select("s.*").where("v IS NOT NULL") if names else None
    found: dict[tuple[int, int], float] = {}  # (column, rank among its finite values) -> value
    open_: dict[tuple[int, float, float], tuple[int, int, set[int]]] = {}  # (column, least, greatest) -> (values before, values, ranks)
    places = []
    for i in range(len(names)):
        n, down, up = (first[f"{k}_{i}"] for k in ("n", "down", "up"))
        at = [q * (n + down + up - 1) for q in probs] if n + down + up else []
        places.append(at)
        ranks = {r - down for p in at for r in (math.floor(p), math.ceil(p)) if 0 <= r - down < n}
        if ranks:
            open_[i, first[f"lo_{i}"], first[f"hi_{i}"]] = (0, n, ranks)
    while open_:
        for (i, lo, hi), (_, _, ranks) in list(open_.items()):
            if lo == hi:
                found |= {(i, r): lo for r in ranks}
                del open_[i, lo, hi]
        few = [b for b, (_, n, _) in open_.items() if n <= FEW]
        if few:
            for row in _within(long, few).groupBy("b").agg(F.sort_array(F.collect_list("v")).alias("v")).collect():
                before, _, ranks = open_.pop(few[row["b"]])
                found |= {(few[row["b"]][0], r): row["v"][r - before] for r in ranks}
        wide = list(open_)
        if not wide:
            break
        part = F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS)).cast("int")
        counted = _within(long, wide).groupBy("b", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect()
        held, open_ = open_, {}
        at = {b: held[b][0] for b in wide}
        for row in sorted(counted, key=lambda r: (r["b"], r["part"])):
            b = wide[row["b"]]
            ranks = {r for r in held[b][2] if at[b] <= r < at[b] + row["n"]}
            if ranks:
                open_[b[0], row["least"], row["most"]] = (at[b], row["n"], ranks)
            at[b] += row["n"]
    out = {}
    for i, name in enumerate(names):
        n, down = first[f"n_{i}"], first[f"down_{i}"]

        def value(rank: int, i=i, n=n, down=down) -> float:
            return -math.inf if rank < down else math.inf if rank >= down + n else found[i, rank - down]

        out[name] = []
        for p in places[i]:
            a, b, share = value(math.floor(p)), value(math.ceil(p)), p - math.floor(p)
            out[name].append(a if share == 0 or a == b else a * (1 - share) + b * share)
        out[name] = out[name] or [None] * len(probs)
    return out


def _within(long: DataFrame, brackets: list[tuple[int, float, float]]) -> DataFrame:
    """(b, v, lo, hi): the values of every bracket, by its place in the list; brackets of a column don't overlap."""
    rows = [(k, *b) for k, b in enumerate(brackets)]
    table = long.sparkSession.createDataFrame(rows, "b int, _c int, lo double, hi double")
    return long.join(F.broadcast(table), (F.col("c") == F.col("_c")) & F.col("v").between(F.col("lo"), F.col("hi"))).select("b", "v", "lo", "hi")
