"""Rows in one order without a window over all of them: numbered ranges, and blocks with halo rows.

``ordered`` deals rows to ranges by their order columns, sorts each range and
writes it; a row's number is its range's offset plus its place. Numbers are
dense, so blocks of numbers have equal size whatever the values are. A block
gets copies of the rows just before and after it, its halo, and then windows
over a block see what windows over the whole order would see that far.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..sources.tables import materialize

#: Rows that a block owns; halos come on top.
BLOCK = 1 << 16


@dataclass
class Ordered:
    """``rows``: a written table with pos (0, 1, ... in order) and _range; ``n`` of them; ``starts``: the first pos of every range."""

    rows: DataFrame
    n: int
    starts: list[int]

    def blocks(self, before: int, after: int = 0, size: int | None = None) -> DataFrame:
        """``rows`` with _block and _own: every row in the block that owns it, and again in a neighbour as halo."""
        size = max(size or BLOCK, before, after)
        block, place = F.expr(f"pos div {size}"), F.col("pos") % size
        spots = F.array(
            F.struct(block.alias("_block"), F.lit(True).alias("_own")),
            F.when((place >= size - before) & (F.col("pos") + size - place < self.n), F.struct((block + 1).alias("_block"), F.lit(False).alias("_own"))),
            F.when((place < after) & (block > 0), F.struct((block - 1).alias("_block"), F.lit(False).alias("_own"))),
        )
        spread = self.rows.withColumn("_spot", F.explode(F.filter(spots, lambda s: s.isNotNull())))
        return spread.select(*self.rows.columns, "_spot._block", "_spot._own")

    def ntile(self, k: int) -> Column:
        """The number from 1 of the k nearly equal parts that a row lies in; the first parts are the larger ones."""
        q, r = divmod(self.n, k)
        whole = r * (q + 1)
        rest = F.lit(r) + F.floor((F.col("pos") - whole) / max(1, q))
        return (F.when(F.col("pos") < whole, F.floor(F.col("pos") / (q + 1))).otherwise(rest) + 1).cast("int")

    def running(self, column: str) -> DataFrame:
        """``rows`` with run_<column>: the sum of the column up to this row; a range's sums are added to the totals before it."""
        parts = dict(self.rows.groupBy("_range").agg(F.sum(column)).collect())
        before, total = [], 0.0
        for k in range(len(self.starts)):
            before.append(float(total))
            total += parts.get(k) or 0.0
        base = F.element_at(F.array(*[F.lit(x) for x in before]), F.col("_range") + 1)
        w = W.partitionBy("_range").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
        return self.rows.withColumn(f"run_{column}", base + F.coalesce(F.sum(column).over(w), F.lit(0.0)))


def by_pos() -> WindowSpec:
    """The rows of a block in order, its halo among them."""
    return W.partitionBy("_block").orderBy("pos")


def ordered(df: DataFrame, order_by: list[str], ranges: int | None = None) -> Ordered:
    """Number the rows by ``order_by``, NULL first; rows equal in it come by a hash of all columns.

    Only rows alike in every column can't be told apart and lie in one range. The driver holds one count per range.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    keys = [*[F.col(c) for c in order_by], F.col("_tie")]
    placed = df.withColumn("_tie", F.xxhash64(*plain)).repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    held = materialize(placed.drop("_tie"), "ordered")
    held = held.withColumn("_range", F.shiftrightunsigned("_m", 33).cast("int"))
    counts = dict(held.groupBy("_range").count().collect())
    starts = [0]
    for k in range(max(counts, default=-1) + 1):
        starts.append(starts[-1] + counts.get(k, 0))
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("_range") + 1)
    rows = held.withColumn("pos", start + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m")
    return Ordered(rows, starts[-1], starts[:-1] or [0])


def filled(df: DataFrame, columns: dict[str, Column], order_by: list[str], partition_by: list[str]) -> DataFrame:
    """``df`` with the columns as doubles, missing values on the line between their known neighbours in order.

    ``columns``: name to the condition that a value is missing. After the last known value it is kept; before the first one
    stays NULL. A group of ``partition_by`` may span ranges: what a range knows first and last of a group is handed on.
    """
    o = ordered(df, [*partition_by, *order_by])
    group = F.struct(*partition_by) if partition_by else F.lit(0)
    rows = o.rows.withColumn("_group", group)
    for i, (c, missing) in enumerate(columns.items()):
        rows = rows.withColumn(f"_held{i}", F.when(~missing, F.struct(F.col("pos").alias("at"), F.col(c).cast("double").alias("v"))))
    sides = []  # of every range: its first and last group, and the last and first known values of those
    ends = rows.groupBy("_range").agg(F.min_by("_group", "pos").alias("first"), F.max_by("_group", "pos").alias("last"))
    edged = rows.join(F.broadcast(ends), "_range")

    def of(side: str, i: int, pick) -> Column:
        known = F.when(F.col("_group").eqNullSafe(F.col(side)), F.col(f"_held{i}"))
        return pick(known, F.when(known.isNotNull(), F.col("pos")))

    told = edged.groupBy("_range").agg(
        F.first("first").alias("first"), F.first("last").alias("last"),
        *[of("last", i, F.max_by).alias(f"tail{i}") for i in range(len(columns))], *[of("first", i, F.min_by).alias(f"head{i}") for i in range(len(columns))],
    ).orderBy("_range").collect()
    for i in range(len(columns)):
        before: dict[int, tuple | None] = {}
        after: dict[int, tuple | None] = {}
        held, of_group = None, object()
        for r in told:
            before[r["_range"]] = held if r["first"] == of_group else None
            carried = r[f"tail{i}"] or (held if r["first"] == of_group == r["last"] else None)
            held, of_group = carried, r["last"]
        held, of_group = None, object()
        for r in reversed(told):
            after[r["_range"]] = held if r["last"] == of_group else None
            carried = r[f"head{i}"] or (held if r["last"] == of_group == r["first"] else None)
            held, of_group = carried, r["first"]
        sides.append((before, after))
    spark = df.sparkSession
    carried = [(r["_range"], *[x[r["_range"]] for pair in sides for x in pair]) for r in told]
    names = [f"_{s}{i} struct<at: bigint, v: double>" for i in range(len(columns)) for s in ("before", "after")]
    hints = spark.createDataFrame(carried, f"_range int, {', '.join(names)}")
    out = rows.join(F.broadcast(ends), "_range").join(F.broadcast(hints), "_range")
    of_range = W.partitionBy("_range", *partition_by)  # both ways from the start: a frame that ends at the last row is counted anew for every row
    back, ahead = (of_range.orderBy(o).rowsBetween(W.unboundedPreceding, 0) for o in (F.asc("pos"), F.desc("pos")))
    for i, (c, missing) in enumerate(columns.items()):
        a = F.coalesce(F.last(f"_held{i}", True).over(back), F.when(F.col("_group").eqNullSafe(F.col("first")), F.col(f"_before{i}")))
        b = F.coalesce(F.last(f"_held{i}", True).over(ahead), F.when(F.col("_group").eqNullSafe(F.col("last")), F.col(f"_after{i}")))
        out = out.withColumns({"_a": a, "_b": b})
        a, b = F.col("_a"), F.col("_b")
        line = a["v"] + (b["v"] - a["v"]) * (F.col("pos") - a["at"]) / F.nullif(b["at"] - a["at"], F.lit(0))
        out = out.withColumn(c, F.when(~missing, F.col(c).cast("double")).when(a.isNull(), None).when(b.isNull(), a["v"]).otherwise(line))
    return out.select(*df.columns)
