"""Operator 11: vector code compression by integer codebooks (product quantisation).

Vectors become integers and are cut into equal parts, each with a codebook of
its own. The codebooks are broadcast (entries x dimensions numbers, whatever
the table holds). Tasks read Arrow batches and get all distances to the entries
by norm expansion, |x|^2 - 2 x c + |c|^2, from exact int64 matrix products; the
first least one wins. Each task adds up its parts entry by entry, and a grouped
shuffle merges these sums, at most one row per entry and task.

Edge cases: a vector that is null or holds a null or non-finite component is
dropped, as the contract says. Components beyond the 64-bit range are held at
its ends. Where 64 bits can't hold a distance, the same steps run on Python's
integers, and an error beyond 64 bits is held at the greatest long. Vectors
shorter than the longest one, or than the next multiple of the parts, count as
padded with zeros. Of a repeated vec_id the least vector can begin a codebook,
once; a null vec_id comes last; all rows are coded. With fewer ids than entries
the codebooks are as small. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_batches, cut, read_table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows whose distances are held at a time.
ROWS = 2048
#: Labels with the most rows, joined by broadcast where there are too many labels for that.
HOT_LABELS = 1000
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as int64, held at the ends of its range."""
    big = np.floor(values.astype(np.float64) * scale)
    inside = np.abs(big) < 2.0**63
    return np.where(inside, np.where(inside, big, 0).astype(np.int64), np.where(big > 0, MOST, LEAST))


def matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of ``dims`` integers; shorter vectors end in zeros."""
    ends = vectors.offsets.to_numpy()
    flat = integers(vectors.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]])
    sizes = np.diff(ends)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row, the first of equals.

    Products are of int64 as long as no sum of an expansion can leave its range, else of Python integers.
    """
    most = max([abs(int(f(a))) for a in (x, entries) if a.size for f in (np.min, np.max)], default=0)
    if 4 * x.shape[1] * most**2 > MOST:
        x, entries = x.astype(object), entries.astype(object)
    norms = (entries * entries).sum(axis=1)
    product = x @ np.ascontiguousarray(entries.T)
    product *= -2
    product += norms
    index = product.argmin(axis=1)
    return index, product[np.arange(len(x)), index] + (x * x).sum(axis=1)


def _blocks(batches: Iterator[pa.RecordBatch], column: int, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in (part for whole in batches for part in bounded_batches(whole)):
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            yield rows, matrix(rows.column(column), dims)


def initial_codebooks(vectors: DataFrame, parts: int, entries: int) -> tuple[np.ndarray, int]:
    """(codebooks of shape parts x entries x width, dimensions): the vectors of the smallest ids, cut into parts."""
    longest = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    dims = -(-longest // parts) * parts
    ids = vectors.select(F.col("vec_id").alias("_id")).distinct().orderBy(F.asc_nulls_last("_id")).limit(entries)
    first = vectors.join(F.broadcast(ids), F.col("vec_id").eqNullSafe(F.col("_id")), "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = sorted(first.collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0))
    whole = np.zeros((len(rows), dims), np.int64)
    for at, row in zip(whole, rows, strict=True):
        at[: len(row["vector"])] = integers(np.array(row["vector"], np.float64))
    return whole.reshape(len(rows), parts, dims // parts).transpose(1, 0, 2), dims


def entry_sums(vectors: DataFrame, codebooks: np.ndarray, dims: int) -> DataFrame:
    """(part, entry, count, high, low): how many parts chose an entry, and their componentwise sums as high * 2^32 + low."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(codebooks)
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        counts = np.zeros((parts, entries), np.int64)
        high, low = np.zeros((2, parts, entries, width), np.int64)
        for _, x in _blocks(batches, 0, dims):
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                index, _ = nearest(own, books[p])
                counts[p] += np.bincount(index, minlength=entries)
                np.add.at(high[p], index, own >> 32)
                np.add.at(low[p], index, own & 0xFFFFFFFF)
        used = np.argwhere(counts)
        if len(used):
            p, e = used.T
            longs = [pa.array(list(a[p, e]), pa.list_(pa.int64())) for a in (high, low)]
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), *longs], names=["part", "entry", "count", "high", "low"])

    found = vectors.select("vector").mapInArrow(run, "part int, entry int, count long, high array<long>, low array<long>")
    sums = [F.array(*[F.sum(F.col(c)[i]) for i in range(width)]).cast("array<long>").alias(c) for c in ("high", "low")]
    return found.groupBy("part", "entry").agg(F.sum("count").alias("count"), *sums)


def train_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, int]:
    """(codebooks, dimensions) after ``rounds`` of assigning all (vec_id, vector) rows and moving each entry to its parts' floored mean.

    The driver holds the codebooks and one row of sums per entry, whose number doesn't depend on the table.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part, so 1 to 256 entries")
    codebooks, dims = initial_codebooks(vectors, parts, entries)
    for _ in range(rounds if codebooks.size else 0):
        found = entry_sums(vectors, codebooks, dims).collect()
        codebooks = codebooks.copy()
        for r in found:
            codebooks[r["part"], r["entry"]] = [((h << 32) + low) // r["count"] for h, low in zip(r["high"], r["low"], strict=True)]
    return codebooks, dims


def encode_vectors(vectors: DataFrame, codebooks: np.ndarray, dims: int) -> DataFrame:
    """(vec_id, label, code, error) of all (vec_id, label, vector) rows: a byte for each part, and the squared distances summed."""
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)
    parts, _, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in _blocks(batches, 2, dims):
            found = [nearest(x[:, p * width : (p + 1) * width], shared.value[p]) for p in range(parts)]
            code = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            whole = [min(int(e), MOST) for e in sum(d.astype(object) for _, d in found)] if len(x) else []
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(whole, pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id long, label {kind}, code binary, error long")


def codebooks_table(spark: SparkSession, codebooks: np.ndarray) -> DataFrame:
    """(part, entry, components): the codebooks as a table, for decoding by a join."""
    rows = [(p, e, entry.tolist()) for p, book in enumerate(codebooks) for e, entry in enumerate(book)]
    return spark.createDataFrame(rows, "part int, entry int, components array<long>")


def with_label_total(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the errors of all rows with the same label (NULL is one label) added up.

    Errors meet as one partial sum per task and label. Totals are broadcast where they are few; otherwise those of the
    labels with the most rows are, and the other rows, of at most a thousandth of the table a label, are joined by shuffle.
    """
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    totals = cut(coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"), F.count("*").alias("_n")), "label-totals")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if totals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return coded.join(F.broadcast(totals), same).drop("_label", "_n")
    hot = totals.orderBy(F.desc("_n"), "_label").limit(HOT_LABELS)
    met = coded.join(F.broadcast(hot), same)
    rest = coded.join(F.broadcast(hot), same, "left_anti").join(totals, same)
    return met.unionByName(rest).drop("_label", "_n")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), "label", F.col("embedding").alias("vector"))
    vectors = cut(rows.where(usable(F.col("vector"))), "vectors")
    codebooks, dims = train_codebooks(vectors)
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    coded = with_label_total(cut(encode_vectors(vectors, codebooks, dims), "codes"))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    steps = [
        """v AS MATERIALIZED (
  SELECT vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
)""",
        "p AS MATERIALIZED (SELECT vec_id, j AS part, e[j * (len(e) // 4) + 1 : (j + 1) * (len(e) // 4)] AS x FROM v, range(4) AS t(j))",
        "c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < 256)",
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (
  SELECT vec_id, part, x, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) * 256 + entry) AS best
  FROM p JOIN c{k} USING (part) GROUP BY ALL
)"""
        )
        if k < ROUNDS:
            steps.append(
                f"""c{k + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m, c) AS c FROM c{k} LEFT JOIN (
    SELECT part, entry, list(f ORDER BY pos) AS m FROM (
      SELECT part, best % 256 AS entry, pos, floor(sum(x[pos]) / count(*)) AS f FROM a{k}, range(1, 1 + (SELECT max(len(x)) FROM p)) AS r(pos) GROUP BY ALL
    ) GROUP BY ALL
  ) USING (part, entry)
)"""
            )
    return f"""WITH {", ".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string([CAST(y AS BIGINT) FOR y IN c], ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS}),
r AS (SELECT vec_id, string_agg(lower(printf('%02x', best % 256)), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), h"""


ORACLE = _oracle()
