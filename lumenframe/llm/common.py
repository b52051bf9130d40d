"""Helpers shared by the training-data operators.

Size-checked broadcasts, bounded label samples, lineage cuts in the shared
checkpoint folder, and the word rules that several contracts state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import materialize as cut  # noqa: F401  (written steps of all operators)

#: Words of the contracts: runs of anything but ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"

#: A table of at most so many narrow rows (tens of bytes each) is broadcast.
BROADCAST_ROWS = 1_000_000
#: Bytes of rows that Python code turns into objects at a time.
BATCH_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_words(text: str | None) -> list[bytes]:
    """The same words as UTF-8: bytes.split() cuts at exactly the contract's white space, and fast."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def fold(doc_id: Column, modulus: int, held: int) -> Column:
    """True where crc32 of the id as text falls in the held-out remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(modulus) == F.lit(held), F.lit(False))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark for broadcast when a count shows it small; otherwise leave the choice to Spark.

    The count stops early: at most ``rows + 1`` rows are looked at.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded_sample(df: DataFrame, key: str, max_rows: int) -> DataFrame:
    """About ``max_rows`` rows at most, chosen by a hash of ``key``; all rows when there are fewer."""
    n = df.count()
    if n <= max_rows:
        return df
    buckets = 1 << 20
    keep = int(buckets * max_rows / n)
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(buckets)) < keep)


def labelled(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """One (doc_id, label) per labelled document; conflicting repeats take the larger label."""
    return (
        read_table(spark, sf_dir, "labels")
        .where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(column).cast("int")).alias("label"))
    )


def labelled_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, text, label, key) of about ``max_rows`` rows at most: a sample of ids, and of their distinct texts if they have many."""
    sample = bounded_sample(labels, "doc_id", max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id", "text"])
    return bounded_sample(cut(rows.withColumn("key", F.xxhash64("doc_id", "text")), "labelled"), "key", max_rows)


def hash_word(raw: bytes, seed: int = 0) -> int:
    """A stable 64-bit hash of a word's UTF-8 bytes."""
    return xxhash.xxh3_64_intdigest(raw, seed)


_KEPT: dict = {}


def kept(name, make: Callable):
    """What ``make`` returns, once per Python worker as long as no other name is asked for.

    Tables of words so outlive a task, for workers are used again, but not the operator.
    """
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


class WordCache(dict):
    """word -> value, computed once; emptied when it grows past ``limit`` so memory stays bounded."""

    def __init__(self, make: Callable, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value


class WordTable(dict):
    """word -> row of columns that ``make`` computes once; emptied between texts when it has grown past ``limit``."""

    def __init__(self, make: Callable, dtypes: list, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit
        self.columns = [np.empty(1024, d) for d in dtypes]

    def __missing__(self, word):
        row = len(self)
        if row == len(self.columns[0]):
            self.columns = [np.resize(c, 2 * row) for c in self.columns]
        for column, value in zip(self.columns, self.make(word), strict=True):
            column[row] = value
        self[word] = row
        return row

    def of(self, words: list[bytes]) -> list[np.ndarray]:
        """The columns for a text's words."""
        if len(self) > self.limit:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return [c[rows] for c in self.columns]


def hash_words(words: list[bytes], cache: dict) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Bytes of text whose words are hashed at a time.
SLICE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(30).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, made once per process."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(SLICE + 1, base, np.uint64)
            x[0] = 1
            _POWERS.append(np.cumprod(x, dtype=np.uint64))
    return _POWERS


def _hash_slice(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first byte, end) of the words of at most SLICE bytes: differences of one running polynomial."""
    up, down = _powers()
    codes = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = ~_SPACE[codes]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTES[codes] * up[: len(codes)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts, ends


def _cuts(raw: bytes) -> Iterator[bytes]:
    """Pieces of at most SLICE bytes that end at white space (a longer word is one of its own)."""
    at = 0
    while len(raw) - at > SLICE:
        end = at + SLICE
        while end > at and not _SPACE[raw[end]]:
            end -= 1
        if end == at:
            end = at + SLICE
            while end < len(raw) and not _SPACE[raw[end]]:
                end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def hashed_groups(texts: list[str | None], change: Callable[[bytes], bytes] | None = None) -> Iterator[tuple]:
    """(raw, hashes, starts, ends, counts): words of a few texts at a time, their bytes in ``raw``, and how many each text has.

    Short texts are hashed together. A text of several slices comes in as many groups; all but the last have a count of None.
    """
    held: list[bytes] = []

    def joined() -> tuple:
        raw = b"\n".join(held)
        h, starts, ends = _hash_slice(raw)
        at = np.cumsum([0] + [len(r) + 1 for r in held])
        held.clear()
        return raw, h, starts, ends, np.diff(np.searchsorted(starts, at))

    size = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        raw = change(raw) if change else raw
        if held and size + len(raw) + 1 > SLICE:
            yield joined()
            size = 0
        if len(raw) < SLICE:
            held.append(raw)
            size += len(raw) + 1
            continue
        pieces = list(_cuts(raw))
        for k, piece in enumerate(pieces):
            h, starts, ends = _hash_slice(piece) if len(piece) <= SLICE else _hash_long(piece)
            yield piece, h, starts, ends, None if k < len(pieces) - 1 else np.array([len(h)])
    if held:
        yield joined()


def text_hashes(texts: list[str | None], change: Callable[[bytes], bytes] | None = None) -> list[np.ndarray]:
    """64-bit hashes of the words of every text, in order; equal words have equal hashes wherever they stand.

    ``change`` maps the UTF-8 bytes first and keeps white space.
    """
    out: list[np.ndarray] = []
    long: list[np.ndarray] = []
    for _, h, _, _, counts in hashed_groups(texts, change):
        if counts is None:
            long.append(h)
        elif long:
            out.append(np.concatenate([*long, h]))
            long = []
        else:
            out.extend(np.split(h, np.cumsum(counts)[:-1]))
    return out


def _hash_long(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for one word, with white space around it, of more than SLICE bytes."""
    word = raw.strip(b" \t\n\v\f\r")
    start = raw.index(word)
    return np.array([hash_word(word)], np.uint64), np.array([start]), np.array([start + len(word)])


class WordColumns:
    """Columns of values that ``make`` computes from a word's bytes, once per distinct word; emptied when past ``limit``."""

    def __init__(self, make: Callable, dtypes: list, limit: int = 300_000):
        self.make, self.dtypes, self.limit = make, dtypes, limit
        self.rows: dict[int, tuple] = {}

    def of(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """The columns for all words of all texts, one after another, and where each text begins."""
        parts, counts, open_words = [], [0], 0
        for raw, h, starts, ends, n in hashed_groups(texts):
            if len(self.rows) > self.limit:
                self.rows.clear()
            found, first, at = np.unique(h, return_index=True, return_inverse=True)
            rows = list(map(self.rows.get, found.tolist()))
            for i, row in enumerate(rows):
                if row is None:
                    k = first[i]
                    rows[i] = self.rows[int(found[i])] = self.make(raw[starts[k] : ends[k]])
            values = zip(*rows, strict=True) if rows else [()] * len(self.dtypes)
            parts.append([np.array(v, d)[at] for v, d in zip(values, self.dtypes, strict=True)])
            if n is None:
                open_words += len(h)
            else:
                counts += [int(n[0]) + open_words, *n[1:].tolist()]
                open_words = 0
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, d) for d in self.dtypes]
        return columns, np.cumsum(counts)


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words; empty when there are fewer than n."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + m]
        out ^= out >> np.uint64(32)
    return mix(out)


def bounded_batches(batch: pa.RecordBatch, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Halves of a batch until each has at most ``size`` bytes or one row."""
    if batch.num_rows > 1 and batch.nbytes > size:
        half = batch.num_rows // 2
        yield from bounded_batches(batch.slice(0, half), size)
        yield from bounded_batches(batch.slice(half), size)
    else:
        yield batch


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """Apply ``fn`` to Arrow batches; it returns columns by name for ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bounded_batches(whole)):
            if batch.num_rows:
                got = fn(batch)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def fit_on_shards(df: DataFrame, fit: Callable, shards: int, schema: str, key: str = "doc_id") -> DataFrame:
    """Run ``fit`` (pandas in, pandas out) on hash shards of a bounded sample, for parameter mixing."""
    return (
        df.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), F.col(key)), F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInPandas(fit, schema)
    )
