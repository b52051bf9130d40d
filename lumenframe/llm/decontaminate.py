"""Operator 5: benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of punctuation; numbers, names (capitalised
words) and units (after a number) become typed placeholders whose values are
kept as slots. Windows of eight template words (a shorter item is one window) are
hashed and joined with those of the benchmark. Matches on one diagonal (document
place minus item place) must give each slot value of the item one value in the
document, and what matches must cover enough of the item:

* windows with at least ``LITERALS`` plain words: ``MIN_COVER`` of the item;
* with windows of fewer plain words, down to one: ``WEAK_COVER`` of what
  template windows of the item reach, so that items dense in numbers or names
  match as a whole. An item under eight words needs ``SHORT_LITERALS``.

Every window is also hashed by its lower-cased plain words, whatever their class,
and counts as a window of literals, so a verbatim copy of any item with a word is
found. Items and documents of equal text are one class until the end.

The benchmark's window hashes are broadcast when a count shows them few; then
only hits leave the scan. Otherwise all windows are joined by shuffle.

Edge cases: null or empty texts and items match nothing; null ids are kept as
null, and items of equal text go by their smallest id; repeated rows give their
pair once; ties need no order, for all pairs over the thresholds are returned;
very long texts are read in slices; other columns are not read, and
``drop_contaminated`` hands them on.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WordColumns, arrow_map, cut, hash_word, kept, read_table, shingle_hashes, small_side

WINDOW = 8
#: Least share of an item's words that matching windows must cover.
MIN_COVER = 0.3
#: Plain words of a window that speaks for itself, and of a whole item under eight words.
LITERALS, SHORT_LITERALS = 4, 3
#: Least share of an item's reach that windows of fewer plain words must cover.
WEAK_COVER = 0.9
#: Keeps the hashes of plain words apart from those of templates.
_PLAIN = np.uint64(0x5851F42D4C957F2D)

#: Unit words.
UNITS = set(
    """kg g mg lb lbs oz ton tons tonne tonnes km m cm mm mile miles inch inches ft feet yard yards l ml litre litres liter
    liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
    dollar dollars euro euros pound pounds cent cents usd eur gbp percent degree degrees kmh mph hz khz mhz ghz kb mb gb tb
    w kw kwh v volt volts amp amps""".split()
)
_EDGES = re.compile(r"^\W+|\W+$")
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*%?$")
_GLUED = re.compile(r"(?<=\d)(?=[^\W\d_])")
_DIGIT = re.compile(r"[0-9]")
LITERAL, NUMBER, UNIT, NAME, EMPTY = range(5)
_PLACEHOLDERS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0], np.uint64)


def _classify(raw: bytes) -> tuple[int, int]:
    """(class, hash of the plain word) of a raw word."""
    word = _EDGES.sub("", raw.decode("utf-8", "surrogatepass"))
    if not word:
        return EMPTY, 0
    low = word.lower()
    value = hash_word(low.encode("utf-8", "surrogatepass"))
    if _NUMBER.match(word):
        return NUMBER, value
    if low in UNITS:
        return UNIT, value
    return NAME if word[0].isupper() and word[1:].islower() else LITERAL, value


class Canonical:
    """The words of several texts, those of punctuation alone left out: template and value hashes, classes, ``text`` and place."""

    def __init__(self, texts: list[str | None]):
        words = kept("template words", lambda: WordColumns(_classify, [np.int8, np.uint64]))
        # a unit may stick to its number
        texts = [_GLUED.sub(" ", t) if t and _DIGIT.search(t) else t for t in texts]
        (kind, value), begin = words.of(texts)
        text = np.repeat(np.arange(len(texts)), np.diff(begin))
        keep = kind != EMPTY
        kind, value, self.text = kind[keep], value[keep], text[keep]
        self.begin = np.searchsorted(self.text, np.arange(len(texts) + 1))
        number = np.zeros(len(kind), bool)
        number[1:] = (kind[:-1] == NUMBER) & (self.text[1:] == self.text[:-1])
        kind[(kind == UNIT) & ~number] = LITERAL
        self.slot, self.value = kind != LITERAL, value
        self.template = np.where(self.slot, _PLACEHOLDERS[kind], value)

    def windows(self, size: int, known: np.ndarray | None = None):
        """(hashes, places, literals, templated) of the windows of ``size`` words; only those in the sorted ``known`` if given."""
        h = shingle_hashes(self.template, size) + np.uint64(size)
        if not len(h):
            return h, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        plain = shingle_hashes(self.value, size) + np.uint64(size) + _PLAIN
        seen = np.concatenate([[0], np.cumsum(~self.slot)])
        literals = seen[size:] - seen[:-size]
        inside = self.text[: len(h)] == self.text[size - 1 :]
        ok = inside & (literals >= (1 if size == WINDOW else SHORT_LITERALS))
        one, two = np.flatnonzero(ok & _among(h, known)), np.flatnonzero(inside & _among(plain, known))
        at = np.concatenate([one, two])
        return np.concatenate([h[one], plain[two]]), at, literals[at], np.repeat([True, False], [len(one), len(two)])

    def slots(self, at: int, size: int, templated: bool) -> list[int]:
        return self.value[at : at + size][self.slot[at : at + size]].view(np.int64).tolist() if templated else []


def _among(h: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """Which hashes are in the sorted ``known``; all if there is none."""
    if known is None:
        return np.ones(len(h), bool)
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def keyed(df: DataFrame) -> DataFrame:
    """``df`` with ``t1`` and ``t2``, a 128-bit key of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.withColumns({"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)})


def window_table(docs: DataFrame, sizes: list[int], known: np.ndarray | None = None) -> DataFrame:
    """(t1, t2, h, size, place, slots) of the windows of texts; a text is looked up once per batch. ``docs``: text, t1, t2."""
    held = None if known is None else docs.sparkSession.sparkContext.broadcast(known)

    def run(batch):
        keys = list(zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), strict=True))
        texts = dict(zip(keys, batch.column("text").to_pylist(), strict=True))
        keys, got, out = list(texts), Canonical(list(texts.values())), []
        for size in sizes:
            h, at, _, templated = got.windows(size, None if held is None else held.value)
            for x, i, t in zip(h.view(np.int64).tolist(), at.tolist(), templated.tolist(), strict=True):
                text = int(got.text[i])
                out.append((*keys[text], x, size, i - int(got.begin[text]), got.slots(i, size, t)))
        return dict(zip(("t1", "t2", "h", "size", "place", "slots"), zip(*out, strict=True), strict=True)) if out else None

    return arrow_map(docs.select("t1", "t2", F.col("text").cast("string")), run, "t1 long, t2 long, h long, size int, place int, slots array<long>")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, reach, h, size, item_place, item_slots, strong) by class of items.

    Windows have WINDOW words, or all of a shorter item's; ``n`` is the item's words, ``reach`` those in its template windows.
    """

    def run(batch):
        out = []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            got = Canonical([text])
            n = len(got.value)
            if n:
                size = min(n, WINDOW)
                h, at, literals, templated = got.windows(size)
                reached = np.zeros(n + 1, np.int64)
                np.add.at(reached, at[templated], 1)
                np.add.at(reached, at[templated] + size, -1)
                reach = int((np.cumsum(reached) > 0).sum())
                strong = ~templated | (literals >= (LITERALS if size == WINDOW else SHORT_LITERALS))
                for x, i, t, s in zip(h.view(np.int64).tolist(), at.tolist(), templated.tolist(), strong.tolist(), strict=True):
                    out.append((item, n, reach, x, size, i, got.slots(i, size, t), s))
        names = ("item_id", "n", "reach", "h", "size", "item_place", "item_slots", "strong")
        return dict(zip(names, zip(*out, strict=True), strict=True)) if out else None

    items = keyed(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")))
    items = items.groupBy("t1", "t2").agg(F.min("item_id").alias("item_id"), F.min("text").alias("text"))
    return arrow_map(items.select("item_id", "text"), run, "item_id long, n int, reach int, h long, size int, item_place int, item_slots array<long>, strong boolean")


def _matches(docs: DataFrame, benchmark: DataFrame, min_cover: float) -> DataFrame:
    """(t1, t2, item_id, covered, cover) of every class of texts and items that match. ``docs``: text, t1, t2."""
    items = cut(item_windows(benchmark), "items")
    sizes = [r["size"] for r in items.select("size").distinct().orderBy("size").collect()]  # at most WINDOW
    few = items.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = np.sort(items.select("h").distinct().toPandas()["h"].to_numpy(np.int64).view(np.uint64)) if few else None
    hits = window_table(docs, sizes or [WINDOW], known).join(small_side(items), ["h", "size"])
    # a diagonal is one alignment of the item in the document; strong windows stand alone and with the others
    kinds = F.when(F.col("strong"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    hits = hits.select(
        "t1", "t2", "item_id", "n", "reach", "item_place", "size", "item_slots", "slots",
        (F.col("place") - F.col("item_place")).alias("diagonal"), F.explode(kinds).alias("alone"),
    )
    key = ["t1", "t2", "item_id", "n", "reach", "alone"]
    slots = hits.select(*key, "diagonal", "item_place", "size", F.explode_outer(F.arrays_zip("item_slots", "slots")).alias("s"))
    aligned = slots.groupBy(*key, "diagonal").agg(
        F.size(F.collect_set("s.item_slots")).alias("from_values"),
        F.size(F.collect_set(F.when(F.col("s").isNotNull(), F.struct("s.item_slots", "s.slots")))).alias("mapped"),
        F.collect_set(F.struct("item_place", "size")).alias("places"),  # at most two per word of the item
    )
    covered = aligned.where("mapped = from_values").select(*key, F.explode("places").alias("p"))
    covered = covered.select(*key, F.explode(F.sequence("p.item_place", F.expr("p.item_place + p.size - 1"))).alias("word"))
    pairs = covered.groupBy(*key).agg(F.size(F.collect_set("word")).alias("covered"))
    enough = F.when(F.col("alone"), F.col("covered") >= min_cover * F.col("n")).otherwise(F.col("covered") >= WEAK_COVER * F.greatest("reach", F.lit(1)))
    pairs = pairs.where(enough).groupBy("t1", "t2", "item_id", "n").agg(F.max("covered").alias("covered"))
    return pairs.select("t1", "t2", "item_id", F.col("covered").cast("long"), F.round(F.col("covered") / F.col("n"), 4).alias("cover"))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """(doc_id, item_id, covered, cover) of every document and class of items that match."""
    docs = keyed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    found = cut(_matches(docs, benchmark, min_cover), "leaks")
    return docs.select("doc_id", "t1", "t2").join(small_side(found), ["t1", "t2"]).drop("t1", "t2").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents whose text matches no item."""
    whole = keyed(docs.select(F.struct("*").alias("_doc"), F.col("text").cast("string").alias("text")))
    bad = cut(_matches(whole, benchmark, MIN_COVER).select("t1", "t2").distinct(), "leaks")
    return whole.join(small_side(bad), ["t1", "t2"], "left_anti").select("_doc.*")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
