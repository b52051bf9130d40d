"""Operator 6: substring deduplication by repeated-phrase automata.

A window is WINDOW consecutive words; what is removed are the words covered by a
window that starts anywhere else too. Each window has an anchor: of its phrases
(PHRASE consecutive words) the one with the least hash, so equal windows have
equal anchors. The steps:

1. Every text emits its anchors; those that occur once anywhere are dropped, and
   with them all windows that cannot recur.
2. The windows with a recurring anchor are counted over the whole corpus. Those
   found twice are confirmed, and each gets one place to stand for it. Blocks of
   such places, with their words, are the table of recurring passages.
3. Documents with confirmed windows are dealt to shards. A shard takes the
   passages that its documents need from the table, compiles their windows into
   an Aho-Corasick automaton over word numbers, and streams its documents through
   it. Every occurrence that it locates, word by word, covers words to remove.

A document without a confirmed window holds no occurrence and is not streamed.
Texts that are there twice as a whole count once per task with weight two, and
all their words go. Hot anchors and windows are combined inside the tasks before
any shuffle, and joins on them are split by rows.

Edge cases: a null or empty text has no words and keeps none; texts shorter than
a window keep all words; null or repeated ids need no care, for texts are
matched by content; repeated rows are copies of each other; very long texts are
hashed in slices and may be a shard of their own; other columns pass through
``remove_repeats`` unless they are named in ``ADDED``.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import bounded_batches, byte_words, cut, mix, read_table, small_side, text_hashes

WINDOW = 35
PHRASE = 18
ADDED = ["kept", "n_words", "n_removed"]
#: About so many words of documents share an automaton; each adds at most WINDOW nodes.
SHARD_WORDS = 30_000
#: Places of a passage block.
BLOCK = 64
#: Rows of one window or passage are dealt to so many tasks.
SALTS = 32
#: Bytes of text hashed at a time.
TEXT_BYTES = 2 << 20
_TEXT = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words, by doubling."""
    if len(h) < n:
        return h[:0]
    powers, size, out, done = h, 1, None, 0
    while size <= n:
        if n & size:
            part = powers[done : len(powers)]
            out = part if out is None else mix(out[: len(part)] * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(size))
            done += size
        size *= 2
        if size <= n:
            half = size // 2
            powers = mix(powers[:-half] * np.uint64(0xD6E8FEB86659FD93) + powers[half:] + np.uint64(1))
    return out[: len(h) - n + 1]


def window_minima(x: np.ndarray, n: int) -> np.ndarray:
    """Minima of every n consecutive values, by doubling."""
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


class Hashed:
    """The words of several texts one after another: ``h`` their hashes, ``text`` whose each is, ``begin`` where texts begin.

    ``phrases`` and ``anchors`` are by place and marked with their text, so that they are told apart between texts.
    """

    def __init__(self, texts: list[str | None], window: int, phrase: int):
        found = text_hashes(texts)
        self.begin = np.cumsum([0] + [len(x) for x in found])
        self.h = np.concatenate(found)
        self.text = np.repeat(np.arange(len(found), dtype=np.uint64), np.diff(self.begin))
        p = run_hashes(self.h, phrase)
        a = window_minima(p, window - phrase + 1) if len(self.h) >= window else p[:0]
        own = self.text[: len(p)] == self.text[phrase - 1 :] if len(p) else np.zeros(0, bool)
        self.phrases = (p + self.text[: len(p)] * _TEXT)[own]
        self.starts = np.flatnonzero(self.text[: len(a)] == self.text[window - 1 :]) if len(a) else np.zeros(0, np.int64)
        self.plain = a[self.starts]
        self.anchors = self.plain + self.text[self.starts] * _TEXT


def anchor_rows(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(k1, k2, anchor, c): the anchors of every text and how often their phrase starts in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in (part for whole in batches for part in bounded_batches(whole, TEXT_BYTES)):
            keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True))
            fresh = []
            for i, key in enumerate(keys):
                times = seen[key] = seen.get(key, 0) + 1
                if times <= 2:  # two occurrences already make each of its windows recur
                    fresh.append(i)
            if not fresh:
                continue
            batch = batch.take(pa.array(fresh))
            got = Hashed(batch.column("text").to_pylist(), window, phrase)
            if not len(got.starts):
                continue
            new = np.concatenate([[True], got.anchors[1:] != got.anchors[:-1]])
            found, at = np.unique(got.anchors[new], return_index=True)
            times = np.sort(got.phrases)
            c = np.searchsorted(times, found, "right") - np.searchsorted(times, found)
            text = got.text[got.starts[new][at]].astype(np.int64)
            k1, k2 = (batch.column(k).to_numpy()[text] for k in ("k1", "k2"))
            cols = [k1, k2, got.plain[new][at].view(np.int64), c]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["k1", "k2", "anchor", "c"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, anchor long, c long")


def candidate_windows(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(k1, k2, weight, text, n, starts, windows) per text: the windows with a recurring anchor. ``docs``: k1, k2, text, copies, anchors."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in (part for whole in batches for part in bounded_batches(whole, TEXT_BYTES)):
            rows = []
            for row in batch.to_pylist():
                key = row["k1"], row["k2"]
                if row["copies"] > 1 and key in seen:  # a copy adds nothing to a text of weight two
                    continue
                if row["copies"] > 1:
                    seen.add(key)
                rows.append(row)
            if not rows:
                continue
            got = Hashed([r["text"] for r in rows], window, phrase)
            known = [np.array(r["anchors"], np.int64).view(np.uint64) for r in rows]
            known = np.sort(np.concatenate(known) + np.repeat(np.arange(len(rows), dtype=np.uint64), list(map(len, known))) * _TEXT)
            at = np.minimum(np.searchsorted(known, got.anchors), len(known) - 1)
            starts = got.starts[known[at] == got.anchors]
            hashes = run_hashes(got.h, window)[starts].view(np.int64)
            ends = np.searchsorted(starts, got.begin)
            cols = zip(
                *(
                    (r["k1"], r["k2"], min(r["copies"], 2), r["text"], int(got.begin[i + 1] - got.begin[i]), starts[lo:hi] - got.begin[i], hashes[lo:hi])
                    for i, (r, lo, hi) in enumerate(zip(rows, ends[:-1], ends[1:], strict=True))
                ),
                strict=True,
            )
            names = ["k1", "k2", "weight", "text", "n", "starts", "windows"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=names)

    return docs.mapInArrow(run, "k1 long, k2 long, weight long, text string, n long, starts array<long>, windows array<long>")


def passages_of(standing: DataFrame, window: int) -> DataFrame:
    """(at_row, at_block, words, offsets): the words of every block of standing windows. ``standing``: row, text, at (their starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bounded_batches(whole, TEXT_BYTES)):
            out = []
            for row, text, at in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "at")), strict=True):
                words, at = byte_words(text), np.sort(np.array(at, np.int64))
                blocks, first = np.unique(at // BLOCK, return_index=True)
                for block, part in zip(blocks.tolist(), np.split(at, first[1:]), strict=True):
                    out.append((row, block, b" ".join(words[part[0] : part[-1] + window]), part - part[0]))
            if out:
                cols = zip(*out, strict=True)
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["at_row", "at_block", "words", "offsets"])

    return standing.mapInArrow(run, "at_row long, at_block long, words binary, offsets array<long>")


def compile_automaton(passages: list[tuple[bytes, list[int]]], window: int) -> tuple[ahocorasick.Automaton | None, dict[bytes, int]]:
    """The automaton of the passages' windows, and the numbers of their words; 0 is any other word."""
    numbers: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for words, offsets in passages:
        ids = tuple(numbers.setdefault(w, len(numbers) + 1) for w in words.split())
        for at in offsets:
            automaton.add_word(ids[at : at + window], 1)
    if not len(automaton):
        return None, numbers
    automaton.make_automaton()
    return automaton, numbers


def located(documents: DataFrame, passages: DataFrame, window: int) -> DataFrame:
    """(k1, k2, starts): every occurrence of a passage's window in a document of its shard.

    ``documents``: shard, k1, k2, text; ``passages``: shard, words, offsets.
    """

    def run(table: pa.Table) -> pa.Table:
        own = table.column("offsets").is_null().to_pylist()
        words, offsets = table.column("words").to_pylist(), table.column("offsets").to_pylist()
        automaton, numbers = compile_automaton([(w, o) for w, o, doc in zip(words, offsets, own, strict=True) if not doc], window)
        out = []
        for k1, k2, text, doc in zip(table.column("k1").to_pylist(), table.column("k2").to_pylist(), words, own, strict=True):
            if doc and automaton:
                ids = tuple(numbers.get(w, 0) for w in text.split())
                starts = [end - window + 1 for end, _ in automaton.iter(ids)] if len(ids) >= window else []
                if starts:
                    out.append((k1, k2, starts))
        cols = zip(*out, strict=True) if out else ([], [], [])
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.table([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["k1", "k2", "starts"])

    none = F.lit(None)
    texts = documents.select("shard", "k1", "k2", F.col("text").cast("binary").alias("words"), none.cast("array<bigint>").alias("offsets"))
    phrases = passages.select("shard", none.cast("long").alias("k1"), none.cast("long").alias("k2"), "words", "offsets")
    return texts.unionAll(phrases).groupBy("shard").applyInArrow(run, "k1 long, k2 long, starts array<long>")


def covered_words(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words the windows at ``starts`` cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, n), -1)
    return np.cumsum(change[:n]) > 0


def _strip(docs: DataFrame, window: int) -> DataFrame:
    """Apply ``_starts`` (recurring windows) and ``_copies`` to the text in ``_doc``; rows carry ``_doc`` and ADDED."""
    added = [StructField("kept", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())]
    schema = StructType([docs.schema["_doc"], *added])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bounded_batches(whole)):
            texts, n_words, n_removed = [], [], []
            for text, starts, copies in zip(
                batch.column("_doc").field("text").to_pylist(), batch.column("_starts").to_pylist(), batch.column("_copies").to_pylist(), strict=True
            ):
                words = byte_words(text)
                gone = 0
                if copies > 1 and len(words) >= window:
                    gone, left = len(words), []
                elif starts:
                    hit = covered_words(len(words), np.array(starts, np.int64), window)
                    gone, left = int(hit.sum()), [words[i] for i in np.flatnonzero(~hit).tolist()]
                else:
                    left = words
                texts.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                n_words.append(len(words))
                n_removed.append(gone)
            cols = [batch.column("_doc").cast(arrow[0].type), pa.array(texts), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return docs.mapInArrow(run, schema)


def stripped(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(_doc, kept, n_words, n_removed) of every row: the row as it came, its words left joined by one space, and counts."""
    text = F.coalesce(F.col("_doc.text"), F.lit(""))
    keyed = docs.select(F.struct("*").alias("_doc")).withColumn("k1", F.xxhash64(text)).withColumn("k2", F.xxhash64(F.lit(1), text))
    plain = keyed.select("k1", "k2", text.alias("text"))
    copied = cut(plain.groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1"), "copied")

    anchors = cut(anchor_rows(plain, window, phrase), "anchors")
    # other texts need the windows of a copied text only where they share an anchor with it
    shared = (F.min("k1") != F.max("k1")).alias("shared")
    recurring = anchors.groupBy("anchor").agg(F.sum("c").alias("n"), shared).where("n > 1").select("anchor", "shared")
    by_text = anchors.select("k1", "k2", "anchor").join(recurring, "anchor").groupBy("k1", "k2").agg(
        F.collect_set("anchor").alias("all"), F.collect_set(F.when(F.col("shared"), F.col("anchor"))).alias("shared")
    )
    by_text = by_text.join(copied, ["k1", "k2"], "left").select(
        "k1", "k2", F.when(F.col("copies") > 1, F.col("shared")).otherwise(F.col("all")).alias("anchors"), F.coalesce("copies", F.lit(1)).alias("copies")
    )
    by_text = cut(by_text.where("size(anchors) > 0"), "marked")

    keys = small_side(by_text.select("k1", "k2"))
    some = plain.join(keys, ["k1", "k2"], "left_semi").join(by_text, ["k1", "k2"]).select("k1", "k2", "text", "copies", "anchors")
    windows = cut(candidate_windows(some, window, phrase), "windows").withColumn("row", F.monotonically_increasing_id())
    places = windows.select("row", "weight", F.explode(F.arrays_zip("starts", "windows")).alias("w")).select(
        "row", "weight", F.col("w.windows").alias("window"), F.col("w.starts").alias("start"), F.pmod("row", F.lit(SALTS)).alias("salt")
    )
    lone = F.col("weight") == 1
    split = places.groupBy("window", "salt").agg(F.sum("weight").alias("n"), F.count(F.when(lone, 1)).alias("lone"), F.min(F.struct("row", "start")).alias("at"))
    whole = split.groupBy("window").agg(F.sum("n").alias("n"), F.sum("lone").alias("lone"), F.min("at").alias("at"))
    # windows of copied texts alone are no pattern: all words of those texts go
    confirmed = cut(whole.where("n > 1 AND lone > 0").select("window", "at"), "confirmed")
    standing = confirmed.groupBy(F.col("at.row").alias("row")).agg(F.collect_list("at.start").alias("at"))  # at most a text's windows
    passages = cut(passages_of(windows.select("row", "text").join(standing, "row"), window), "passages")

    single = places.where(lone).select("row", "window", "salt")
    stands = single.select("window", "salt").distinct().join(confirmed, "window")
    words = windows.where(lone).agg(F.sum("n")).head()[0] or 0
    shard = F.pmod(F.xxhash64("row"), F.lit(max(1, -(-words // SHARD_WORDS))))
    needs = single.join(stands, ["window", "salt"]).select(
        "row", shard.alias("shard"), F.col("at.row").alias("at_row"), F.floor(F.col("at.start") / BLOCK).alias("at_block")
    )
    needs = cut(needs.distinct(), "needs")
    streamed = windows.join(small_side(needs.select("row").distinct()), "row", "left_semi").select(shard.alias("shard"), "k1", "k2", "text")
    wanted = needs.select("shard", "at_row", "at_block").distinct().join(passages, ["at_row", "at_block"])
    repeats = located(streamed, wanted, window).select("k1", "k2", F.col("starts").alias("_starts"), F.lit(1).cast("long").alias("_copies"))
    none = F.array().cast("array<bigint>")
    hits = cut(repeats.unionByName(copied.select("k1", "k2", none.alias("_starts"), F.col("copies").alias("_copies"))), "repeats")

    hit_keys = small_side(hits.select("k1", "k2"))
    touched = keyed.join(hit_keys, ["k1", "k2"], "left_semi").join(hits, ["k1", "k2"])
    rest = keyed.join(hit_keys, ["k1", "k2"], "left_anti").withColumn("_starts", none).withColumn("_copies", F.lit(1).cast("long"))
    wanted = ["_doc", "_starts", "_copies"]
    return _strip(touched.select(wanted), window).unionByName(_strip(rest.select(wanted), window))


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """``docs`` with ``kept``, ``n_words`` and ``n_removed``, in place of columns of those names."""
    names = [c for c in docs.columns if c not in ADDED]
    return stripped(docs.select(names), window, phrase).select("_doc.*", *ADDED)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents
), s AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35
), h AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS m FROM s
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS n FROM h) WHERE n > 1
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r
), g AS (
  SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string([x[1] FOR x IN list_zip(ws, range(1, len(ws) + 1)) IF NOT list_contains(coalesce(gone, []), x[2])], ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
