"""Operator 8: scoring by a weighted backoff automaton.

The model is a trigram model over all training documents, with every n-gram
they hold, whatever its count. Unigrams are add-one smoothed, ``(c + 1) /
(N + V + 1)``; above them a history shares its mass between its n-grams and the
shorter history in proportion to its count (a hierarchy of Dirichlet priors):
``P(w | h) = (c(hw) + k P(w | h')) / (c(h) + k)``. As an automaton: a state is a
history of up to two words, an arc is an n-gram with that weight, and a state
without an arc for the next word follows its failure arc, ``k / (c(h) + k)``, to
the shorter history. Each history's probabilities sum to one.

The whole automaton grows with the corpus and is nowhere in one place. Texts are
written once, in batches of word numbers. A batch asks the parts of the n-gram
table (dealt by key) for the counts of its own n-grams; a part adds up what all
batches counted and answers each in the order of its question, so keys travel
one way. From the answers a batch compiles its own part of the automaton, which
holds every arc that its texts can take, and traverses its texts left to right,
side by side, each with its state.

Words have 64-bit keys. Keys of longer n-grams have ``SPARE_BITS`` more than the
logarithm of the number of tokens: one in 2^SPARE_BITS may share another's count.
Questions and answers are sorted, coded as differences and compressed.

Edge cases: a null or empty text is its end token alone; a null doc_id trains
and is scored; repeated rows are counted and scored as they come; a text of any
length is read in slices, is a batch of its own beyond ``BATCH_TOKENS``, and is
cut into runs for the traversal, each begun two words early to have its state;
with no training document all counts are 0 and every token scores log10(1) = 0;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, fold, hash_word, mix, read_table, text_hashes

HELD = (7, 2)
#: Tokens of a batch.
BATCH_TOKENS = 700_000
#: About so many n-grams of batches meet in a part of the table.
PART_RECORDS = 1_000_000
#: Weight of the shorter history, in counts, for histories of one and of two words.
STRENGTH = (300.0, 5.0)
SPARE_BITS = 12
#: Words of a long text that are traversed in one run.
RUN = 512
#: The end token's key; no word holds a space.
END_KEY = np.uint64(hash_word(b"</s> "))
BATCH = "batch long, doc_id array<long>, trained array<boolean>, lengths array<long>, ids binary, words binary"


def token_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Keys of the tokens of every text; bytes.lower() changes A-Z alone."""
    return [np.append(h, END_KEY) for h in text_hashes(texts, bytes.lower)]


def pack_numbers(x: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes, as many as the largest needs."""
    planes = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    rows = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T)
    return bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(rows.tobytes())


def unpack_numbers(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8")[:, 0]


def batches_of(docs: DataFrame, most: int | None = None) -> DataFrame:
    """Texts in batches (``BATCH``): word numbers in text order, and the words' keys. ``docs``: doc_id, text, trained."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, held, size = TaskContext.get().partitionId(), 0, 0, most or BATCH_TOKENS
        parts, rows = [], []

        def flush() -> pa.RecordBatch:
            nonlocal at
            found, first, ids, times = np.unique(np.concatenate(parts), return_index=True, return_inverse=True, return_counts=True)
            often = np.lexsort((first, -times))  # common words get small numbers, which compress
            rank = np.empty(len(often), np.int64)
            rank[often] = np.arange(len(often))
            doc_id, trained, lengths = zip(*rows, strict=True)
            cols = [(task << 32) + at, doc_id, trained, lengths, pack_numbers(rank[ids]), found[often].tobytes()]
            at += 1
            parts.clear()
            rows.clear()
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, kinds, strict=True)], names=["batch", "doc_id", "trained", "lengths", "ids", "words"])

        for batch in (part for whole in batches for part in bounded_batches(whole)):
            texts = token_hashes(batch.column("text").to_pylist())
            for doc_id, trained, found in zip(batch.column("doc_id").to_pylist(), batch.column("trained").to_pylist(), texts, strict=True):
                parts.append(found)
                rows.append((doc_id, trained, len(found)))
                held += len(found)
                if held >= size:
                    yield flush()
                    held = 0
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "trained").mapInArrow(run, BATCH)


class Grams:
    """The distinct n-grams of a batch and where they stand.

    ``pairs``: codes first * V + last by local number; ``threes``: codes pair * V + last. ``order`` sorts the keys of
    pairs and threes together, ``keys`` is that order. ``counts1`` and ``counts`` (in the order of ``keys``) count the trained texts.
    """

    def __init__(self, ids: bytes, words: bytes, lengths: np.ndarray, trained: np.ndarray, bits: int):
        t, self.words = unpack_numbers(ids).astype(np.int64), np.frombuffer(words, np.uint64)
        v, n = len(self.words), len(t)
        self.lengths, self.own = lengths, np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        counted = trained[self.own]
        self.ids, self.counts1 = t.astype(np.int32), np.bincount(t[counted], minlength=v)
        inner = self.own[1:] == self.own[:-1]
        self.pairs, found = np.unique((t[:-1] * v + t[1:])[inner], return_inverse=True)
        self.pair_at = np.zeros(n, np.int32)  # the pair that ends at a place; 0 where none does, which fits no state there
        self.pair_at[1:][inner] = found
        counts2 = np.bincount(found[counted[1:][inner]], minlength=len(self.pairs))
        deep = inner[1:] & inner[:-1]
        self.threes, found = np.unique((self.pair_at[1:-1] * np.int64(v) + t[2:])[deep], return_inverse=True)
        self.three_at = np.zeros(n, np.int32)
        self.three_at[2:][deep] = found
        self.last = np.empty(len(self.threes), np.int32)  # the pair that a three ends with
        self.last[found] = self.pair_at[2:][deep]
        counts3 = np.bincount(found[counted[2:][deep]], minlength=len(self.threes))
        del t, found, counted, inner, deep
        join = lambda a, b, n: mix(mix(a * np.uint64(0x9E3779B97F4A7C15) + b) + np.uint64(n))
        two = join(self.words[self.pairs // v], self.words[self.pairs % v], 2)
        three = join(two[self.threes // v], self.words[self.threes % v], 3)
        keys = np.concatenate([two, three]) >> np.uint64(64 - bits)
        del two, three
        self.order = np.argsort(keys).astype(np.int32)
        self.keys, self.counts = keys[self.order], np.concatenate([counts2, counts3])[self.order]


def _grams(row: dict, bits: int) -> Grams:
    return Grams(row["ids"], row["words"], np.array(row["lengths"], np.int64), np.array(row["trained"], bool), bits)


def questions(table: DataFrame, what: str, bits: int, parts: int) -> DataFrame:
    """(batch, part, keys, counts): what each batch counted of its words or longer n-grams, by key range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if what == "words":
                    words = np.frombuffer(row["words"], np.uint64)
                    order = np.argsort(words)
                    ids = unpack_numbers(row["ids"]).astype(np.int64)
                    counts = np.bincount(ids[np.repeat(np.array(row["trained"], bool), row["lengths"])], minlength=len(words))
                    keys, counts = words[order], counts[order]
                else:
                    grams = _grams(row, bits)
                    keys, counts = grams.keys, grams.counts
                    del grams
                shift = np.uint64(bits - parts.bit_length() + 1)
                at = np.searchsorted(keys >> shift if parts > 1 else np.zeros(len(keys), np.uint64), np.arange(parts + 1, dtype=np.uint64))
                out = []
                for p in range(parts):
                    part = keys[at[p] : at[p + 1]]
                    if len(part):
                        steps = np.diff(part, prepend=np.uint64((p << int(shift)) if parts > 1 else 0))
                        out.append((row["batch"], p, pack_numbers(steps), pack_numbers(counts[at[p] : at[p + 1]])))
                del keys, counts
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                    cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names=["batch", "part", "keys", "counts"])

    wanted = table if what != "words" else table.select("batch", "trained", "lengths", "ids", "words")
    return wanted.mapInArrow(run, "batch long, part long, keys binary, counts binary")


def answers(asked: DataFrame, bits: int, parts: int) -> DataFrame:
    """(batch, part, counts, seen): for every question, the counts over all batches; one row a part says how many keys occur."""
    shift = bits - parts.bit_length() + 1

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("batch")
        part = table.column("part")[0].as_py()
        start = np.uint64((part << shift) if parts > 1 else 0)
        keys = [start + np.cumsum(unpack_numbers(x)) for x in table.column("keys").to_pylist()]
        own = np.concatenate([unpack_numbers(x) for x in table.column("counts").to_pylist()])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, weights=own).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        out = [pack_numbers(sums[at[e - len(k) : e]]) for k, e in zip(keys, ends.tolist(), strict=True)]
        seen = [int((sums > 0).sum())] + [0] * (len(keys) - 1)
        return pa.table({"batch": table.column("batch"), "part": table.column("part"), "counts": pa.array(out, pa.binary()), "seen": pa.array(seen, pa.int64())})

    return asked.groupBy("part").applyInArrow(run, "batch long, part long, counts binary, seen long")


class Automaton:
    """A batch's automaton. States: 0 the empty history, 1 + w a word, 1 + V + p a pair.

    Arcs are numbered as words, pairs and threes are, one after another: ``source`` (-1 where the n-gram does not occur in
    training), ``weight`` (log10) and ``target`` by arc, ``back`` and ``fail`` by state.
    """

    def __init__(self, grams: Grams, counts1: np.ndarray, counts: np.ndarray, total: int, vocab: int, strength: tuple = STRENGTH):
        v, pairs, threes = len(grams.words), grams.pairs, grams.threes
        plain = np.empty_like(counts)
        plain[grams.order] = counts
        c2, c3 = plain[: len(pairs)], plain[len(pairs) :]
        k2, k3 = strength
        a, b = pairs // v, pairs % v
        first = threes // v
        p1 = (counts1 + 1.0) / (total + vocab + 1.0)
        p2 = (c2 + k2 * p1[b]) / (counts1[a] + k2)
        p3 = (c3 + k3 * p2[grams.last]) / (c2[first] + k3)
        self.deep = np.array([1, 1 + v])  # the first states of one and of two words
        self.source = np.concatenate([np.zeros(v, np.int32), np.where(c2 > 0, 1 + a, -1), np.where(c3 > 0, 1 + v + first, -1)], dtype=np.int32, casting="unsafe")
        self.weight = np.log10(np.concatenate([p1, p2, p3]))
        self.target = np.concatenate([np.where(counts1 > 0, 1 + np.arange(v), 0), 1 + v + np.arange(len(pairs)), 1 + v + grams.last], dtype=np.int32, casting="unsafe")
        self.back = np.log10(np.concatenate([[1.0], k2 / (counts1 + k2), k3 / (c2 + k3)]))
        self.fail = np.concatenate([np.zeros(1 + v, np.int32), 1 + b], dtype=np.int32, casting="unsafe")
        # the arc that each place would take from a state of no, one or two words
        self.arcs = np.stack([grams.ids, grams.pair_at + np.int32(v), grams.three_at + np.int32(v + len(pairs))])

    def step(self, states: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 weights, next states) of one step from each state by the word at its place, along failure arcs until an arc fits."""
        at = self.arcs[np.searchsorted(self.deep, states, "right"), places]
        miss = np.flatnonzero(self.source[at] != states)
        weights, after = self.weight[at], self.target[at]
        if len(miss):
            lower, after[miss] = self.step(self.fail[states[miss]], places[miss])  # the empty history has an arc for every word
            weights[miss] = self.back[states[miss]] + lower
        return weights, after

    def traverse(self, lengths: np.ndarray, run: int = RUN) -> np.ndarray:
        """log10 weights of the texts, walked left to right side by side; runs of a long text start early to have their state."""
        pieces = np.maximum(1, -(-lengths // run))
        text = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        early = np.minimum(2, nth * run)
        begin = (np.cumsum(lengths) - lengths)[text] + nth * run - early
        steps = np.minimum(run, lengths[text] - nth * run) + early
        order = np.argsort(-steps, kind="stable")
        begin, early, steps = begin[order], early[order], steps[order]
        states, sums = np.zeros(len(order), np.int32), np.zeros(len(order))
        for t in range(int(steps[0]) if len(steps) else 0):
            n = int(np.searchsorted(-steps, -t))  # those with more than t steps
            weights, states[:n] = self.step(states[:n], begin[:n] + t)
            sums[:n] += weights if t >= 2 else np.where(early[:n] <= t, weights, 0.0)
        return np.bincount(text[order], weights=sums, minlength=len(lengths))


def scored(table: DataFrame, words: DataFrame, grams: DataFrame, bits: int, total: int, vocab: int) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, base_score, score) of every text, batch by batch."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("kind", "ascending"), ("part", "ascending")])
        row = rows.slice(0, 1).to_pylist()[0]
        kinds, blobs = rows.column("kind").to_pylist(), rows.column("counts").to_pylist()
        got = [[unpack_numbers(x) for k, x in zip(kinds, blobs, strict=True) if k == kind] for kind in (1, 2)]
        held = _grams(row, bits)
        counts1 = np.empty(len(held.words), np.int64)
        counts1[np.argsort(held.words)] = np.concatenate(got[0])
        counts = np.concatenate(got[1]).astype(np.int64) if got[1] else np.empty(0, np.int64)
        known, n = counts1[held.ids] > 0, len(held.lengths)
        base = np.log10((counts1 + 1.0) / (total + vocab + 1.0))
        walked = Automaton(held, counts1, counts, total, vocab).traverse(held.lengths)
        return pa.table(
            {
                "doc_id": pa.array(row["doc_id"], pa.int64()),
                "trained": pa.array(row["trained"], pa.bool_()),
                "n_tokens": held.lengths,
                "n_known": np.bincount(held.own[known], minlength=n),
                "base_score": np.bincount(held.own, weights=base[held.ids], minlength=n),
                "score": walked,
            }
        )

    none = F.lit(None)
    texts = table.select("batch", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("part"), none.cast("binary").alias("counts"), "doc_id", "trained", "lengths", "ids", "words")
    answer = lambda df, kind: df.select("batch", F.lit(kind).alias("kind"), "part", "counts", *[none.cast(texts.schema[c].dataType).alias(c) for c in texts.columns[4:]])
    rows = texts.unionAll(answer(words, 1)).unionAll(answer(grams, 2))
    return rows.groupBy("batch").applyInArrow(run, "doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double")


def parts_for(records: float) -> int:
    """A power of two, so that a part has about PART_RECORDS."""
    return 1 << max(0, math.ceil(math.log2(max(1.0, records) / PART_RECORDS)))


def language_model(docs: DataFrame, trained: Column) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score) of every row, learned from those with ``trained``."""
    table = cut(batches_of(docs.withColumn("trained", trained)), "batches")
    sizes = table.select(F.explode(F.arrays_zip("lengths", "trained")).alias("x"), F.lit(0).alias("w")).agg(
        F.sum("x.lengths").alias("all"), F.sum(F.when(F.col("x.trained"), F.col("x.lengths"))).alias("total")
    )
    size, total = (x or 0 for x in sizes.head())
    distinct = table.agg(F.sum(F.octet_length("words") / 8)).head()[0] or 0
    parts = parts_for(distinct)
    words = cut(answers(questions(table, "words", 64, parts), 64, parts), "word-counts")
    vocab = words.agg(F.sum("seen")).head()[0] or 0
    bits = min(64, max(1, size).bit_length() + 2 + SPARE_BITS)
    parts = parts_for(2 * size)
    grams = answers(questions(table, "grams", bits, parts), bits, parts)
    return scored(table, words, grams, bits, total, vocab).withColumn("train_tokens", F.lit(total).cast("long"))


def op8_lm_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    got = language_model(docs, ~fold(F.col("doc_id"), *HELD))
    return got.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", (F.col("score") / F.col("n_tokens")).alias("score_per_token"))

