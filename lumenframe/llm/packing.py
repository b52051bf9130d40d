"""Operator 3: best-fit packing by minimum bin slack.

Documents become token sequences; those over the limit are cut. Full pieces
are sequences of their own. The others are dealt at random into groups of
bounded size, and each group is packed by minimum bin slack: take the longest
piece left, find by a bitset subset-sum over the lengths still available the
fullest combination for the rest of the sequence, remove it, repeat. What the
groups leave in sequences that aren't full is dealt and packed a second time,
so that the groups cost hardly any room.

Edge cases: a null or empty text is one piece with the end id alone; repeated
rows are packed once each; a null doc_id stays null; an empty table gives an
empty result; ties go by id, piece and content; a very long text takes a few times its
own memory; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, byte_words, cut, kept, read_table

LIMIT = 4096
END_ID = 1
#: Pieces that are packed together; a group's last sequence may stay partly empty.
GROUP_PIECES = 1500
VOCABULARY = "word_bpe_49k.json"
#: Punctuation that cannot start a contraction or a special token, at the end of a word.
_TAIL = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
_LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([" + re.escape(_TAIL.decode()) + r"]*)")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def load_tokenizer(path: str | None = None):
    """The tokenizer of a vocabulary file; by default the public one named in VOCABULARY."""
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return Tokenizer.from_file(path)


class WordEncoder(WordCache):
    """word (UTF-8) -> its ids as little-endian bytes.

    The vocabulary never joins text across white space, so words are encoded one
    by one. Case is folded and a tail of punctuation is a token run of its own, so
    a word of ASCII letters is encoded once without either.
    """

    def __init__(self, tokenizer, limit: int = 300_000):
        super().__init__(self._whole, limit)
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.plain = WordCache(self._ids, 2 * limit)

    def _ids(self, raw: bytes) -> bytes:
        if raw.isalpha():  # one run of ASCII letters, which every step before the model leaves as it is
            return array("I", [t.id for t in self.model.tokenize(raw.decode().lower())]).tobytes()
        return np.asarray(self.tokenizer.encode(raw.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()

    def _whole(self, raw: bytes) -> bytes:
        letters = raw.rstrip(_TAIL)
        if letters.isalpha():  # of bytes: ASCII letters alone
            return self.plain[letters.lower()] + (self.plain[raw[len(letters) :]] if len(letters) < len(raw) else b"")
        m = _LATIN.fullmatch(raw.decode("utf-8"))
        if m:
            return self.plain[m[1].lower().encode()] + (self.plain[m[2].encode()] if m[2] else b"")
        return self._ids(raw)


def tokenize(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """Pieces of every document: ids of the text, then END_ID, cut after every ``limit`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept(("encoder", path), lambda: WordEncoder(load_tokenizer(path)))
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.frombuffer(b"".join(map(encode.__getitem__, byte_words(text))) + end, "<u4")
                for k in range(0, len(ids), limit):
                    part = ids[k : k + limit]
                    out.append((doc_id, k // limit, k, len(part), zlib.crc32(part.tobytes())))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Lengths (with repeats, as far as available) whose sum comes closest to ``room`` from below.

    ``lengths``: distinct lengths with a count, longest first. Bit s of ``reach``
    says that the sum s is possible; the search ends as soon as ``room`` is.
    """
    reach, mask, goal = 1, (1 << (room + 1)) - 1, 1 << room
    steps: list[tuple[int, int]] = []
    for n in lengths:
        if n > room:
            continue
        for _ in range(min(counts[n], room // n)):
            grown = (reach | (reach << n)) & mask
            if grown == reach:
                break
            steps.append((n, reach))
            reach = grown
        if reach & goal:
            break
    total, chosen = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        if not before >> total & 1:
            chosen.append(n)
            total -= n
    return chosen


def minimum_bin_slack(lengths: np.ndarray, limit: int = LIMIT) -> list[list[int]]:
    """Bins of row numbers. Rows of equal length are interchangeable, so the search runs over distinct lengths."""
    rows: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(lengths.tolist()):
        rows[n].append(i)
    counts = {n: len(r) for n, r in rows.items()}
    left = sorted(counts, reverse=True)
    bins = []
    while left:
        first = left[0]
        counts[first] -= 1
        picked = [first, *fullest(left, counts, limit - first)]
        for n in picked[1:]:
            counts[n] -= 1
        bins.append([rows[n].pop() for n in picked])
        if any(not counts[n] for n in picked):
            left = [n for n in left if counts[n]]
    return bins


def _pack_group(limit: int, round_no: int):
    def pack(table: pa.Table) -> pa.Table:
        # the same order whatever order the shuffle brought
        table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")])
        group, lengths = table.column("grp")[0].as_py(), table.column("length").to_numpy()
        seq, offset, full = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
        for k, rows in enumerate(minimum_bin_slack(lengths, limit)):
            at = np.concatenate([[0], np.cumsum(lengths[rows])])
            seq[rows], offset[rows], full[rows] = k, at[:-1], at[-1] == limit
        table = table.drop_columns(["grp"])
        table = table.append_column("sequence_id", pa.array((round_no << 60) + (group << 24) + seq))
        return table.append_column("offset", pa.array(offset)).append_column("full", pa.array(full))

    return pack


def _packed(pieces: DataFrame, limit: int, group_pieces: int, round_no: int, n: int) -> DataFrame:
    groups = max(1, -(-n // group_pieces))
    # the row number in the written table keeps repeated rows apart
    salt = F.xxhash64(F.lit(round_no), "doc_id", "piece", F.monotonically_increasing_id())
    return (
        pieces.withColumn("grp", F.pmod(salt, F.lit(groups)))
        .groupBy("grp")
        .applyInArrow(_pack_group(limit, round_no), PIECES + ", sequence_id long, offset long, full boolean")
    )


def pack(pieces: DataFrame, limit: int = LIMIT, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset; no sequence exceeds ``limit`` and none has gaps."""
    pieces = cut(pieces, "pieces")
    whole = pieces.where(F.col("length") == limit)
    rest = pieces.where(F.col("length") < limit)
    # a full piece is a sequence: ids from its document, made distinct by position for repeated rows
    whole = whole.withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(3 << 60)).withColumn("offset", F.lit(0).cast("long"))
    first = cut(_packed(rest, limit, group_pieces, 0, rest.count()), "packed")
    open_rows = first.where("not full").drop("sequence_id", "offset", "full")
    second = _packed(open_rows, limit, group_pieces, 1, open_rows.count()).drop("full")
    return whole.unionByName(first.where("full").drop("full")).unionByName(second)


def op3_pack_mbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tokenize(read_table(spark, sf_dir, "documents")))
