"""Operator 12: byte-pair encoding and decoding with a contiguous rank array.

A text is cut into special tokens and words as the vocabulary file says. A
short word is an array of part boundaries and an array of the ranks of
adjacent parts: the least rank is sought by a scan, its boundary deleted, the
ranks beside it renewed, until no pair has a rank. Words over SHORT bytes would
take quadratic time so; there the same merges come from a heap of ranks.
Decoding joins the parts' bytes. The ids of a word are kept in a bounded cache.

Every row is encoded by itself, in Arrow batches of bounded size, without a
shuffle; a long text is read a SECTION at a time, cut where no word can
straddle. The vocabulary is read from its file once per Python worker.

Edge cases: a null text is empty and has no ids; repeated rows and ids stay as
they are; an empty table gives an empty result; texts and words of any length
are encoded whole; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, bounded_batches, kept, read_table

VOCABULARY = "byte_bpe_50k.json"
#: Words of byte-level vocabularies (fixed values): contractions, letters, numbers, other signs, white space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers that came after Unicode 16, first to last of each run (fixed values): to this vocabulary's classes they are other signs.
NEWER = (
    "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d "
    "107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 "
    "16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 "
    "1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff "
    "2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
_NEW = "".join("-".join(f"\\U{int(c, 16):08x}" for c in run.split("-")) for run in NEWER.split())


def words_pattern(letter: str, number: str) -> str:
    """WORDS with these classes; white space is told by its property, which Python's own class is wider than."""
    space = r"\p{White_Space}"
    found = WORDS.replace(r"[^\s\p{L}\p{N}]", "@").replace(r"\S", r"\P{White_Space}").replace(r"\s", space)
    return found.replace(r"\p{L}", letter).replace(r"\p{N}", number).replace("@", f"[^{space}{letter}{number}]")


_WORDS = regex.compile(words_pattern(r"\p{L}", r"\p{N}"))
_WORDS_NEW = regex.compile(words_pattern(rf"[\p{{L}}--[{_NEW}]]", rf"[\p{{N}}--[{_NEW}]]"), regex.V1)
_RUNS = np.array([[int(c, 16) for c in run.split("-")] for run in NEWER.split()], np.uint32)


def has_newer(text: str) -> bool:
    """Whether a character of NEWER occurs."""
    if text.isascii():
        return False
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    codes = codes[codes >= _RUNS[0, 0]]
    run = np.searchsorted(_RUNS[:, 0], codes, "right") - 1
    return bool((codes <= _RUNS[run, 1]).any())


_EDGE = regex.compile(r"(?<=\P{White_Space})\p{White_Space}")
#: Words of so many bytes at most are encoded by scans, and kept.
SHORT = 96
#: Characters of text that are cut into words at a time.
SECTION = 1 << 20
NO_RANK = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Parts of a word by scans over the rank array.

    ``ranks``: what a pair makes -> its rank * 2^16 + the length of its left part, which tells the pair from others of the same bytes.
    """
    n, get = len(word), ranks.get
    bounds = list(range(n + 1))
    near = [get(word[i : i + 2], NO_RANK) for i in range(n - 1)]
    while near:
        least = min(near)
        if least == NO_RANK:
            break
        i = near.index(least)
        del bounds[i + 1], near[i]
        a, b = bounds[i], bounds[i + 1]
        if i < len(near):
            rank = get(word[a : bounds[i + 2]], NO_RANK)
            near[i] = rank if rank & 0xFFFF == b - a else NO_RANK
        if i:
            left = bounds[i - 1]
            rank = get(word[left:b], NO_RANK)
            near[i - 1] = rank if rank & 0xFFFF == a - left else NO_RANK
    return [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same parts by a heap of (rank, place): n log n steps for n bytes."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the beginnings of a part's neighbours
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            rank = ranks.get(word[i : after[j]])
            if rank is not None and rank & 0xFFFF == j - i:
                heapq.heappush(heap, (rank, i, j, after[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if after[i] != j or after[j] != end:  # one of the two parts is gone or has grown
            continue
        after[i], after[j] = end, -1
        if end < n:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    parts, i = [], 0
    while i < n:
        parts.append(word[i : after[i]])
        i = after[i]
    return parts


class ShortWords(WordCache):
    """word -> its ids as 32-bit numbers; longer words are not kept."""

    def __missing__(self, word: str) -> bytes:
        return super().__missing__(word) if len(word) <= SHORT else self.make(word)


class BytePairs:
    """Encoder and decoder of one vocabulary file of a byte-level BPE without normalizer, prefix space or post-processing of ids."""

    def __init__(self, path: str | None = None):
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, before = told["model"], told["pre_tokenizer"] or {}
        odd = [t for t in told["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if told["normalizer"] or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or odd or model.get("ignore_merges"):
            raise ValueError(f"{path} asks for steps that this encoder doesn't have")
        of_letter = {c: b for b, c in enumerate(byte_letters())}
        raw = {token: bytes(map(of_letter.__getitem__, token)) for token in model["vocab"]}
        self.ids = {raw[token]: i for token, i in model["vocab"].items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {raw[a] + raw[b]: (rank << 16) + len(raw[a]) for rank, (a, b) in enumerate(pairs)}
        if len(self.ranks) < len(model["merges"]):
            raise ValueError(f"{path} makes one token of several pairs")
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.bytes: list[bytes] = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for part, i in self.ids.items():
            self.bytes[i] = part
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.packed = {part: np.int32(i).tobytes() for part, i in self.ids.items()}
        self.cache = ShortWords(self._packed_ids)

    def _packed_ids(self, word: str) -> bytes:
        raw = word.encode()
        parts = (merge_short if len(raw) <= SHORT else merge_long)(raw, self.ranks)
        return b"".join(map(self.packed.__getitem__, parts))

    def _sections(self, text: str) -> Iterator[str]:
        """Pieces of about SECTION characters that end before white space, where every word ends too."""
        at = 0
        while len(text) - at > SECTION:
            edge = _EDGE.search(text, at + SECTION)
            if not edge:
                break
            yield text[at : edge.start()]
            at = edge.start()
        yield text[at:]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, special tokens' strings as those tokens."""
        found: list[bytes] = []
        for k, piece in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                found.append(np.int32(self.special[piece]).tobytes())
                continue
            for section in self._sections(piece):
                words = (_WORDS_NEW if has_newer(section) else _WORDS).findall(section)
                found.append(b"".join(map(self.cache.__getitem__, words)))
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters, as always in such decoders."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _coder(path: str | None) -> BytePairs:
    return kept(("byte pairs", path), lambda: BytePairs(path))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every text; ``path`` is a vocabulary file that every executor has, by default the public one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in (part for whole in batches for part in bounded_batches(whole)):
            found = [coder.encode(text or "") for text in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text) of every row of ids; no ids are an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in (part for whole in batches for part in bounded_batches(whole)):
            ids = batch.column(1)
            flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            texts = [coder.decode(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(read_table(spark, sf_dir, "documents")))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
