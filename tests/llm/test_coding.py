"""Vector codes, byte pairs and fill-in-middle against plain Python, exact round trips and the tokenizer library."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import byte_pairs, fill_middle, vector_codes

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()

# 11: codebooks by loops over Python's integers


def coded_by_loops(rows, parts, entries, rounds):
    """rows: (vec_id, vector, label), all usable; ids once each."""
    floors = {i: [math.floor(1024 * x) for x in v] for i, v, _ in rows}
    width = len(next(iter(floors.values()))) // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, v in floors.items()}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [(near(p, x[p])[1], x[p]) for x in cut.values()]
            for e in {e for e, _ in own}:
                mine = [x for k, x in own if k == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = {i: [near(p, x[p]) for p in range(parts)] for i, x in cut.items()}
    error = {i: sum(d for d, _ in f) for i, f in found.items()}
    label = {}
    for i, _, lab in rows:
        label[lab] = label.get(lab, 0) + error[i]
    digest = SHA(",".join(str(c) for book in books for entry in book for c in entry))
    return sorted((i, "".join(f"{e:02x}" for _, e in found[i]), error[i], label[lab], digest) for i, _, lab in rows)


def coded(spark, rows, entries=vector_codes.ENTRIES):
    vectors = spark.createDataFrame([(i, v, lab) for i, v, lab in rows], "vec_id long, vector array<double>, label int").repartition(3)
    vectors = vectors.where(vector_codes.usable(F.col("vector")))
    books, dims = vector_codes.train_codebooks(vectors, entries=entries)
    found = vector_codes.with_label_total(vector_codes.encode_vectors(vectors, books, dims)).collect()
    return books, [(r["vec_id"], r["code"].hex(), r["error"], r["label_error"]) for r in found]


@pytest.mark.parametrize("scale", [1.0, 1e7])  # the second needs more than 64 bits on the way to a distance
def test_vector_codes_equal_loops(spark, scale):
    r = random.Random(int(scale))
    rows = [(7 * i, [scale * r.gauss(0, 0.3) for _ in range(8)], r.choice([0, 0, 0, 1, None])) for i in range(60)]
    rows[9] = (63, rows[8][1], 1)  # equal vectors
    books, got = coded(spark, rows, entries=12)
    digest = SHA(",".join(map(str, books.ravel().tolist())))
    expected = coded_by_loops(rows, 4, 12, 4)
    if scale == 1:
        assert sorted((*x, digest) for x in got) == expected
    else:
        capped = [min(x[2], vector_codes.MOST) for x in expected]
        assert [(x[0], x[1], x[2]) for x in sorted(got)] == [(x[0], x[1], e) for x, e in zip(expected, capped, strict=True)] and digest == expected[0][4]


def test_vector_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 4, 1), (1, [0.25] * 4, 1), (None, [2.0] * 4, None), (2, None, 1), (3, [nan, 0.0, 0.0, 0.0], 1), (4, [0.0, None, 0.0, 0.0], 1), (5, [-inf] * 4, 1)]
    books, got = coded(spark, rows)
    assert books.shape == (4, 2, 1) and books[0].tolist() == [[(512 + 256) // 2], [2048]]
    assert sorted(got, key=str) == [(1, "00000000", 4 * 128**2, 8 * 128**2)] * 2 + [(None, "01010101", 0, 0)]
    books, got = coded(spark, [(1, [], 0), (2, [1.0], 0), (3, [1.0, 0.0, 0.0, 0.0, 3.0], 0)])  # padded to 8 numbers
    assert books.shape == (4, 3, 2) and sorted(x[1] for x in got) == ["00000000", "01000000", "01000200"]
    books, got = coded(spark, [(1, [1e300, -1e300, 0.0, 0.0], 0)])
    assert books[0, 0, 0] == vector_codes.MOST and books[1, 0, 0] == vector_codes.LEAST and got[0][1:] == ("00000000", 0, 0)
    assert coded(spark, [])[1] == []


def test_label_totals_by_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [0, 0, 0, 1, 2, None][i % 6], i) for i in range(60)], "vec_id long, label int, error long")
    expected = sorted(map(tuple, vector_codes.with_label_total(rows).select("vec_id", "label_error").collect()))
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(vector_codes, "HOT_LABELS", 2)
    assert sorted(map(tuple, vector_codes.with_label_total(rows).select("vec_id", "label_error").collect())) == expected and len(expected) == 60


# 12: the library


ODD = [
    "", " ", "\n", "  two  spaces ", "I'm we'll it's 'S x'd", "a b c\x85d\x1ce​f", "naïve Ünïcode 東京 😀👩‍👩‍👧 ½²٣", "՘࢏\U000323b0x",
    "<|endoftext|> and <|endoftext|><|endoft", "a" * 1000, "ab" * 3000 + " " + "é" * 500, " " * 700 + "x", "\t\t\n\r\n  x\n\n", "#$%" * 200, "1234567890" * 40, "x�￾y",
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(byte_pairs.VOCABULARY))


def probes():
    r = random.Random(6)
    kinds = [range(32, 127), range(0xA0, 0x250), range(0x3040, 0x30FF), range(0x1F300, 0x1F700), [9, 10, 13, 32, 0x2028, 0x3000], range(0x20, 0x3000), range(0x10000, 0x1E000)]
    found = ["".join(chr(r.choice(r.choice(kinds))) for _ in range(r.randrange(1, 400))) for _ in range(300)]
    return [t.encode("utf-8", "ignore").decode() for t in found] + ODD


def test_byte_pairs_equal_the_library(spark, library):
    texts = [*probes(), None]
    docs = spark.createDataFrame([(i, t, [i]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {r["doc_id"]: r for r in byte_pairs.decode(byte_pairs.encode(docs)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["text"] == library.decode(ids, skip_special_tokens=False) == (t or "")


def test_sections_scans_and_heap_agree(library, monkeypatch):
    coder = byte_pairs.BytePairs()
    whole = [coder.encode(t).tolist() for t in probes()]
    monkeypatch.setattr(byte_pairs, "SECTION", 7)
    assert [coder.encode(t).tolist() for t in probes()] == whole
    r = random.Random(2)
    for _ in range(300):
        word = bytes(r.choice(b"abeinrst ") for _ in range(r.randrange(1, 60)))
        assert byte_pairs.merge_short(word, coder.ranks) == byte_pairs.merge_long(word, coder.ranks)
    ids = [r.randrange(50257) for _ in range(400)]  # rarely UTF-8
    assert coder.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        byte_pairs.BytePairs(public_tokenizers.path("word_bpe_49k.json"))


# 13: the grammar by re


def transformed(doc_id, text, unit, rate, spm):
    text = text or ""
    units = re.findall(fill_middle.UNITS[unit][0], text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("unit", "rate", "spm"), [("lines", 100, 50), ("words", 60, 30), ("paragraphs", 100, 0)])
def test_fill_middle_equals_grammar(spark, unit, rate, spm):
    r = random.Random(3)
    pieces = ["\n", "\n\n", "a", "b c", " ", "\r\n", "\x0b", "😀", " ", "\x85", "<P", ">", "<S", "<M>", "é\n", "$1\\n"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(0, 25))) for _ in range(250)] + [None, "", "\n", "\n\n\n", "x", "x\n", "<S>", "a\n" * 20_000, "<P<S\n>M>"]
    rows = [(i if i % 40 else None, t) for i, t in enumerate(texts)]
    made = fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), unit=unit, rate=rate, spm_rate=spm)
    made = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    got = [(r["doc_id"], r["n"], r["form"], *(None if r[c] is None else len(r[c]) for c in ("prefix", "middle")), r["output"]) for r in made]
    assert sorted(got, key=str) == sorted(((i, *transformed(i, t, unit, rate, spm)) for i, t in rows), key=str)
    assert sorted(r["back"] for r in made) == sorted(t or "" for t in texts)
    assert {r["form"] for r in made} == ({"plain", "psm"} if spm == 0 else {"plain", "psm", "spm"})


def test_overlapping_markers_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("", "a", "b"), ("aba", "x", "y"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(docs, markers=bad)
