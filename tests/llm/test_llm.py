"""The training-data operators against brute force, round trips and held-out accuracy on small tables."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import common, decontaminate, html_extract, jaccard_join, language_id, packing
from lumenframe.llm import quality_crf, quality_rules, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def prose(n, r):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(1)
    texts = [prose(r.randint(60, 200), r) for _ in range(40)]
    passage = prose(60, r)
    texts += [texts[0], texts[0], texts[1] + " " + prose(3, r), f"{prose(50, r)}\n{passage}\n{prose(50, r)}", f"{passage} {prose(40, r)}"]
    texts += [" ".join(["la"] * 90), "line one here\nline one here\n\nother line\n" * 20, "", None, "   \n\t", "word", "a b c", "a b c"]
    texts += ["Käse*** über### 99 &&& " * 30, prose(6000, r), "x\x1cy\x85z w " + prose(40, r)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[5], "en", "s", 3)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    return sorted((tuple(r[c] for c in ("doc_id", *cols)) for r in df.collect()), key=str)


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, label int")


# 7: quality rules


def base(text):
    w = words(text)
    three = list(zip(w, w[1:], w[2:], strict=False))
    times = collections.Counter(three)
    repeated = {j for i, x in enumerate(three) if times[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_rules_base_columns_and_ratio(spark, corpus, docs):
    trusted = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    got = quality_rules.score_documents(docs, trusted, buckets=512)
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert by_id(got, *cols) == sorted([(r[0], *base(r[1])) for r in corpus], key=str)
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= quality_rules.THRESHOLD)
    # the ratio by brute force from the same buckets
    grams = {}
    rows = docs.select("doc_id", quality_rules.words(F.col("text")).alias("w")).select("doc_id", quality_rules.ngram_buckets("w", 512).alias("g"))
    raw, target = collections.Counter(), collections.Counter()
    for r in rows.collect():
        grams.setdefault(r["doc_id"], r["g"])
        raw.update(r["g"])
        if r["doc_id"] is not None and r["doc_id"] < 20:
            target.update(r["g"])
    n, m, s = sum(raw.values()), sum(target.values()), quality_rules.SMOOTHING * 512
    w = {b: math.log((target[b] + s * c / n) / (m + s) / (c / n)) for b, c in raw.items()}
    for r in got.collect():
        g = grams[r["doc_id"]]
        assert r["llr"] == pytest.approx(sum(w[b] for b in g) / len(g) if g else 0.0, abs=1e-4)


def test_rules_without_trusted_and_extra_columns(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long")
    got = quality_rules.score_documents(docs.withColumn("kept", F.lit("x")), none, buckets=64)
    assert {r["llr"] for r in got.collect()} == {0.0}
    assert quality_rules.score_documents(empty, none, buckets=64).count() == 0
    kept = quality_rules.keep_documents(docs.withColumn("kept", F.lit("own")).withColumn("_words", F.lit(1)), none)
    assert kept.columns == [*docs.columns, "kept", "_words"] and 0 < kept.count() < docs.count()
    assert kept.select("kept").distinct().head()[0] == "own"


# 3: packing


def test_packing_round_trip(docs, corpus, empty):
    tok = packing.load_tokenizer()
    got = [r.asDict() for r in packing.pack(packing.tokenize(docs, limit=256), limit=256, group_pieces=20).collect()]
    expected = []
    for doc_id, text, *_ in corpus:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            expected.append((doc_id, k // 256, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    cols = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=str) == sorted(expected, key=str)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-sum(r["length"] for r in got) // 256) + 6
    assert packing.pack(packing.tokenize(empty)).count() == 0


def test_word_encoder_equals_whole_text():
    tok, r = packing.load_tokenizer(), random.Random(3)
    encode = packing.WordEncoder(tok, limit=50)
    pieces = ["It's", "A", "thatthtieror", "HELLO", "Re.", "naïve,", "don't!!", "Große", "ÉLAN,", "x<|endoftext|>y", "éte", "12,5%", "İstanbul", "ΣΑΣ", "a\x1cb", "日本語", "…", "hello...", "'ll", "(a)'s"]
    for _ in range(60):
        text = "".join(r.choice(pieces) + r.choice([" ", "\n", "\t ", "  "]) for _ in range(30))
        ids = np.frombuffer(b"".join(map(encode.__getitem__, common.byte_words(text))), "<u4").tolist()
        assert ids == tok.encode(text, add_special_tokens=False).ids


def test_fullest_matches_exhaustive():
    r = random.Random(2)
    for _ in range(200):
        items = [r.randint(1, 30) for _ in range(8)]
        counts = collections.Counter(items)
        room = r.randint(1, 90)
        sums = {sum(x for k, x in enumerate(items) if mask >> k & 1) for mask in range(256)}
        chosen = packing.fullest(sorted(counts, reverse=True), counts, room)
        assert sum(chosen) == max(s for s in sums if s <= room)
        assert not collections.Counter(chosen) - counts


# 6: substring dedup


def strip(rows, n):
    lists = [words(r[1]) for r in rows]
    times = collections.Counter(tuple(w[i : i + n]) for w in lists for i in range(len(w) - n + 1))
    out = []
    for r, w in zip(rows, lists, strict=True):
        gone = {j for i in range(len(w) - n + 1) if times[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((r[0], len(w), len(gone), left))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "phrase"), [(35, 18), (5, 3)])
def test_substring_dedup_equals_brute_force(docs, corpus, empty, n, phrase):
    got = substring_dedup.remove_repeats(docs.withColumn("n_words", F.lit("clash")), window=n, phrase=phrase)
    assert by_id(got, "n_words", "n_removed", "kept") == strip(corpus, n)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_run_hashes_depend_on_content_alone():
    h = np.random.default_rng(1).integers(0, 1 << 62, 500, dtype=np.uint64)
    h[300:400] = h[100:200]
    for n in (1, 2, 3, 5, 18, 35):
        x = substring_dedup.run_hashes(h, n)
        assert len(x) == 501 - n and (x[300 : 401 - n] == x[100 : 201 - n]).all()
        assert len(np.unique(x)) == len({tuple(h[i : i + n]) for i in range(501 - n)})
        m = substring_dedup.window_minima(h, n)
        assert m.tolist() == [h[i : i + n].min() for i in range(501 - n)]


# 10: Jaccard join


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)} if w else set()


def test_jaccard_join_equals_brute_force(spark, empty):
    r = random.Random(9)
    seed = prose(120, r).split()
    texts = []
    for _ in range(150):  # one loose group, larger than a block
        w = seed.copy()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(VOCAB)
        texts.append(" ".join(w))
    texts += [prose(r.randint(1, 40), r) for _ in range(40)] + ["a b", "a b", "a b c d", None, "", "\t"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(3, texts[3], None, None, None)]
    got = {}
    for x in jaccard_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect():
        got[x["doc_id"]] = x
    sets = [shingle_set(t) for _, t, *_ in rows]
    links, group = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both / len(sets[a] | sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                ga, gb = group[a], group[b]
                group = [min(ga, gb) if g in (ga, gb) else g for g in group]
    found = sum(x["n_links"] for x in got.values())
    assert found >= 0.995 * sum(links[: len(texts)])
    for i in range(len(texts)):
        assert got[i]["class_id"] == rows[group[i]][0]
        assert got[i]["n_links"] <= links[i]
    assert jaccard_join.near_duplicates(empty).count() == 0
    kept = jaccard_join.keep_first(spark.createDataFrame(rows, SCHEMA))
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted({rows[g][0] for g in group})


# 5: decontamination


def test_decontamination(spark, docs, empty):
    item = "A train travels 120 miles in 3 hours with Anna and later Anna drives another 80 miles alone. How fast was she then in total?"
    same = item.replace("120", "75").replace("Anna", "Berta")
    torn = item.replace("Anna", "Berta", 1).replace("Anna", "Clara")  # one slot value becomes two
    bench = spark.createDataFrame([(1, item), (2, "short one only"), (3, None), (4, "six words are a whole item"), (5, "")], "item_id long, text string")
    rows = [(1, f"intro words here. {item} tail"), (2, f"other text. {same}"), (3, torn + " odd"), (4, "nothing at all alike in this one " * 5), (5, None), (6, ""), (7, "So SIX words, are a whole item!")]
    rows += [(1, rows[0][1]), (None, item)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1), (2, 1), (7, 4), (None, 1)}
    table = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    assert sorted(str(r["doc_id"]) for r in decontaminate.drop_contaminated(table, bench).collect()) == ["3", "4", "5", "6"]  # a row without id is judged by its text too
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_by_shuffle_join(spark, monkeypatch):
    r = random.Random(4)
    item = prose(40, r)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{prose(20, r)} {item}"), (2, prose(60, r))], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 1)
    assert [(r["doc_id"], r["cover"]) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 1.0)]


# 9: language identification


def test_language_id(spark, empty):
    r = random.Random(6)
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    rows = [(i, " ".join("".join(r.choice(a) for _ in range(5)) for _ in range(8)), lang) for i, (lang, a) in enumerate(list(alphabets.items()) * 20)]
    odd = [(1000, None, "aa"), (1001, "123 !!", "aa"), (1002, "", None), (None, "abc abc", "aa"), (1003, "x" * 3_000_000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    langs, matrix = language_id.train(docs)
    assert langs == ["aa", "bb", "cc"]
    got = {x["doc_id"]: x for x in language_id.predict(docs, langs, matrix).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert language_id.train(docs.limit(0))[0] == []
    assert {x["lang_pred"] for x in language_id.predict(docs, [], np.zeros((4, 0))).collect()} == {"und"}
    assert language_id.predict(empty, langs, matrix).count() == 0


def test_ngram_counts_do_not_depend_on_blocks(monkeypatch):
    text = prose(300, random.Random(1))
    whole = language_id.ngram_counts(text)
    monkeypatch.setattr(language_id, "BLOCK", 64)
    assert (language_id.ngram_counts(text) == whole).all() and whole.sum() == 3 * len(text) - 3


# 1 and 4: classifiers


def test_toxicity_held_out(spark, docs, empty):
    r = random.Random(8)
    rows = [(i, prose(40, r) + (" vile" + r.choice(["ness", "ly", "st", "x"]) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = table.where("doc_id < 450").select("doc_id", "label")
    weights = toxicity.fit(table, labels)
    assert 0 < len(weights) < 5000
    got = {x["doc_id"]: x["score"] for x in toxicity.score(table, weights).collect()}
    assert all((got[i] >= toxicity.CUTOFF) == bool(y) for i, _, y in rows if i >= 450)
    edge = toxicity.score(docs, weights).collect()
    assert len(edge) == docs.count() and all(0 <= x["score"] <= 1 for x in edge)
    assert {x["score"] for x in toxicity.score(docs, toxicity.fit(docs, no_labels(spark))).collect()} == {0.0}
    assert toxicity.score(empty, weights).count() == 0


def test_quality_crf_held_out(spark, docs, empty):
    r = random.Random(8)

    def text(bad):
        lines = [prose(12, r) for _ in range(6)]
        return "\n".join(" ".join(w + "$$$" for w in x.split()) if bad and k else x for k, x in enumerate(lines))

    rows = [(i, text(i % 3 == 0), int(i % 3 != 0)) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    params = quality_crf.fit(table, table.where("doc_id < 240").select("doc_id", "label"), shards=2)
    got = {x["doc_id"]: x["score"] for x in quality_crf.score(table, params).collect()}
    assert all((got[i] >= quality_crf.CUTOFF) == bool(y) for i, _, y in rows if i >= 240)
    edge = {x["doc_id"]: x["score"] for x in quality_crf.score(docs, params).collect()}
    assert all(0 <= x <= 1 for x in edge.values())
    flat = quality_crf.fit(docs, no_labels(spark))
    assert {round(x["score"], 9) for x in quality_crf.score(docs, flat).collect()} == {0.0, 0.5}
    assert quality_crf.score(empty, params).count() == 0


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(3)
    emit, trans = r.normal(size=(1, 5, 2)), r.normal(size=(2, 2))
    paths = np.array(np.meshgrid(*[[0, 1]] * 5)).T.reshape(-1, 5)
    weight = np.array([math.exp(emit[0, range(5), p].sum() + trans[p[:-1], p[1:]].sum()) for p in paths])
    weight /= weight.sum()
    marginal, pairs = quality_crf.forward_backward(emit, np.ones((1, 5), bool), trans)
    assert np.allclose(marginal[0, :, 1], [(weight * paths[:, t]).sum() for t in range(5)])
    assert np.isclose(pairs[0, 1], sum((weight * ((paths[:, t] == 0) & (paths[:, t + 1] == 1))).sum() for t in range(4)))


# 2: page extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<header><a href="/">Home</a></header><nav><ul><li><a href="x">One</a><li><a href="y">Two</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Big &amp; bold</h1><p>First  <b>para</b>graph of&nbsp;the<br>text goes on for many words here.<p>Second one, also with many words in it.
<aside>ignore this</aside><div class="ad">Buy now</div><form><input value="x">Mail</form></p></article>
<section id="comments"><p>I liked it</p></section><footer>&copy; me</footer></body></html>"""


def test_extraction(spark):
    pages = [(i, f"u{i}", PAGE) for i in range(30)]
    odd = [(100, None, None), (None, "u", ""), (102, "u", "plain words only"), (103, "u", "<p>cut off &am"), (0, "u0", PAGE), (104, "u", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    table = spark.createDataFrame(pages + odd, "page_id long, url string, html string")
    weights = html_extract.fit(table)
    got = html_extract.extract_pages(table, weights).collect()
    assert len(got) == len(pages) + len(odd)
    text = "Big & bold\nFirst paragraph of the text goes on for many words here.\nSecond one, also with many words in it."
    found = collections.defaultdict(set)
    for r in got:
        found[r["page_id"]].add(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert found[0] == {text} and found[29] == {text}
    assert found[100] == {""} and found[None] == {""} and found[102] == {"plain words only"} and found[104] == {"deep"}
    assert html_extract.fit(table.limit(0)) == {} and html_extract.extract("<p>a b</p>", {}) == "a b"


def test_best_region_is_the_maximum():
    r = random.Random(1)
    for _ in range(100):
        s = [r.randint(-5, 5) for _ in range(12)]
        a, b = html_extract.best_region(s)
        assert sum(s[a:b]) == max(0, max(sum(s[i:j]) for i in range(12) for j in range(i + 1, 13)))


# the pipeline on a small directory


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(2)
    texts = [prose(150, r) for _ in range(30)]
    passage, leak = prose(80, r), prose(40, r)
    texts[1] = texts[0]
    texts[2] = " ".join(["new", *texts[0].split()[1:]])
    texts[3] += " " + passage
    texts[4] = passage + " " + texts[4]
    texts[5] += " " + leak
    texts += ["too short", None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    clashing = {"kept": F.lit("own"), "n_words": F.lit(-1), "k1": F.lit("k"), "copies": F.lit(0), "_row": F.lit(None).cast("int")}
    spark.createDataFrame(rows, SCHEMA).withColumns(clashing).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == [*[c.split()[0] for c in SCHEMA.split(", ")], *clashing]
        assert docs.select("kept", "n_words", "k1", "copies", "_row").distinct().collect() == [("own", -1, "k", 0, None)]
        kept.append({x["doc_id"]: x["text"] for x in docs.collect()})
    assert set(kept[0]) == set(range(30)) and set(kept[1]) == set(kept[0]) - {1, 2}
    assert set(kept[2]) == set(kept[1]) and kept[2][6] == texts[6] and passage not in kept[2][3] and texts[4].endswith(kept[2][4])
    assert set(kept[3]) == set(kept[2]) - {5}
    final = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(final["doc_id"]) == set(kept[3])


def test_sample_is_bounded(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    assert 800 < common.bounded_sample(df, "doc_id", 1_000).count() < 1_200
    assert common.bounded_sample(df, "doc_id", 30_000).count() == 20_000
