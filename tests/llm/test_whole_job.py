"""Cases in which an operator once did less than its whole job."""

import random

import pytest

from lumenframe.llm import decontaminate, html_extract, jaccard_join, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, r, size=300):
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def test_quality_verdicts_are_the_same_at_every_size(spark):
    r = random.Random(5)
    for n in (300, 2400):
        texts = [prose(120, r) for _ in range(n)] + [" ".join(f"junk{r.randrange(300)}" for _ in range(120)) for _ in range(n // 8)]
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
        kept = {x["doc_id"] for x in quality_rules.keep_documents(docs, docs.where(f"doc_id < {n // 2}").select("doc_id")).collect()}
        assert len(kept & set(range(n))) >= 0.99 * n and max(kept) < n


def test_borderline_links_do_not_depend_on_a_large_group(spark):
    r = random.Random(7)
    seed = prose(200, r, 10_000).split()
    texts = []
    for i in range(150):  # 11,175 links of high similarity
        w = seed.copy()
        w[r.randrange(200)] = f"x{i}"
        texts.append(" ".join(w))
    for i in range(1500):  # 8 of 10 shingles are shared
        common = prose(12, r, 1_000_000)
        texts += [f"{common} a{i}", f"{common} b{i}"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {x["doc_id"]: x["n_links"] for x in jaccard_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert min(got[i] for i in range(150)) == 149
    lost = sum(got[i] != 1 for i in range(150, len(texts))) // 2
    assert lost <= 2


def test_verbatim_copies_match_where_templates_do_not(spark):
    items = [(1, "12 + 30 = 42, 7 * 8 = 56, 90 / 3 = 30"), (2, "Name two primes"), (3, "Which river flows through old Vienna?"), (4, "Der Hund und die Katze sehen den Vogel im Garten")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(1, f"so {items[0][1]} then"), (2, "please name two primes now"), (3, f"Question: {items[2][1]}"), (4, items[3][1].lower()), (5, "none of these at all, name two others")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == {(1, 1), (2, 2), (3, 3), (4, 4)}


@pytest.mark.parametrize("wrapper", ["<div class='page with-sidebar'>", "<div id='content-with-nav'>", "<section class='post has-comments'>", "<div class='menu-layout'>"])
def test_wrappers_named_after_a_neighbour_keep_their_article(wrapper):
    page = f"{wrapper}<article><div class='post-header'><h1>The head</h1></div><p>some words of text</p><div class='ad-slot'>buy</div></article><div class='sidebar'>other</div>"
    weights = {"w:": 1.0, "div": -0.1, "/div": -0.1, "article": -0.1, "/article": -0.1, "p": -0.1, "/p": -0.1, "h1": -0.1, "/h1": -0.1, "section": -0.1}
    assert html_extract.extract(page, weights) == "The head\nsome words of text"


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("<article><p><a>Alan Turing</a> was <a>a</a> mathematician.</p></article>", "Alan Turing was a mathematician."),
        ("<article><table><tr><td>one</td><td>two</td></tr></table><p>some words of text</p></article>", "one\ntwo\nsome words of text"),
        ("<article><p>Some text.</p><section class='related work'><h2>Related work</h2><p>Others did it.</p></section></article>", "Some text.\nRelated work\nOthers did it."),
        ("<article><p>A <math><mi>x</mi></math> and <object>an object</object></p></article>", "A x and an object"),
        ("<article><p>Items are</p><ul><li>one</li><li>two things</li><li>three</li></ul></article>", "Items are\none\ntwo things\nthree"),
        ("<article><p>a b c</p><nav><ul>" + "<li><a>x</a></li>" * 30 + "</ul></nav><p>d e f</p></article>", "a b c\nd e f"),
        ("<div><div><ul>" + "<li><a>Menu item</a></li>" * 5 + "</ul></div><div><p>main words of the page go on and on</p><ul><li>one of it</li></ul></div><div><a>About</a></div></div>", "main words of the page go on and on\none of it"),
    ],
)
def test_extraction_loses_no_part_of_an_article(inner, text):
    head = "<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>"
    sample = [head + "<div class='ad'>buy it</div><article><h1>Head</h1>" + "<p>many words of prose in a row here</p>" * 9 + "</article><footer>me</footer></body></html>"]
    weights = html_extract.weights_of(*html_extract.learn(sample * 50))
    assert html_extract.extract(f"{head}{inner}<footer>&copy; x</footer></body></html>", weights) == text


def test_optional_end_tags_and_quotes():
    assert html_extract.extract("<html><head><title>t</title><meta charset=x><body><p>no end of head</p>", {}) == "no end of head"
    assert html_extract.extract("<p title='a > b'>quoted</p><script data-x='>'>var a='<p>no</p>'</script><p>more</p><object>open <p>then</p>", {"w:": 1.0}) == "quoted\nmore\nopen\nthen"


def test_ids_with_several_texts_lose_none(spark):
    a, b, c = (" ".join(x * k for k in range(1, 9)) for x in "abc")
    rows = [(1, a), (1, b), (2, c), (3, b), (None, c), (2, c)]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in jaccard_join.keep_first(docs).collect()) == sorted([(1, a), (1, b), (2, c), (0, c)])
    bench = spark.createDataFrame([(1, b)], "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, bench).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == sorted([(1, a), (2, c), (2, c), (0, c)])
