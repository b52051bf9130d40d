"""Operator 2: main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of tags and words. Words score positive by the block
they stand in and whether they are linked, block tags negative, inline tags
nothing; the weights are log-odds counted on a bounded sample of pages whose
article or main element labels the content, and kinds that the sample does not
show are nearly neutral. One linear scan finds the contiguous region of the
highest sum, and its first and last block are taken whole. From it, menus,
forms and their controls, notices, adverts, comments and the like are left out.

Edge cases: a null or empty page, or one without words, gives an empty text;
cut-off markup counts as far as it goes, and end tags that HTML lets out are
supplied (an open script, style or title takes the rest of the page, as in
browsers); pages are extracted one by one, so repeated rows and null ids pass
through; very long pages are read in one pass; ties take the earliest region; a
table without labelled pages uses word weight 1 and tag weight -1; columns other
than page_id, url and html are not read.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bounded_sample, fit_on_shards, read_table

#: At most about so many pages are learned from.
SAMPLE_ROWS = 4_000
SHARDS = 8
#: Least weight of a word.
LEAST = 0.01

#: Elements of HTML by role.
BLOCKS = set(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr
    ul""".split()
)
RAW = "script|style|textarea|title|iframe"
HIDDEN = set("head noscript template svg canvas select button datalist".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = set("nav footer aside form menu dialog fieldset search".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MARKS = set(
    """ad ads adv advert adverts advertisement breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus
    footer gdpr masthead menu nav navbar navigation newsletter replies respond responses sidebar sponsor sponsored subscribe""".split()
)
#: Marks that are words of articles too: every name beside them must be a mark or tell of a place.
LOOSE_MARKS = set("banner discussion header modal notice notices popup promo promotion related share sharing signup social toolbar widget".split())
PLACES = set("left right top bottom main site page global sticky fixed floating box bar list item links container wrapper inner area block section".split())
#: Heads of an article are part of it; names such as has-sidebar or content-with-nav tell of a neighbour.
HEADERS = set("header masthead".split())
QUALIFIERS = set("has have with without no not".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

#: Every part of a tag can be read in one way only, so a tag that never ends costs no more than its length.
_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({RAW})\b{_INSIDE}(?:(?<=/)>|>.*?(?:</\1\b[^>]*+(?:>|\Z)|\Z))|<[!?][^>]*+(?:>|\Z)"""
    rf"""|<(/?)([a-zA-Z][\w:-]*+)({_INSIDE})(?:>|\Z)""",
    re.S | re.I,
)
_ATTR = re.compile(r"""(?<![\w:-])(class|id|role|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_QUOTED = re.compile(r""""[^"]*+"|'[^']*+'""")
_HIDDEN = re.compile(r"(?:^|[\s\"'])hidden(?=[\s=/]|$)", re.I)
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _is_boilerplate(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """(whether the element is boilerplate, whether only a part of a class or id says so)."""
    if tag in BOILERPLATE or tag in HIDDEN or tag == "header" and not in_article:
        return True, False
    if "hidden" in attrs.lower() and _HIDDEN.search(_QUOTED.sub('""', attrs)):
        return True, False
    partly = False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), _CAMEL.sub("-", a or b or c).lower()
        if name in ("role", "style", "aria-hidden"):
            if value in ROLES if name == "role" else _NOT_SHOWN.search(value) if name == "style" else value == "true":
                return True, False
        elif tag not in ("article", "main", "body", "html"):
            names = [re.split(r"[_-]+", one) for one in value.split()]
            loose = all(not (MARKS | LOOSE_MARKS | PLACES).isdisjoint(tokens) for tokens in names)
            marks = MARKS | LOOSE_MARKS if loose else MARKS
            for tokens in names:
                found = marks.intersection(tokens) if QUALIFIERS.isdisjoint(tokens) else set()
                found -= HEADERS if in_article else set()
                if len(tokens) == 1 and found:
                    return True, False
                partly = partly or bool(found)
    return partly, partly


def scan(page: str) -> list[tuple]:
    """The page's parts in order: ("tag", kind, content, block no, "", out) and ("text", kind, content, block no, text, out).

    ``content``: inside an article or main element; ``out``: inside boilerplate. Only tags of blocks are parts, with ``+a``
    when most words of the block after it (before an end tag) are linked; text goes by its block, with ``+a`` when linked. An element that only a part of its class or id marks is none when it holds an
    article or main element.
    """
    parts: list[tuple] = []
    stack: list[tuple] = []  # tag, inside, out, mark, innermost block, whether linked
    top = ("", False, False, None, "body", False)
    nested: list[int] = []  # places in the stack of open blocks
    opened: Counter = Counter()
    block, at = 0, 0
    words, links = Counter(), Counter()

    def text(upto: int, found: str | None = None) -> None:
        if upto > at or found:
            _, inside, out, mark, where, linked = stack[-1] if stack else top
            found = found or page[at:upto]
            n = len(found.split())
            words[block] += n
            links[block] += n * linked
            parts.append(("text", where + "+a" * linked, inside, block, found, (out, mark)))

    def end(k: int) -> None:
        """Close the open elements from the k-th on; each is closed once, so a page takes time in proportion to its length."""
        for t, *_ in stack[k:]:
            opened[t] -= 1
        del stack[k:]
        while nested and nested[-1] >= k:
            nested.pop()

    def innermost(tag: str) -> int:
        return next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag)

    for m in _TOKEN.finditer(page):
        text(m.start())
        at = m.end()
        if not m[3]:
            continue
        tag, closing = m[3].lower(), m[2]
        if tag == "br":
            text(at, " ")
        if closing:
            if tag in BLOCKS:
                _, inside, out, mark, *_ = stack[-1] if stack else top
                parts.append(("tag", "/" + tag, inside, block, "", (out, mark)))
                block += 1
            if opened[tag]:
                end(innermost(tag))
            continue
        if (tag == "body" or tag in BLOCKS) and opened["head"]:  # the end tags of head, paragraphs and items may be left out
            end(innermost("head"))
        if tag in BLOCKS and nested and stack[nested[-1]][0] in {"p"} | CLOSED_BY.get(tag, set()):
            end(nested[-1])
        _, inside, out, mark, where, linked = stack[-1] if stack else top
        inside = inside or tag in ("article", "main")
        if tag in ("article", "main"):  # disproves the marks around it; those around a disproved one are so already
            above = mark
            while above and above[0]:
                above[0], above = False, above[1]
        block += tag in BLOCKS
        if tag not in VOID and not m[4].endswith("/"):
            found, partly = _is_boilerplate(tag, m[4], inside)
            out, mark = out or found and not partly, [True, mark] if partly else mark
            if tag in BLOCKS:
                nested.append(len(stack))
            opened[tag] += 1
            stack.append((tag, inside, out, mark, tag if tag in BLOCKS else where, linked or tag == "a"))
        if tag in BLOCKS:
            parts.append(("tag", tag, inside, block, "", (out, mark)))
    text(len(page))
    # a tag goes by the next block with words, an end tag by the last one
    filled = sorted(n for n, k in words.items() if k)
    linked = [False, *(2 * links[n] > words[n] for n in filled), False]

    def kind(p: tuple) -> str:
        if p[0] == "text":
            return p[1]
        return p[1] + "+a" * linked[bisect_right(filled, p[3]) if p[1][0] == "/" else bisect_left(filled, p[3]) + 1]

    return [(p[0], kind(p), *p[2:5], bool(p[5][0] or p[5][1] and p[5][1][0])) for p in parts]


def learn(pages: list[str]) -> tuple[Counter, Counter]:
    """Counts of tags and words by type, inside and outside the labelled content."""
    inside, outside = Counter(), Counter()
    for page in pages:
        for part in scan(page):
            to = inside if part[2] and not part[5] else outside
            if part[0] == "tag":
                to[part[1]] += 1
            else:
                to["w:" + part[1]] += len(part[4].split())
    return inside, outside


def weights_of(inside: dict[str, int], outside: dict[str, int]) -> dict[str, float]:
    """Log-odds by kind, and of all words as ``w:``; words at least slightly positive, tags at least slightly negative."""
    total = [sum(n for k, n in side.items() if k.startswith("w:")) for side in (inside, outside)]
    out = {"w:": min(max(math.log((total[0] + 1) / (total[1] + 1)), LEAST), 3.0)} if any(total) else {}
    for kind in {*inside, *outside}:
        odds = math.log((inside.get(kind, 0) + 1) / (outside.get(kind, 0) + 1))
        out[kind] = min(max(odds, LEAST), 3.0) if kind.startswith("w:") else max(min(odds, -0.1), -12.0)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous range [a, b) of the highest sum; (0, 0) if none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text. What is out weighs nothing; where an article or main element names the content, words elsewhere hardly do."""
    parts = scan(page or "")
    tag, named = -0.1 if weights else -1.0, any(p[2] for p in parts)

    def score(p: tuple) -> float:
        if p[5]:
            return 0.0
        if p[0] == "tag":
            return weights.get(p[1], weights.get(p[1].removesuffix("+a"), tag))
        if named and not p[2]:
            return LEAST * len(p[4].split())
        kind = "w:" + p[1]  # a linked word of an unseen kind weighs what its block's words do
        return weights.get(kind, weights.get(kind.removesuffix("+a"), weights.get("w:", 1.0))) * len(p[4].split())

    a, b = best_region([score(p) for p in parts])
    kept = {p[3] for p in parts[a:b] if p[0] == "text" and not p[5]}
    blocks: dict[int, list[str]] = {}
    for p in parts:  # the first and last block of the region are whole
        if p[0] == "text" and not p[5] and p[3] in kept:
            blocks.setdefault(p[3], []).append(p[4])
    lines = (" ".join(htmllib.unescape("".join(x)).split()) for x in blocks.values())
    return "\n".join(x for x in lines if x)


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    inside, outside = learn(pdf["html"].tolist())
    kinds = [*{*inside, *outside}]
    return pd.DataFrame({"kind": kinds, "i": [inside[k] for k in kinds], "o": [outside[k] for k in kinds]})


def fit(pages: DataFrame, max_rows: int = SAMPLE_ROWS) -> dict[str, float]:
    """Weights by type from pages with an article or main element."""
    labelled = pages.select("html", F.xxhash64("html").alias("key")).where(F.col("html").rlike("(?i)<(article|main)\\b"))
    rows = bounded_sample(labelled, "key", max_rows).dropDuplicates(["html"])
    sums = fit_on_shards(rows, _count, SHARDS, "kind string, i long, o long", key="key").groupBy("kind").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    got = sums.collect()  # tag names of a bounded sample
    return weights_of({r["kind"]: r["i"] for r in got}, {r["kind"]: r["o"] for r in got})


def extract_pages(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    def run(batch):
        found = [extract(p, weights) for p in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": found, "n_chars": pa.array(map(len, found), pa.int64())}

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return arrow_map(rows, run, "page_id long, url string, text string, n_chars long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extract_pages(pages, fit(pages))
