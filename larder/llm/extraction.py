"""Main text of HTML pages by a maximum-scoring subsequence of words and tags.

A page is a row of tokens: runs of words score positive, tags negative.  The contiguous stretch with the
highest sum, found in one linear scan, is the content region.  What a tag costs follows from labelled
pages: pages whose markup itself names the content (one ``article`` or ``main`` element).  A tag that stands inside content
there costs next to nothing, one that stands outside or at the edge costs more than the
stray words beyond it could win.

Elements that are no content wherever they stand (navigation, forms, scripts, elements whose class, id or role says advert,
notice, sidebar, comment and so on) give no tokens, so that they neither win nor interrupt.  A class, id or role says so as a
whole name ("ad-box", not "overflow-hidden"), and never of the only article of a page or what holds it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import lean

#: Bounds of the model: labelled pages (least by a hash of their id) and tags.
MAX_PAGES, MAX_TAGS = 5_000, 500

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_NEVER = frozenset(
    "nav header footer aside form script style noscript template iframe svg math canvas object audio video button select option textarea "
    "dialog menu head title search noembed noframes xmp".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}}
_HOLDS = frozenset("article aside body div footer form header html main nav section table td th ul ol dl blockquote".split())
#: Words in class, id or role that mark what is no content.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored sponsors promo promotion promoted nav navbar "
    "navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo widget widgets cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay dialog newsletter subscribe subscription signup login comment comments "
    "commentlist disqus reply replies respond discussion social share sharing related recommended recommendations pagination pager toolbar "
    "search skip hidden tracking paywall".split())
#: Words that say nothing of the content: beside a mark they leave it a mark, any other word makes the name another ("has-sidebar").
_PLAIN = frozenset(
    "area bar block body bottom box btn button buttons col column container content div foot form global group head holder icon icons inner item "
    "items left link links list main outer page panel post row section site text title top right unit wrap wrapper".split())
_LETTER = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _marked(value: str) -> bool:
    """A name in a class, id or role says that this is no content: it has a mark, and no words but marks and plain ones."""
    for name in value.split():
        parts = {w.lower() for w in _NAME.findall(name)}
        if not parts.isdisjoint(_MARKS) and parts <= _MARKS | _PLAIN:
            return True
    return False


def _no_content(name: str, attributes: str, spared: bool = False) -> bool:
    """``spared``: marks do not count, as the element is or holds the one that names the content."""
    if name in _NEVER:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key in ("class", "id", "role") and not spared and _marked(value):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """(tag, text, content): tag is "" for text, else "name" or "/name"; content is false inside what is no content.

    Comments, declarations and an unfinished tag at the end give nothing; raw text ends at its own end tag.  Where a page has one
    ``article`` (or none, and one ``main``), no mark takes out that element or one that holds it.
    """
    held: dict[str, list[frozenset[int]]] = {"article": [], "main": []}
    row = list(_scan(page, frozenset(), held))
    one = next((x for x in held.values() if x), [])
    yield from _scan(page, one[0], {}) if len(one) == 1 and one[0] else row


def _scan(page: str, spared: frozenset[int], held: dict[str, list[frozenset[int]]]) -> Iterator[tuple[str, str, bool]]:
    """Tokens of ``tokens``; ``spared`` are places of start tags whose marks do not count.

    For each element named in ``held``, the places of those open there that are no content are added, its own included.
    """
    stack: list[tuple[str, bool, int]] = []
    outside, at, end = 0, 0, len(page)  # outside: open elements that are no content

    def pop(count: int) -> None:
        nonlocal outside
        for _ in range(count):
            outside -= stack.pop()[1]
    while at < end:
        cut = page.find("<", at)
        while 0 <= cut and not (page[cut + 1:cut + 2] in _LETTER or page[cut + 1:cut + 2] in ("/", "!", "?")):
            cut = page.find("<", cut + 1)
        cut = end if cut < 0 else cut
        if cut > at:
            yield "", page[at:cut], not outside
        if cut == end:
            return
        if page.startswith("<!--", cut):
            at = page.find("-->", cut + 2)
            at = end if at < 0 else at + 3
            continue
        m = _TAG.match(page, cut)
        if not m:
            if page[cut + 1] in _LETTER or page[cut + 1] == "/" and page[cut + 2:cut + 3] in _LETTER:
                return
            at = page.find(">", cut)
            at = end if at < 0 else at + 1
            continue
        start, at, name = cut, m.end(), m[2].lower()
        if m[1]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if place >= 0:
                pop(len(stack) - place)
            yield "/" + name, "", not outside
            continue
        if name in _BLOCK and name != "html":
            closed = {"p"} | _CLOSES.get(name, set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closed:
                    pop(len(stack) - i)
                    break
                if stack[i][0] in _HOLDS:
                    break
        if name == "body":
            pop(next((len(stack) - i for i, x in enumerate(stack) if x[0] == "head"), 0))
        bad = _no_content(name, m[3], start in spared)
        if name in held:
            held[name].append(frozenset([x[2] for x in stack if x[1]] + ([start] if bad else [])))
        if name in _VOID:
            yield name, "", not outside
            continue
        yield name, "", not (outside or bad)
        if name in _RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = stop.start() if stop else end
        if not (m[3].endswith("/") and name in ("svg", "math")):
            stack.append((name, bad, start))
            outside += bad


@dataclass
class Model:
    """What tags cost and a word wins."""

    tags: dict[str, float] = field(default_factory=dict)
    word: float = 1.0
    unknown: float = -0.25

    def region(self, page: str) -> str:
        """The best contiguous region as text: white space made one space, blocks joined by two line feeds."""
        row = list(tokens(page))
        best, best_a, best_b, sum_, a = 0.0, 0, -1, 0.0, 0
        for i, (tag, text, content) in enumerate(row):
            if not content:
                continue
            sum_ += self.tags.get(tag, self.unknown) if tag else self.word * len(text.split())
            if sum_ <= 0:
                sum_, a = 0.0, i + 1
            elif sum_ > best:
                best, best_a, best_b = sum_, a, i
        blocks, part = [], []
        for tag, text, content in row[best_a:best_b + 1]:
            if tag.removeprefix("/") in _BLOCK:
                blocks.append("".join(part))
                part = []
            elif content:
                part.append(" " if tag == "br" else html.unescape(text))
        blocks.append("".join(part))
        return "\n\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def _counts(page: str) -> dict[str, list[int]] | None:
    """For a labelled page {tag: [inside, outside]} and the words under ""; None without a label."""
    row = list(tokens(page))
    for name in ("article", "main"):
        starts = [i for i, t in enumerate(row) if t[0] == name and t[2]]
        ends = [i for i, t in enumerate(row) if t[0] == "/" + name and t[2]]
        if len(starts) == 1 and len(ends) == 1 and starts < ends:
            counts: dict[str, list[int]] = {"": [0, 0]}
            for i, (tag, text, content) in enumerate(row):
                if content:
                    inside = starts[0] < i < ends[0]
                    counts.setdefault(tag, [0, 0])[not inside] += 1 if tag else len(text.split())
            return counts
    return None


def train(pages: DataFrame, text: str = "html", page_id: str = "page_id", max_pages: int = MAX_PAGES) -> Model:
    """Costs from the labelled ones among at most ``max_pages`` pages, those least by a hash of their id.

    A tag that no labelled page has costs a quarter of what a word wins.
    """
    sample = pages.filter(F.col(text).isNotNull()).select(F.xxhash64(page_id).alias("h"), F.col(text).alias("t"))
    bound = sample.groupBy("h").count().orderBy("h").limit(max_pages).agg(F.max("h")).first()[0]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(tag, *n) for page in pdf["t"] for tag, n in (_counts(page) or {}).items()]
            yield pd.DataFrame(rows, columns=["tag", "inside", "outside"])
    found = sample.filter(F.col("h") <= (bound if bound is not None else 0)).mapInPandas(count, "tag string, inside long, outside long")
    rows = found.groupBy("tag").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"), F.max("outside").alias("most")).orderBy(
        F.desc(F.col("inside") + F.col("outside")), "tag").limit(MAX_TAGS).collect()
    stray = next((r.most for r in rows if not r.tag), 0)
    cost = 20 + 2 * stray
    return Model({r.tag: -(0.05 + cost * r.outside / (r.inside + r.outside)) for r in rows if r.tag and r.inside + r.outside})


def extracted(pages: DataFrame, model: Model, text: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns of every page with ``text``, its main text ("" if there is none), and ``n_chars``.

    A null page counts as empty.  Pages of any length are read whole; equal pages give equal texts.
    """
    lean(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # at most MAX_TAGS entries

    @F.pandas_udf("string")
    def column(values: pd.Series) -> pd.Series:
        return pd.Series([shared.value.region(v) if v else "" for v in values], dtype=object)
    rows = pages.select(*keep, column(F.col(text)).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
