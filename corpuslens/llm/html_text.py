"""Main text of web pages by the distribution of line blocks.

Markup is stripped to lines of text, one for each block of the page. Elements that say by their tag, role, class or id
that they are no article (menus, page headers, footers, sidebars, notices, adverts, forms, reader comments) leave blank
lines in their place; so do scripts, styles and comments. Then the lengths of ``WINDOW`` neighbouring lines are summed
along the page. Where the sums surge to a threshold, a run of text begins: at the first line of those that lie together
without a blank one. Where they dive to zero, it ends. The text of all runs is kept.

- On a page with ``<article>`` or ``<main>`` that holds text, lines outside of them count as blank, and any text inside
  surges: an article of three words is one too. Elsewhere a run must reach ``SURGE`` characters and ``SHARE`` of the
  page's highest sum, or the highest sum of a page that has less.
- A line of links only counts as blank, except in paragraphs of a marked article; between other lines of a run it stays.

NULL and empty pages give the empty text, as do pages without text. A page is worked on by itself: repeated rows give
equal texts, and memory follows the longest page, in a few strings of its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import slabs

WINDOW = 3
SURGE = 86
SHARE = 0.15
#: Blank lines that stand for a removed element, as many as a window holds.
GAP = WINDOW

MARK = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^'">])*+)>""" r"|</?[A-Za-z][^>]*>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; it ends at their own end tag only.
RAW = set("script style textarea title noscript noframes noembed iframe xmp template svg math".split())
NO_TEXT = set("nav footer aside form button select datalist dialog menu object canvas audio video map head".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
#: Around them a run of text may end when the sums are low there.
CONTAINER = set("div section table header article main body ul ol dl hr".split())
NO_TEXT_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
NO_TEXT_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar widget widgets nav navbar navigation "
    "menu breadcrumb breadcrumbs footer masthead topbar comments comment disqus respond replies related recommended recommendations "
    "share sharing social login search pagination pager toolbar copyright disclaimer".split()
)
#: A header of these is part of the article.
ARTICLE_NAMES = set("article post entry content story page".split())


def _is_aside(name: str, rest: str, in_article: bool) -> bool:
    """Whether an element says that it is no part of the article."""
    if name in NO_TEXT or name == "header" and not in_article:
        return True
    if name in ("html", "body", "article", "main") or not rest.strip(" /"):
        return False
    values = {k.lower(): unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(rest)}
    if re.search(r"\shidden(?=[\s/=]|$)", rest) or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", values.get("style", "")):
        return True
    if values.get("role", "").lower() in NO_TEXT_ROLES:
        return True
    names = {t.lower() for t in TOKEN.findall(f"{values.get('class', '')} {values.get('id', '')}")}
    return bool(names & NO_TEXT_NAMES) or "header" in names and not in_article and not names & ARTICLE_NAMES


class _Lines:
    """Lines of a page with the length that counts for each, whether a marked article holds it, and blank lines."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.plain: list[int] = []
        self.linked: list[int] = []
        self.marked: list[bool] = []
        self.parts: list[str] = []
        self.sizes = [0, 0]

    def text(self, text: str, link: bool) -> None:
        self.parts.append(unescape(text))
        self.sizes[link] += len(text) - sum(map(text.count, " \n\t"))

    def end(self, marked: bool, blanks: int = 0, item: bool = False) -> None:
        line = " ".join("".join(self.parts).split()) if self.parts else ""
        if line:
            self.texts.append(line)
            self.plain.append(self.sizes[0] + (self.sizes[1] if marked and not item else 0))
            self.linked.append(self.sizes[1])
            self.marked.append(marked)
        if blanks and self.texts:
            for _ in range(blanks):
                self.texts.append("")
                self.plain.append(0)
                self.linked.append(0)
                self.marked.append(False)
        self.parts, self.sizes = [], [0, 0]


def lines_of(html: str) -> _Lines:
    """Strips markup. Open elements are kept on a stack: an end tag closes up to its element, or nothing without one."""
    out, stack, at, hidden = _Lines(), [], 0, 0
    articles = links = items = 0
    while True:
        found = MARK.search(html, at)
        stop = found.start() if found else len(html)
        if stop > at and not hidden:
            out.text(html[at:stop], links > 0)
        if not found:
            out.end(articles > 0, item=items > 0)
            return out
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        if not found["end"]:
            if name in RAW:
                closing = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                if not found["rest"].endswith("/") or name not in ("svg", "math"):
                    at = closing.end() if closing else len(html)
                continue
            if not hidden and name not in INLINE:
                out.end(articles > 0, name in CONTAINER, items > 0)
            if name in VOID:
                continue
            if name in ("li", "p", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
                _, aside = stack.pop()
                hidden -= aside
                items -= name == "li"
            aside = _is_aside(name, found["rest"], articles > 0)
            if aside and not hidden:
                out.end(articles > 0, GAP, items > 0)
            stack.append((name, aside))
            hidden += aside
            articles += name in ("article", "main")
            links += name == "a"
            items += name == "li"
        elif any(open_name == name for open_name, _ in reversed(stack)):
            was_hidden, marked, listed = hidden, articles > 0, items > 0
            if not hidden and name not in INLINE:
                out.end(marked, name in CONTAINER, listed)
            while True:
                last, aside = stack.pop()
                hidden -= aside
                articles -= last in ("article", "main")
                links -= last == "a"
                items -= last == "li"
                if last == name:
                    break
            if name in ("article", "main") and not hidden and not was_hidden:
                out.end(marked, GAP)
        elif not hidden and name not in INLINE:
            out.end(articles > 0, 0, items > 0)


def main_text(html: str | None) -> str:
    """The text between surges and dives of the line blocks, blocks joined by one space."""
    lines = lines_of(html or "")
    if not lines.texts:
        return ""
    length, marked = np.array(lines.plain), np.array(lines.marked)
    has_text = np.array([bool(t) for t in lines.texts])
    declared = bool((length[marked] > 0).any())
    if declared:
        length = np.where(marked, length, 0)
    elif not length.any():
        length = np.array(lines.linked)
    sums = np.convolve(length, np.ones(WINDOW, int))[WINDOW - 1 :]  # of each line and those after it
    peak = int(sums.max())
    surge = 1 if declared else min(peak, max(SURGE, int(SHARE * peak)))
    keep = np.zeros(len(length), bool)
    if peak:
        # Dives: a window of zeros. Between two of them lies one run, which counts if its sums surge.
        run = np.cumsum(np.append(0, sums[:-1] == 0))
        tall = np.zeros(run[-1] + 1, bool)
        tall[run[(sums >= surge)]] = True
        first, last = np.full(len(tall), len(length)), np.full(len(tall), -1)
        filled = np.flatnonzero(length > 0)
        np.minimum.at(first, run[filled], filled)
        np.maximum.at(last, run[filled], filled)
        place = np.arange(len(length))
        keep = tall[run] & (place >= first[run]) & (place <= last[run]) & has_text
        if declared:
            keep &= marked
    return " ".join(t for t, k in zip(lines.texts, keep) if k)


def _extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([main_text(t) for slab in slabs(batch) for t in slab.to_pylist()], pa.string())


def extract_pages(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """The columns of ``pages`` but ``html``, the main text as ``out`` and ``n_chars``, its code points. Input columns
    of these two names are replaced."""
    kept = [c for c in pages.columns if c not in (html, out, "n_chars")]
    texts = pages.select(*kept, F.arrow_udf(_extract, "string")(F.col(html)).alias(out))
    return texts.withColumn("n_chars", F.char_length(out).cast("bigint"))
