"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element; lines of menus, notices and the
like stay in the list with length 0. Text lengths (links counted out) are summed over
a sliding window of lines; where the sum surges from zero over a threshold a region
begins, where it falls back to zero the region ends. All text between surge and dive
is kept, however short its lines.

What an element is called says little where the text says otherwise: a form, or an element named
after a sidebar or the like, that holds most of the page's prose (long lines that are not
links) is a wrapper and stays, unless the page marks an article elsewhere. An element that marks the article decides only where it
holds most of the prose left.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE_CHARS = 80

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option"
    " p pre section summary table tbody tfoot thead tr ul".split()
)
SPACE_TAGS = frozenset("br td th wbr img".split())
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Elements without article text, wherever they stand.
DROPPED_TAGS = frozenset(
    "nav footer aside head button select textarea datalist menu dialog object audio video canvas map".split()
)
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
# Parts of names of elements without article text, and names that say so only if nothing is added.
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies"
    " consent gdpr notice notices popup modal newsletter subscribe subscription signup paywall"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar widget widgets"
    " header masthead topbar footer share sharing comment comments disqus login".split()
)
DROPPED_WHOLE_NAMES = frozenset(
    "alert overlay side aside foot bottom copyright legal social related recommended recommendations"
    " respond reply replies search skip toolbar tags".split()
)
# Their IDs are anchors.
_ANCHORED = frozenset("p h1 h2 h3 h4 h5 h6".split())
# A line of prose has this many characters outside links, and half of it or more is outside links.
PROSE_CHARS = 40
_PARAGRAPH_ENDERS = BLOCK_TAGS - {"li"}

# Raw elements and comments first: what they hold is no markup. Quoted values may hold ">".
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|math|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|</?[a-zA-Z][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PART = re.compile(r"[a-z]+")


def _drop(tag: str, rest: str, in_article: bool) -> str:
    """Whether an element is dropped: '' (no), 'never back', or 'unless prose'."""
    if tag in DROPPED_TAGS or tag == "header" and not in_article:
        return "never back"
    if "=" not in rest:
        hidden = bool(rest) and bool(_HIDDEN.search(rest))
        return "never back" if hidden else "unless prose" if tag == "form" else ""
    if tag in ("html", "body", "main"):
        return ""
    named = tag == "form"
    for kind, *values in _NAMES.findall(rest):
        kind, value = kind.lower(), "".join(values).lower()
        if kind == "role":
            if value in DROPPED_ROLES:
                named = True
        elif kind == "class" or tag not in _ANCHORED:
            named = named or any(_says_dropped(name, in_article) for name in value.split())
    if _HIDDEN.search(rest):
        return "never back"
    return "unless prose" if named else ""


def _says_dropped(name: str, in_article: bool) -> bool:
    """Inside the article "post-header" and the like may be text."""
    if name in DROPPED_WHOLE_NAMES:
        return True
    parts = [name] if in_article and name.endswith("header") else _PART.findall(name)
    return not DROPPED_NAMES.isdisjoint(parts)


class _Lines:
    """Collects (text, characters outside links, inside an article, droppable elements around it) per line."""

    def __init__(self):
        self.lines: list[tuple[str, int, bool, tuple[int, ...]]] = []
        self.text: list[str] = []
        self.linked = 0

    def add(self, text: str, linked: bool) -> None:
        self.text.append(text)
        if linked:
            self.linked += len(text.strip())

    def end(self, in_article: bool, around: list[tuple[int, int]]) -> None:
        if self.text:
            text = " ".join(html.unescape("".join(self.text)).split())
            if text:
                own = max(0, len(text) - self.linked)
                self.lines.append((text, own, in_article, tuple(number for _, number in around)))
            self.text, self.linked = [], 0

    def gap(self, around: list[tuple[int, int]]) -> None:
        """A dropped element: a line without length."""
        self.lines.append(("", 0, False, tuple(number for _, number in around)))


def _prose(line: tuple) -> int:
    text, own = line[0], line[1]
    return own if own >= PROSE_CHARS and 2 * own >= len(text) else 0


def _settled(lines: list[tuple], wrappers: set[int], inner: set[int]) -> list[tuple[str, int, bool]]:
    """Lines without those of dropped elements; of each such element a line without length stays.

    `wrappers` are around the article, `inner` ones inside one. Where there is an article with text of its own, what is
    named after an advert beside it stays out, however short the article.
    """
    prose: dict[int, int] = {}
    for line in lines:
        for number in line[3]:
            prose[number] = prose.get(number, 0) + _prose(line)
    total = sum(map(_prose, lines))
    article = any(own for _, own, in_article, around in lines if in_article and inner.isdisjoint(around))
    kept = {number for number, own in prose.items() if 2 * own > total and (number in inner or not article)}
    kept |= wrappers
    out, last = [], None
    for text, own, in_article, around in lines:
        dropped = next((number for number in around if number not in kept), None)
        if dropped is None:
            out.append((text, own, in_article))
        elif dropped != last:
            out.append(("", 0, False))
        last = dropped
    return out


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """Lines of a page in order: text ('' for a dropped element), own characters, whether in the article."""
    out = _Lines()
    stack: list[str] = []
    dropped_at = 0  # depth of the outermost element dropped for good, 0 if none
    around: list[tuple[int, int]] = []  # (depth, number) of open elements that are dropped unless they hold prose
    wrappers: set[int] = set()
    inner: set[int] = set()
    number = 0
    seen = False
    articles = links = 0
    at = 0

    def leave(popped: str) -> None:
        """Close what ended with this element, which is off the stack."""
        nonlocal dropped_at
        if dropped_at > len(stack):
            dropped_at = 0
            out.gap(around)
        ends = around and around[-1][0] > len(stack)
        if not dropped_at and (popped in BLOCK_TAGS or ends):
            out.end(articles > 0, around)
        while around and around[-1][0] > len(stack):
            around.pop()

    for token in _TOKEN.finditer(page):
        if token.start() > at and not dropped_at:
            out.add(page[at : token.start()], links > 0)
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if token["close"]:
            if tag not in stack:
                continue
            popped = ""
            while popped != tag:
                popped = stack.pop()
                leave(popped)
                articles -= popped in ("article", "main")
                links -= popped == "a"
            continue
        if tag in SPACE_TAGS and not dropped_at:
            out.add(" ", False)
        if tag in BLOCK_TAGS and not dropped_at:
            out.end(articles > 0, around)
        if tag in VOID_TAGS or token["rest"].endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag in _PARAGRAPH_ENDERS and "p" in stack[-3:]:
            # An open paragraph, and what is open in it, ends where a block begins.
            while stack and "p" in stack[-3:] and len(stack) > dropped_at:
                popped = stack.pop()
                leave(popped)
                links -= popped == "a"
                if popped == "p":
                    break
        drop = "" if dropped_at else _drop(tag, token["rest"], articles > 0)
        if drop:
            out.end(articles > 0, around)
        if drop == "never back":
            dropped_at = len(stack) + 1
        elif drop:
            around.append((len(stack) + 1, number))
            inner.update([number] if articles else [])
            number += 1
        if tag in ("article", "main") and not dropped_at and not drop:
            if not seen:
                # What is around the first article is a wrapper ("with-sidebar").
                wrappers.update(n for _, n in around)
            seen = True
        stack.append(tag)
        articles += tag in ("article", "main")
        links += tag == "a"
    if at < len(page) and not dropped_at:
        out.add(page[at:], links > 0)
    out.end(articles > 0, around)
    return _settled(out.lines, wrappers, inner)


def regions(lengths: list[int], window: int = WINDOW, surge: int = SURGE_CHARS) -> list[tuple[int, int]]:
    """[begin, end) of line runs whose window sums surge over the threshold and dive to zero again.

    sums[i] covers window lines from i. A run goes from the first line with text after a
    window of nothing to the last before the next one. If no run surges, the one with
    most text counts.
    """
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    runs, begin, last, gap = [], None, 0, 0
    for i, n in enumerate([*lengths, *[0] * window]):
        if n:
            begin, last, gap = (i if begin is None else begin), i, 0
        else:
            gap += 1
            if begin is not None and gap >= window:
                runs.append((begin, last + 1))
                begin = None
    chosen = [r for r in runs if max(sums[max(0, r[0] - window + 1) : r[1]]) >= surge]
    return chosen or sorted(runs, key=lambda r: sum(lengths[r[0] : r[1]]))[-1:]


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE_CHARS) -> str:
    """The article of a page: blocks joined by an empty line, '' if there is none.

    Null and blank pages give ''. Where a page marks its article (or main part) by an
    element that holds half of its prose or more, lines outside it have length 0 and any text inside is a surge;
    else (a teaser) the mark changes nothing. Line breaks, cells and white space inside a block become one blank.
    """
    lines = lines_of(page) if page else []
    inside_prose = sum(_prose(line) for line in lines if line[2])
    if any(inside for _, _, inside in lines) and 2 * inside_prose >= sum(map(_prose, lines)):
        # Outside the marked part nothing has length, inside any text is a surge.
        lengths, surge = [len(text) * inside for text, _, inside in lines], 1
    else:
        lengths = [own for _, own, _ in lines]
    found = regions(lengths, window, surge)
    return "\n\n".join(t for begin, end in found for t, _, _ in lines[begin:end] if t)


def extract(pages: DataFrame, html_col: str = "html", window: int = WINDOW, surge: int = SURGE_CHARS) -> DataFrame:
    """pages without the html column, with text and n_chars (code points) in its place.

    Columns of these names in pages are replaced. One row per page, repeated pages
    included; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda page: main_text(page, window, surge))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    text_of = F.pandas_udf(run, "string")
    text = text_of(F.coalesce(F.col(html_col).cast("string"), F.lit("")))
    # The extraction must run once, though two columns use it.
    out = pages.withColumn("text", text).drop(html_col)
    return out.withColumn("n_chars", F.length("text").cast("long"))
