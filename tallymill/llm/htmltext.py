"""Main text of web pages by the distribution of text over line blocks."""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from tallymill.llm.common import column

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Lines in a window, and the weight of a window at which a surge begins at the latest: a
# page's own fullest window may ask for less. A sign weighs 1, and SURGE in a marked
# main part.
WINDOW, SURGE = 3, 80
# Share of a line's text that may be links outside a marked main part.
MAX_LINKED = 0.5

# Elements by what they mean in HTML.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "noembed", "noframes", "xmp", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSAID = frozenset(
    "head nav footer aside form button select svg math canvas object audio video dialog menu "
    "fieldset datalist map".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "meter output progress q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u "
    "var wbr".split()
)
MAIN_TAGS = frozenset(("article", "main"))
# Left out by what they hold, not by what they are: kept if they hold most of a page.
SPARED_TAGS = frozenset(("form", "fieldset"))
ENCLOSED = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",)}
# Words in class, id or role that tell what an element is for.
UNSAID_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted "
    "cookie cookies consent gdpr notice notification alert popup modal overlay paywall subscribe "
    "newsletter signup login comment comments commentlist disqus respond replies sidebar widget nav "
    "navbar navigation menu breadcrumb breadcrumbs footer masthead related recommended share sharing "
    "social toolbar pagination pager copyright complementary contentinfo search dialog".split()
)
MAIN_WORDS = frozenset("article content main post entry story".split())



def _token(attributes: str) -> re.Pattern:
    return re.compile(
        r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>" + attributes + ")>"
        r"|<[!?/][^>]*+>?|(?P<text>[^<]++|<(?![a-zA-Z]))",
        re.S,
    )


# A tag may hold signs in quotes; once a quote does not end, quotes mean nothing.
_QUOTED = _token(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_BARE = _token(r"[^>]*+")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_WORD = re.compile(r"[a-z0-9]+")
NO, HINTED, YES = range(3)
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


def _says(tokens: list[str], words: frozenset[str]) -> bool:
    """Whether a token is one of the words, or made of nothing else (cookie-notice)."""
    return any((parts := _WORD.findall(t)) and words.issuperset(parts) for t in tokens)


def _purpose(tag: str, rest: str) -> tuple[int, bool]:
    """Whether an element is no part of the text (or only hinted to be none), and
    whether it is the main part."""
    unsaid = HINTED if tag in SPARED_TAGS else YES if tag in UNSAID else NO
    main = tag in MAIN_TAGS
    if rest and "=" in rest or "hidden" in rest:
        tokens: list[str] = []
        for name, *values in _ATTRIBUTE.findall(rest):
            name, value = name.lower(), "".join(values).lower()
            if name in ("class", "id", "role"):
                tokens += value.split()
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                unsaid = YES
            elif name == "style" and "display:none" in value.replace(" ", ""):
                unsaid = YES
        if tokens and tag not in ("html", "body", "article", "main"):
            if not unsaid and _says(tokens, UNSAID_WORDS):
                unsaid = HINTED
            main = main or tag not in INLINE and _says(tokens, MAIN_WORDS)
    return unsaid, main


class _Page:
    """Lines of a page: (text, length of the linked part, whether in the main part).

    Each block of text is a line; an element that is left out gives empty lines,
    enough to end any run of lines. ``bulky`` numbers the elements that were left
    out by a hint though they hold most of the page's text outside links, and no
    <article> or <main> stands outside them; those in ``spared`` are not left out.
    """

    def __init__(self, spared: frozenset[int] = frozenset()) -> None:
        self.spared, self.elements, self.signs, self.mains = spared, 0, 0, 0
        self.hinted: list[tuple[int, int, int]] = []  # open ones: (number, signs and mains before)
        self.held: list[tuple[int, int, int]] = []  # closed ones: (number, signs, mains)
        self.lines: list[tuple[str, int, bool]] = []
        self.open: list[tuple[str, bool, bool]] = []
        self.unsaid = self.main = self.links = 0
        self.parts: list[tuple[str, bool]] = []

    def end_line(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", html.unescape("".join(t for t, _ in self.parts))).strip()
            linked = sum(len(t.strip()) for t, link in self.parts if link)
            self.parts = []
            if text:
                self.lines.append((text, linked, self.main > 0))

    def gap(self) -> None:
        self.lines += [("", 0, False)] * WINDOW

    def start(self, tag: str, rest: str) -> None:
        if tag not in INLINE:
            self.end_line()
            if any(t == "p" for t, _, _ in self.open[-8:]) and tag not in VOID:
                self.close_p()
            self.close_sibling(tag)
        if tag in VOID or rest.endswith("/") and tag in ("svg", "path"):
            if tag == "br":
                self.parts.append((" ", False))
            return
        purpose, main = _purpose(tag, rest)
        self.elements += 1
        unsaid = purpose != NO and self.elements not in self.spared
        self.hinted.append((self.elements if purpose == HINTED and unsaid else 0, self.signs, self.mains))
        self.mains += tag in MAIN_TAGS
        if tag == "header" and not self.main:
            unsaid = True
        if unsaid and not self.unsaid:
            self.end_line()
        self.open.append((tag, unsaid, main))
        self.unsaid += unsaid
        self.main += main
        self.links += tag == "a"

    def close_p(self) -> None:
        """A block ends an open paragraph, unless another block stands between."""
        for tag, _, _ in reversed(self.open):
            if tag == "p":
                self.end("p")
                return
            if tag not in INLINE:
                return

    def close_sibling(self, tag: str) -> None:
        if tag in ENCLOSED:
            for other, _, _ in reversed(self.open):
                if other == tag:
                    self.end(tag)
                    return
                if other in ENCLOSED[tag]:
                    return

    def end(self, tag: str) -> None:
        if not any(t == tag for t, _, _ in self.open):
            return
        if tag not in INLINE:
            self.end_line()
        while self.open:
            name, unsaid, main = self.open.pop()
            self.close_hinted()
            if unsaid and self.unsaid == 1:
                self.parts = []
                self.gap()
            elif name not in INLINE:
                self.end_line()
            self.unsaid -= unsaid
            self.main -= main
            self.links -= name == "a"
            if name == tag:
                return

    def close_hinted(self) -> None:
        number, signs, mains = self.hinted.pop()
        if number:
            self.held.append((number, self.signs - signs, self.mains - mains))

    def bulky(self) -> frozenset[int]:
        return frozenset(n for n, signs, mains in self.held if 2 * signs > self.signs and mains == self.mains)

    def read(self, page: str) -> list[tuple[str, int, bool]]:
        at, token = 0, _QUOTED
        while at < len(page):
            m = token.match(page, at)
            if m is None and token is _BARE:  # a tag that never ends
                break
            if m is None:
                token = _BARE
                continue
            at = m.end()
            if m["text"] is not None:
                if not self.links:
                    self.signs += len(m["text"].strip())
                if not self.unsaid:
                    self.parts.append((m["text"], self.links > 0))
            elif m["tag"]:
                tag = m["tag"].lower()
                if m["close"]:
                    self.end(tag)
                elif tag in RAW:
                    done = _RAW_END[tag].search(page, at)
                    at = done.end() if done else len(page)
                else:
                    self.start(tag, m["rest"])
        self.end_line()
        while self.hinted:
            self.close_hinted()
        return self.lines


def main_text(page: str | None) -> str:
    """Windows of lines are summed by their weight; a run begins where the sum
    surges and goes on until it dives.

    A line weighs as much as its text; in the main part, where a page marks one
    and it holds half of the text or more, SURGE times as much. Other lines that
    are mostly links weigh nothing, and stay only between lines of a run that
    weigh something. A dive is an empty window; on pages with a main part, one
    below the surge, and there an element that is left out outside the main part ends
    a run. A page without a main part has no such ends: what stands before and after an
    advert belongs together. The surge is at most half of the page's fullest window, so
    a short page is its own main text.
    """
    read = _Page()
    lines = read.read(page or "")
    if bulky := read.bulky():
        lines = _Page(bulky).read(page or "")
    total, in_main = (sum(len(text) for text, _, main in lines if main or every) for every in (True, False))
    marked = 2 * in_main >= total > 0
    if not marked:
        lines = [line for line in lines if line[0]]
    weight = np.array([
        len(text) * SURGE if marked and main else len(text) if linked <= MAX_LINKED * len(text) else 0
        for text, linked, main in lines
    ] + [0] * WINDOW)
    sums = np.convolve(weight, np.ones(WINDOW, np.int64))[WINDOW - 1 :]  # of the lines from here on
    surge = min(SURGE, sums.max() / 2)
    dive, kept, linked_lines, on = surge if marked else 1, [], [], False
    for i, (text, _, _) in enumerate(lines):
        if not on and sums[i] >= surge and weight[i]:
            on = True
        elif on and sums[i] < dive:
            on = False
        if on and weight[i]:
            kept += linked_lines + [text]
            linked_lines = []
        elif on and text:
            linked_lines.append(text)
        elif not on or not text:
            linked_lines = []
    return "\n".join(kept)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch["h"]]
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page.

    Markup is stripped to lines, one per block; comments, scripts, styles and
    elements that are menus, headers, footers, sidebars, notices, adverts, forms
    or reader comments, by tag or by a whole word of class, id or role, leave empty
    lines; a form, or an element told only by such a word, does not if it holds
    most of the page and no <article> or <main> stands outside it. The lines between a surge and a dive of the text in a sliding window are the main
    text: white space within a line is one space, and lines are joined by line
    feeds. Nothing else is dropped or cut.

    A null or empty page, or one without main text, gives ''. Markup that never
    ends is read to the end of the page. Repeated rows get equal results; nulls
    in other columns stay; further columns play no part; no row in, no row out.
    """
    rows = pages.select(
        column(page_id).cast("bigint").alias("page_id"), column(url).cast("string").alias("url"),
        column(page).alias("h"),
    )
    return rows.mapInArrow(_extracted, "page_id bigint, url string, text string, n_chars bigint")
