"""Registry detail pages with real DOM structure (H2, H3) via ``mapInPandas``.

Labels and values on a detail page are paired by document order (a label's
value is the next ``div.form-line`` after it, wherever it is), and sections
are whole elements found by id.  Nested ``div``s make that irregular for
regular expressions, so each page is walked once with the standard-library
HTML parser inside an Arrow batch; Spark still partitions the pages and
shuffles nothing.  The per-page walker is a small helper: a few event
handlers and a stack.  Pages of plain markup are cut into the same events by one
regular expression, which takes a tenth of the parser's time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from rxframe.session import ship_package

# The detail page's structure and the empty-leaflet placeholder.
DATA_SECTION_ID = "D-div"
LABEL_CLASS = "form-label"
VALUE_CLASS = "form-line"
SECTION_IDS = {"A-div": "leaflet", "M-div": "practitioner"}
PLACEHOLDER = "لم يتم إدخال بيانات"

# text inside these is not page text
UNSEEN = {"script", "style", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Events:
    """A page's events in document order, kept with the stack of open elements:
    ("start", tag, id, classes, depth, href) / ("text", s) / ("end", depth)."""

    def __init__(self):
        self.stack: list[str] = []
        self.events: list[tuple] = []
        self.unseen = 0                                      # open elements whose text is not page text

    def start(self, tag: str, id_: str, classes: frozenset[str], href: str | None) -> None:
        depth = len(self.stack) + 1
        self.events.append(("start", tag, id_, classes, depth, href))
        if tag in VOID:
            self.events.append(("end", depth))
            return
        self.stack.append(tag)
        self.unseen += tag in UNSEEN

    def end(self, tag: str) -> None:
        if tag not in self.stack:
            return
        open_tag = None
        while open_tag != tag:
            self.events.append(("end", len(self.stack)))
            open_tag = self.stack.pop()
            self.unseen -= open_tag in UNSEEN

    def text(self, data: str) -> None:
        if not self.unseen:
            self.events.append(("text", data))


def _element(tag: str, attrs: dict) -> tuple:
    return tag, attrs.get("id") or "", frozenset((attrs.get("class") or "").split()), attrs.get("href")


class _Walker(HTMLParser):
    """Events of any markup."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out = _Events()

    def handle_starttag(self, tag, attrs):
        self.out.start(*_element(tag, dict(attrs)))

    def handle_endtag(self, tag):
        self.out.end(tag)

    def handle_data(self, data):
        self.out.text(data)


# Plain markup: text without "<", and tags with quoted attribute values without "<", ">" or "&".
TAG = re.compile("(<[^<>]*>)")
PLAIN_TAG = re.compile(r'<(/?)([A-Za-z][A-Za-z0-9]*)((?:[ \t\n]+[A-Za-z][A-Za-z0-9_-]*="[^"&]*")*)[ \t\n]*>')
PLAIN_ATTR = re.compile(r'([A-Za-z][A-Za-z0-9_-]*)="([^"]*)"')
# elements whose content the parser may not read as markup
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript"}


@lru_cache(maxsize=1 << 14)
def _plain_tag(tag: str) -> tuple | None:
    """(is an end tag, element) of a plain tag, else None."""
    m = PLAIN_TAG.fullmatch(tag)
    if not m or m[2].lower() == "plaintext" or (m[1] and m[3]):
        return None
    return bool(m[1]), _element(m[2].lower(), {k.lower(): v for k, v in PLAIN_ATTR.findall(m[3])})


def _plain_events(html: str) -> list[tuple] | None:
    """The walker's events of a page of plain markup only, cut by one expression; else None."""
    pieces = TAG.split(html)                                 # text, tag, text, ..., tag, text
    out, raw = _Events(), None
    for i, piece in enumerate(pieces):
        if i % 2:
            tag = _plain_tag(piece)
            if tag is None or (raw and tag != (True, (raw, "", frozenset(), None))):
                return None
            is_end, element = tag
            if is_end:
                out.end(element[0])
                raw = None
            else:
                out.start(*element)
                raw = element[0] if element[0] in RAW else None
        elif piece:
            refs = "&" in piece
            if "<" in piece or (raw and refs):
                return None
            out.text(unescape(piece) if refs else piece)
    return None if raw else out.events


def _events(html: str | None) -> list[tuple]:
    """Events of a page: plain markup by one expression, other markup by the parser."""
    events = _plain_events(html or "")
    if events is None:
        w = _Walker()
        w.feed(html or "")
        w.close()
        events = w.out.events
    return events


def _end(events, start_idx: int) -> int:
    """Index of the event that closes the element opened at ``start_idx``."""
    depth = events[start_idx][4]
    return next((j for j in range(start_idx + 1, len(events)) if events[j][:2] == ("end", depth)), len(events))


def _single_string(events, start_idx: int) -> str | None:
    """The text of an element whose only child is a text, or an element of that kind."""
    end, at, texts, elements = _end(events, start_idx), start_idx + 1, [], []
    while at < end:
        if events[at][0] == "text":
            texts.append(events[at][1])
        elif events[at][0] == "start":
            elements.append(at)
            at = _end(events, at)
        at += 1
    if texts and not elements:
        return "".join(texts)
    return _single_string(events, elements[0]) if len(elements) == 1 and not texts else None


def parse_result_links(html: str, marker: str, k: int) -> list[str]:
    """H1: targets of the first ``k`` links whose single text holds ``marker``; of
    these, links without a target are dropped after the cut."""
    ev = _events(html)
    found = [e[5] for i, e in enumerate(ev) if e[0] == "start" and e[1] == "a" and marker in (_single_string(ev, i) or "")]
    return [href for href in found[:k] if href]


# The classes of a result card, its title link and its ingredient line.
CARD_CLASS = "search-results-product"
CARD_NAME_CLASS = "search-results-product-info-title-link"
CARD_TYPE_CLASS = "search-results-product-info-type"


def parse_result_cards(html: str, k: int) -> list[tuple[int, str, str]]:
    """H4: (position, name, ingredients) of the first ``k`` cards; cards that lack one
    of both elements are dropped after the cut."""
    ev = _events(html)
    out = []
    cards = [i for i, e in enumerate(ev) if e[0] == "start" and e[1] == "div" and CARD_CLASS in e[3]]
    for pos, c in enumerate(cards[:k]):
        inside = range(c + 1, _end(ev, c))
        parts = [next((j for j in inside if ev[j][0] == "start" and ev[j][1] == tag and cls in ev[j][3]), None)
                 for tag, cls in (("a", CARD_NAME_CLASS), ("div", CARD_TYPE_CLASS))]
        if None not in parts:
            out.append((pos, *["".join(t.strip() for t in _element_texts(ev, j)) for j in parts]))
    return out


def _element_texts(events, start_idx: int) -> list[str]:
    """Text nodes inside the element opened at ``events[start_idx]``."""
    depth = events[start_idx][4]
    out = []
    for ev in events[start_idx + 1:]:
        if ev[0] == "end" and ev[1] == depth:
            break
        if ev[0] == "text":
            out.append(ev[1])
    return out


def parse_detail_page(html: str, min_len: int = -1) -> tuple[dict[str, str], dict[str, str]]:
    """``(fields, sections)`` of one page: label -> value (a later duplicate
    label wins; a label without a following value is skipped) and section
    texts by id (text nodes stripped, empty ones dropped, joined by newlines;
    dropped when they hold the placeholder or are not longer than ``min_len``)."""
    ev = _events(html)
    fields: dict[str, str] = {}
    sections: dict[str, str] = {}
    data_start = next((i for i, e in enumerate(ev) if e[0] == "start" and e[2] == DATA_SECTION_ID), None)
    if data_start is not None:
        data_depth = ev[data_start][4]
        i = data_start + 1
        while i < len(ev) and not (ev[i][0] == "end" and ev[i][1] == data_depth):
            e = ev[i]
            if e[0] == "start" and e[1] == "label" and LABEL_CLASS in e[3]:
                key = "".join(t.strip() for t in _element_texts(ev, i))
                j = next((j for j in range(i + 1, len(ev))
                          if ev[j][0] == "start" and ev[j][1] == "div" and VALUE_CLASS in ev[j][3]), None)
                if j is not None:
                    fields[key] = "".join(t.strip() for t in _element_texts(ev, j))
            i += 1
    for sid, name in SECTION_IDS.items():
        k = next((i for i, e in enumerate(ev) if e[0] == "start" and e[1] == "div" and e[2] == sid), None)
        if k is not None:
            text = "\n".join(t.strip() for t in _element_texts(ev, k) if t.strip())
            if PLACEHOLDER not in text and len(text) > min_len:
                sections[name] = text
    return fields, sections


def _kind(pages: DataFrame, col: str) -> str:
    return pages.schema[col].dataType.simpleString()


def _per_page(pages: DataFrame, cols: list[str], schema: str, rows_of) -> DataFrame:
    """One parse per page inside an Arrow batch: ``rows_of(*cols)`` gives a page's rows."""
    ship_package(pages.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for page in zip(*[b[c] for c in cols]) for r in rows_of(*page)]
            yield pd.DataFrame(rows, columns=names)
    return pages.select(*cols).mapInPandas(run, schema)


def detail_fields(pages: DataFrame, page_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """H2 long form ``(page_id, pos, label, value)`` (``pos`` = label order)."""
    return _per_page(pages, [page_col, html_col], f"page_id {_kind(pages, page_col)}, pos long, label string, value string",
                     lambda pid, html: [(pid, n, k, v) for n, (k, v) in enumerate(parse_detail_page(html)[0].items())])


def detail_sections(pages: DataFrame, page_col: str = "page_id", html_col: str = "html", min_len: int = -1) -> DataFrame:
    """H3 ``(page_id, section, text)`` for the leaflet sections found by id; the brand
    search keeps texts longer than ten characters only (``min_len=10``)."""
    return _per_page(pages, [page_col, html_col], f"page_id {_kind(pages, page_col)}, section string, text string",
                     lambda pid, html: [(pid, k, v) for k, v in parse_detail_page(html, min_len)[1].items()])


def leaflet_records(pages: DataFrame, key_col: str, url_col: str, html_col: str = "html", min_len: int = -1,
                    keep: Sequence[str] = ()) -> DataFrame:
    """H2 and H3 from one parse: ``(search_key, url, fields, leaflet, practitioner)`` per
    page, the lookup side of J2/J3; ``keep`` passes further columns through."""
    def rows(key, url, html, *kept):
        fields, sections = parse_detail_page(html, min_len)
        return [(key, url, fields, sections.get("leaflet"), sections.get("practitioner"), *kept)]
    kept = "".join(f", {c} {_kind(pages, c)}" for c in keep)
    return _per_page(pages, [key_col, url_col, html_col, *keep],
                     "search_key string, url string, fields map<string,string>, leaflet string, practitioner string" + kept, rows)


def dom_result_links(pages: DataFrame, page_col: str, html_col: str, marker: str, k: int) -> DataFrame:
    """H1 on any markup: ``(page_id, rank, href)``."""
    return _per_page(pages, [page_col, html_col], f"page_id {_kind(pages, page_col)}, rank long, href string",
                     lambda pid, html: [(pid, n + 1, href) for n, href in enumerate(parse_result_links(html, marker, k))])


def dom_result_cards(pages: DataFrame, page_col: str, html_col: str, k: int) -> DataFrame:
    """H4 on the card markup: ``(page_id, pos, name, ingredients)``."""
    return _per_page(pages, [page_col, html_col], f"page_id {_kind(pages, page_col)}, pos long, name string, ingredients string",
                     lambda pid, html: [(pid, *card) for card in parse_result_cards(html, k)])


# Where a dosage page keeps its main text.
MAIN_CLASS = "contentBox"
MAIN_ID = "content"
HEADING_TAGS = ("h2", "h3")


def parse_main_block(html: str) -> tuple[str | None, str | None]:
    """H6 of one page: ``(text, headings)``.  The main block is the first
    ``div.contentBox``, else the element with id ``content``, else none (both
    null).  Its text nodes are joined by newlines unstripped; headings are the
    ``h2``/``h3`` texts inside it, stripped, joined by newlines."""
    ev = _events(html)
    k = next((i for i, e in enumerate(ev) if e[0] == "start" and e[1] == "div" and MAIN_CLASS in e[3]), None)
    if k is None:
        k = next((i for i, e in enumerate(ev) if e[0] == "start" and e[2] == MAIN_ID), None)
    if k is None:
        return None, None
    depth = ev[k][4]
    heads, texts, j = [], [], k + 1
    while j < len(ev) and not (ev[j][0] == "end" and ev[j][1] == depth):
        e = ev[j]
        if e[0] == "text":
            texts.append(e[1])
        elif e[0] == "start" and e[1] in HEADING_TAGS:
            heads.append("".join(_element_texts(ev, j)).strip())
        j += 1
    return "\n".join(texts), "\n".join(heads)


def main_blocks(pages: DataFrame, page_col: str = "page_id", html_col: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """H6 ``(page_id, main_text, headings)``; pages without a main block are skipped;
    ``keep`` passes further columns through."""
    def rows(pid, html, *kept):
        text, heads = parse_main_block(html)
        return [] if text is None else [(pid, text, heads, *kept)]
    kept = "".join(f", {c} {_kind(pages, c)}" for c in keep)
    return _per_page(pages, [page_col, html_col, *keep],
                     f"page_id {_kind(pages, page_col)}, main_text string, headings string" + kept, rows)
