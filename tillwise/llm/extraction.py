"""Main text of web pages by scoring their element tree.

A page is read into elements and blocks of text. Each block gives points to the elements
above it: 1, plus 1 per comma, plus 1 per 100 characters up to 3, all of it times the share
of its characters outside links. Its own container gets all of them, the next one half, the
n-th 1 / n. The container with the most points is the article; an enclosing <article> or
<main> takes its place. Its siblings with few links are kept if they have a fifth of its
points or enough text: 80 characters, or a sentence without links. Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by
element, role or name before scoring. A name alone never leaves out what holds the page's
<main> or foremost <article>, nor an element with most of the page's points (comments only
where there is no article): a page with such names is read twice, first for these points.

Character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by an empty line in page order. Unclosed and stray tags, comments and
quotes are handled as browsers do in the common cases.

Null and empty pages, and pages without text outside what is left out, give an empty text.
Pages of any length are read whole, in time linear in their length. Of containers with
equal points the first one wins. Repeated rows and null columns are kept as they are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.text import arrow, batch_of, chunks

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp template svg object annotation annotation-xml".split())
OUT = frozenset("head nav footer aside button select menu canvas audio video".split()) | RAW
#: Left out unless they hold most of the page, or its article; a header also where it is inside.
WEIGHED = frozenset("header form dialog noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav noscript ol option p pre section select summary table tbody tfoot thead tr ul caption".split()
)
CELL = frozenset(("td", "th", "br"))
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SENTENCE_ENDS = tuple(".!?…。！？")
#: What a start tag closes, if it is open up to the nearest of the elements named last.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "body": (("head",), ("html",)),
}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog menu menubar".split())
WEIGHED_ROLES = frozenset("dialog form".split())
NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer sidebar aside notice notices cookie cookies consent "
    "gdpr alert ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus replies respond "
    "form search share sharing social related newsletter subscribe subscription popup modal overlay widget login signup paywall pager "
    "pagination toolbar skip".split()
)
EXEMPT = HEADING | frozenset(("html", "body", "main"))
COMMENT_NAMES = frozenset(("comment", "comments", "replies"))

def _token(quoted: str) -> re.Pattern:
    return re.compile(
        r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
        rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]{quoted}+\"|'[^']{quoted}+')*+)>"
        r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
        re.DOTALL,
    )


#: Quotes are read to their end, whatever their length, until UNENDED tags of a page turned
#: out to have one that does not end; then for 8,192 characters, so that time stays linear.
TOKEN, SHORT_TOKEN, UNENDED = _token("*"), _token("{0,8192}"), 64
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Element:
    """An open or closed element: `out` if it or one above it is left out."""

    __slots__ = ("tag", "above", "out", "points", "size", "linked", "depth", "number")

    def __init__(self, tag: str, above: Element | None, out: bool) -> None:
        self.tag, self.above, self.out = tag, above, out
        self.points, self.size, self.linked = 0.0, 0, 0
        self.depth = above.depth + 1 if above else 0
        self.number = 0


class Block(NamedTuple):
    text: str
    linked: int
    place: Element


def left_out(tag: str, rest: str) -> str:
    """Why an element is left out: "kind" for its element or role, whatever it holds;
    "header" for the element, "name" for an element, role, style, class or id, "comment" for a
    class or id, which are weighed; or ""."""
    if tag in OUT:
        return "kind"
    why = "header" if tag == "header" else "name" if tag in WEIGHED else ""
    if not rest or rest.isspace():
        return why
    for name, *values in ATTRIBUTE.findall(rest):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id") and tag not in EXEMPT:
            parts = {p.lower() for p in NAME_PART.findall(value)}
            if parts & (COMMENT_NAMES if tag == "article" else NAMES):
                why = "comment" if parts & COMMENT_NAMES else why or "name"
        elif name == "role" and value.lower() in ROLES:
            return "kind"
        elif name == "role" and value.lower() in WEIGHED_ROLES:
            why = why or "name"
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and UNSEEN.search(value):
            why = "name" if why in ("", "header") else why
    return why


class Page:
    """Reads a page into blocks. Without `kept`, named elements are read as well and
    collected in `named` (number and left_out); with it, only those it has are read."""

    def __init__(self, source: str, kept: set[int] | None = None) -> None:
        self.here = Element("", None, False)
        self.kept, self.started = kept, 0
        self.named: dict[int, str] = {}
        self.open: dict[str, int] = {}
        self.links, self.blocks = 0, []
        self.parts: list[str] = []
        self.linked = 0
        at, size, unended = 0, len(source), 0
        while at < size:
            token = (TOKEN if unended < UNENDED else SHORT_TOKEN).search(source, at)
            self.text(source[at : token.start() if token else size])
            if not token:
                break
            at = token.end()
            tag = (token["tag"] or token["tag2"] or "").lower()
            if not tag:
                continue
            unended += token["tag2"] is not None
            if token["end"] or token["end2"]:
                self.close(tag)
            else:
                rest = token["rest"] or token["rest2"] or ""
                self.start(tag, rest)
                if tag in RAW and not rest.endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(source, at)
                    at = end.end() if end else size
                    self.close(tag)
        self.flush()

    def text(self, piece: str) -> None:
        if piece and not self.here.out:
            self.parts.append(piece)
            if self.links:
                self.linked += len(piece.strip())

    def flush(self) -> None:
        """End the block that is being read."""
        if self.parts:
            whole = "".join(self.parts)
            whole = " ".join((html.unescape(whole) if "&" in whole else whole).split())
            if whole:
                self.blocks.append(Block(whole, min(self.linked, len(whole)), self.here))
            self.parts, self.linked = [], 0

    def push(self, element: Element) -> None:
        self.here = element
        self.open[element.tag] = self.open.get(element.tag, 0) + 1
        self.links += element.tag == "a"

    def pop(self) -> str:
        gone = self.here
        if gone.number in self.named:
            self.flush()
        self.open[gone.tag] -= 1
        self.links -= gone.tag == "a"
        self.here = gone.above
        return gone.tag

    def start(self, tag: str, rest: str) -> None:
        if tag in CELL:
            self.parts.append(" ")
        if tag in BLOCK:
            self.flush()
            if self.open.get("p"):
                self.close_up(("p",), ("td", "th", "table", "div", "article", "section", "li", "blockquote"))
        if tag in CLOSES:
            self.close_up(*CLOSES[tag])
        if tag not in VOID:
            self.started += 1
            element = Element(tag, self.here, self.here.out)
            element.number = self.started
            why = "" if element.out else left_out(tag, rest)
            if why and why != "kind" and self.kept is None:
                self.flush()
                self.named[element.number] = why
            elif why:
                element.out = why == "kind" or element.number not in self.kept
            self.push(element)

    def close_up(self, tags: tuple[str, ...], until: tuple[str, ...]) -> None:
        """Close the outermost open element of `tags` inside the nearest of `until`."""
        if not any(self.open.get(t) for t in tags):
            return
        found, element = None, self.here
        while element.above and element.tag not in until:
            if element.tag in tags:
                found = element
            element = element.above
        while found and self.here is not found.above:
            self.pop()

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        elif tag in CELL:
            self.parts.append(" ")
        if not self.open.get(tag):
            return
        if tag not in BLOCK and tag not in RAW:
            # The end of a phrase closes nothing across the bounds of a block.
            element = self.here
            while element.tag != tag:
                if element.tag in BLOCK:
                    return
                element = element.above
        while self.pop() != tag:
            pass


def container(element: Element) -> Element:
    """The element whose block a text is part of."""
    while element.above and element.above.above and element.tag not in BLOCK:
        element = element.above
    return element


def points_of(text: str, linked: int) -> float:
    return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))


def stands_in(element: Element, around: Element) -> bool:
    """Whether an element is inside another, with nothing that is weighed between them."""
    while element.above and element.depth > around.depth + 1:
        element = element.above
        if element.tag in WEIGHED:
            return False
    return element.above is around


def worth_keeping(page: Page) -> set[int]:
    """The numbers of the named elements that stay: those with most of the page's points,
    those around its <main> or <article> with the most points, if it has a fifth of all, and
    the headers inside that <article>. Comments stay for their points only on a page without such."""
    points: dict[Element, float] = {}
    total = 0.0
    for text, linked, place in page.blocks:
        gain, element = points_of(text, linked), place
        total += gain
        while element and element not in points:
            points[element] = 0.0
            element = element.above
        points[place] += gain
    for element in sorted(points, key=lambda e: -e.depth):
        if element.above:
            points[element.above] += points[element]
    named = [e for e in points if e.number in page.named]
    articles = [e for e in points if e.tag in ("article", "main") and e.number not in page.named and 5 * points[e] >= total]
    kept = {e.number for e in named if 2 * points[e] > total and not (articles and page.named[e.number] == "comment")}
    element = best = max(articles, key=lambda e: (points[e], -e.number)) if articles else None
    if best and best.tag == "article":
        kept |= {e.number for e in named if page.named[e.number] == "header" and stands_in(e, best)}
    while element:
        kept.add(element.number)
        element = element.above
    return kept


def score(blocks: list[Block]) -> list[Element]:
    """Give points to all elements above the blocks; those that got some, in page order."""
    seen: dict[int, Element] = {}
    for text, linked, place in blocks:
        size = len(text)
        points = points_of(text, linked)
        own = container(place)
        element, n = own.above if own.above and own.tag in ("p", "pre", "li", "blockquote", *HEADING) else own, 0
        if element is not own:
            own.size, own.linked, own.points = own.size + size, own.linked + linked, own.points + points
            seen.setdefault(id(own), own)
        while element:
            if element.tag in BLOCK or not element.above:
                n += 1
                element.points += points / n
                element.size += size
                element.linked += linked
                seen.setdefault(id(element), element)
            element = element.above
    return list(seen.values())


def main_text(source: str | None) -> str:
    """The page's main text."""
    page = Page(source or "")
    if page.named:
        page = Page(source or "", worth_keeping(page))
    blocks = page.blocks
    if not blocks:
        return ""
    elements = score(blocks)
    containers = [e for e in elements if e.tag not in ("p", "pre", "li", "blockquote", *HEADING)] or elements
    best = max(containers, key=lambda e: e.points)
    element = best
    while element:
        if element.tag in ("article", "main"):
            best = element
        element = element.above if element.tag != "article" else None
    kept = {id(best)}
    last = {}
    for text, _, place in blocks:
        element = place
        while element and element.above is not best.above:
            element = element.above
        last[id(element)] = text
    for other in elements:
        if other.above is best.above and 3 * other.linked < other.size:
            sentence = not other.linked and last.get(id(other), "").endswith(SENTENCE_ENDS)
            if other.points >= 0.2 * best.points or other.size >= 80 or sentence:
                kept.add(id(other))
    return "\n\n".join(b.text for b in blocks if inside(b.place, kept))


def inside(element: Element | None, kept: set[int]) -> bool:
    while element:
        if id(element) in kept:
            return True
        element = element.above
    return False


TEXT = "page_id {id}, url {url}, text string, n_chars long"


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points of the text) of every page."""
    schema = TEXT.format(id=pages.schema[page_id].dataType.simpleString(), url=pages.schema[url].dataType.simpleString())
    out = arrow(schema)

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield batch_of(out, page_id=batch.column("page_id"), url=batch.column("url"), text=texts, n_chars=[len(t) for t in texts])

    columns = (F.col(c).alias(name) for c, name in ((page_id, "page_id"), (url, "url"), (source, "html")))
    return pages.select(*columns).mapInArrow(extract, schema)
