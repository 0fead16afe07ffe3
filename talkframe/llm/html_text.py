"""The main text of web pages, by the ratios of their tag paths.

A page becomes a row of blocks, each with its tag path: the block-level elements from the root
down, containers with their classes. Elements that are never part of an article (menus, forms,
scripts, asides, and those whose class, id or role says so) are left out first. Over a page's
blocks, every tag path gets its letters outside of links and its punctuation marks, each for a
block; both ratios are smoothed over the page's order, fused to one value a path, and the paths
near the best one are content. The article is the element that holds their text, with all blocks
of it that are not mostly links, so that headings and short paragraphs stay.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, lean, table, tidy, unboxed

#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li"
    " main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is characters up to their own end tag.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: Elements that are no part of an article, wherever they are; a header is, inside of an article.
NEVER = RAW | frozenset("applet aside audio button canvas datalist dialog fieldset footer form head legend math menu nav noscript object optgroup option search select svg template video".split())
NEVER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of classes and ids of what surrounds an article.
AROUND = frozenset(
    "ad ads advert adverts advertisement advertisements advertising advertorial banner banners promo promos promotion sponsor sponsored sponsors"
    " aside sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar"
    " cookie cookies consent gdpr notice notices notification newsletter subscribe subscription signup login popup popover modal overlay paywall"
    " comment comments commentary commentlist reply replies respond disqus discussion feedback"
    " share sharing social related recommended recommendations widget widgets copyright hidden".split()
)
#: Words of what surrounds an article, unless the name also has a word of an article's.
OUTSIDE, INSIDE = frozenset("bottom form head header left right search side tags tools".split()), frozenset("article body content entry main post story text".split())
#: A class with such a word tells of the page's layout and not of the element.
LAYOUT = frozenset("has no with without".split())
#: What closes an open element of the same family on its start, and what such a search does not cross.
FAMILIES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLES = frozenset(("article", "main"))
#: Elements that are parts of an article and not one, and those that may hold a whole page.
PARTS, OPEN = HEADINGS | frozenset("p li pre blockquote dd dt tr".split()), frozenset(("", "html", "body"))
#: A cell's elements are not closed by end tags from outside.
BARRIERS = frozenset("table caption td th template object applet html".split())
OF_TABLES, ROWS, P_BARRIERS = frozenset("caption table tbody td tfoot th thead tr".split()), frozenset(("table", "html")), BARRIERS | {"button"}
IN_HEAD = frozenset("base head html link meta noscript script style template title".split())

TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/]|\Z))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
MARKS = re.compile(r"[.,;:!?…‽¿¡،؛؟।。，、；：！？]")

#: Share of the best path's value that makes a path content; share of the content's letters that leads on to one child.
LEAST_SHARE, MOST_OF = 0.5, 0.7
#: Share of linked letters from which a path is a list of links.
LINKED = 0.6
#: Blocks, such as an author or a date, between a headline and the content under it.
MOST_BETWEEN = 4


@dataclass(eq=False, slots=True)
class Element:
    tag: str
    #: The block-level element around it, and itself if it is one.
    above: Element | None
    block: Element | None = None
    #: Number of its tag path on this page.
    path: int = 0
    left_out: bool = False
    linked: bool = False
    in_article: bool = False
    #: Letters of content in it, and its child with the most.
    weight: int = 0
    heaviest: Element | None = None
    inside: bool = False


@dataclass(slots=True)
class Block:
    text: str
    element: Element
    linked: int
    letters: int = field(init=False)
    marks: int = field(init=False)

    def __post_init__(self) -> None:
        self.letters = len(self.text) - self.text.count(" ")
        self.marks = len(MARKS.findall(self.text))


def _left_out(tag: str, attributes: str, in_article: bool) -> tuple[bool, str]:
    """Whether an element is left out, and its class as a part of its path."""
    never = tag in NEVER or (tag == "header" and not in_article)
    if never or not attributes:
        return never, ""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    out = "hidden" in found or found.get("role", "").strip().lower() in NEVER_ROLES
    out = out or ("style" in found and re.search(r"display\s*:\s*none", found["style"], re.I) is not None)
    if not out and tag not in ("html", "body"):
        for name in f"{found.get('class', '')} {found.get('id', '')}".split():
            words = {w.lower() for w in WORDS.findall(name)}
            out = out or (not words & LAYOUT and bool(words & AROUND or (words & OUTSIDE and not words & INSIDE)))
    return out, found.get("class", "")


class Page:
    """``blocks`` of text in their order and the ``elements`` that hold them, but for those left out."""

    def __init__(self, page: str) -> None:
        top = Element("", None)
        top.block = top
        self.elements, self.blocks, self.stack = [top], [], [top]
        self.paths: dict[tuple[int, str], int] = {}
        self.open: dict[str, int] = defaultdict(int)
        self.parts: list[str] = []
        self.linked, self.owner = 0, top
        place = 0
        while m := TAG.search(page, place):
            self._say(page[place : m.start()])
            place = m.end()
            if m[2]:
                tag = m[2].lower()
                self._tag(tag, bool(m[1]), m[3])
                if tag in RAW and not m[1]:
                    end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, place)
                    place = end.start() if end else len(page)
        self._say(page[place:])
        self._flush()

    def _say(self, raw: str) -> None:
        at = self.stack[-1]
        if raw and not at.left_out:
            if not self.parts:
                self.owner = at.block
            text = html.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if at.linked:
                self.linked += len("".join(text.split()))

    def _flush(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.blocks.append(Block(text, self.owner, self.linked))
            self.parts, self.linked = [], 0

    def _pop_to(self, i: int) -> None:
        for e in self.stack[i:]:
            self.open[e.tag] -= 1
        del self.stack[i:]

    def _close(self, tags: Collection[str], barrier: Collection[str]) -> None:
        if all(not self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in tags:
                return self._pop_to(i)
            if tag in barrier:
                return

    def _tag(self, tag: str, end: bool, attributes: str) -> None:
        is_block = tag in BLOCKS
        if is_block:
            self._flush()
        elif tag == "br":
            self._say(" ")
        if end:
            if self.open[tag]:
                self._close((tag,), ROWS if tag in OF_TABLES else BARRIERS if is_block or tag in NEVER else BLOCKS)
            return
        if self.open["head"] and tag not in IN_HEAD:
            self._close(("head",), ())
        if is_block:
            if self.open["p"]:
                self._close(("p",), P_BARRIERS)
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self._pop_to(len(self.stack) - 1)
        if tag in FAMILIES:
            self._close(*FAMILIES[tag])
        if tag in VOID or (tag in ("svg", "math") and attributes.endswith("/")):
            return
        above = self.stack[-1]
        if above.left_out and not is_block and tag not in NEVER:
            return
        left_out, name = (True, "") if above.left_out else _left_out(tag, attributes, above.in_article)
        new = Element(tag, above.block, above.block, above.path, left_out, above.linked or tag == "a", above.in_article or tag in ARTICLES)
        if is_block:
            label = tag if tag == "p" or tag in HEADINGS else f"{tag} {name}"
            new.block, new.path = new, self.paths.setdefault((above.path, label), len(self.paths) + 1)
            if not left_out:
                self.elements.append(new)
        self.stack.append(new)
        self.open[tag] += 1


def _smoothed(row: list[float]) -> list[float]:
    """Means of neighbours, weighted by a bell curve of one place."""
    side, n = math.exp(-0.5), len(row)
    out = []
    for i, x in enumerate(row):
        near = row[max(0, i - 1) : i] + row[i + 1 : i + 2]
        out.append((x + side * sum(near)) / (1 + side * len(near)) if n > 1 else x)
    return out


def path_values(found: list[Block]) -> dict[int, float]:
    """The fused value of each tag path: letters outside of links and marks, each a block and smoothed along the page."""
    blocks, letters, linked, marks = Counter(), Counter(), Counter(), Counter()
    for b in found:
        path = b.element.path
        blocks[path] += 1
        letters[path] += b.letters - min(b.linked, b.letters)
        linked[path] += min(b.linked, b.letters)
        marks[path] += b.marks
    ratios = [_smoothed([sums[b.element.path] / blocks[b.element.path] for b in found]) for sums in (letters, marks)]
    fused: dict[int, float] = defaultdict(float)
    for b, text, mark in zip(found, *ratios, strict=True):
        path = b.element.path
        # Links get nothing from their neighbours.
        fused[path] += letters[path] / (letters[path] + linked[path]) * math.log1p(text) * math.log(2 + mark) / blocks[path]
    return fused


def _root(page: Page, chosen: set[int]) -> tuple[Element, set[int]]:
    """The element that holds the content, and the ids of it and of its equals beside it."""
    for b in page.blocks:
        if b.element.path in chosen:
            b.element.weight += b.letters
    for e in reversed(page.elements[1:]):
        e.above.weight += e.weight
        if e.weight and (e.above.heaviest is None or e.weight >= e.above.heaviest.weight):
            e.above.heaviest = e
    root, article = page.elements[0], None
    while root.heaviest is not None and root.heaviest.weight >= MOST_OF * root.weight:
        root = root.heaviest
        article = root if root.tag == "article" else article
    while root.tag in PARTS:  # a lone paragraph is no article: what holds it is
        root = root.above
    root = article or root
    equals = [e for e in page.elements if e.above is root.above and e.path == root.path and e.weight] if root.above and not article else []
    return root, {id(root), *map(id, equals)}


def main_text(html_of_page: str | None) -> str:
    """The article's blocks, joined by blank lines; empty if there is none."""
    page = Page(html_of_page or "")
    found = page.blocks
    if not found:
        return ""
    values = path_values(found)
    least = LEAST_SHARE * max(values.values())
    if not least:  # links and nothing else
        return ""
    chosen = {p for p, v in values.items() if v >= least}
    root, roots = _root(page, chosen)
    for e in page.elements:
        e.inside = id(e) in roots or (e.above is not None and e.above.inside)
    letters, linked = Counter(), Counter()
    for b in found:
        letters[b.element.path] += b.letters
        linked[b.element.path] += b.linked
    text = {p for p in letters if p in chosen or linked[p] < LINKED * letters[p]}
    # Where nothing says where the article is, it goes from the first content to the last.
    own = [i for i, b in enumerate(found) if b.element.inside and (b.element.path in chosen or root.tag not in OPEN)]
    first, last, start = own[0], own[-1], own[0]
    around, e = set(), root
    while e is not None:
        around.add(id(e))
        e = e.above
    for i in range(first - 1, -1, -1):
        tag = found[i].element.tag
        if tag in HEADINGS and id(found[i].element.above) in around:
            start = i  # the headline over it, with what lies between
        if tag == "h1" or i < first - MOST_BETWEEN:
            break
    return "\n\n".join(b.text for b in found[start : last + 1] if b.element.path in text and (b.element.inside or id(b.element.above) in around))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``, the article of each page's html, and ``n_chars``, its code points.

    Null and empty html give an empty text, as does a page that is all menu; html that is cut off,
    without tags or with tags that never close is read as browsers do. Of paths with equal values all
    are content; of two elements that hold equally much the first counts. Repeated rows are read
    each, whole, however long; null keys stay; an empty table gives an empty result; all other
    columns are kept, those of the result's names are replaced.
    """
    kept = [f for f in boxed(pages).schema["row"].dataType.fields if f.name.lower() != "html"]
    row = F.struct(*(F.col(f"`{f.name}`") for f in kept)) if kept else F.struct(F.lit(0).alias("none"))
    given = lean(pages.select(row.alias("row"), F.col("html").alias("given")))
    schema = given.drop("given").schema.add("text", "string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p) for p in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["row", "text"])

    done = given.mapInArrow(tidy(read), schema)
    columns = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return unboxed(done, pages.drop("html"), **columns)


def op11_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
