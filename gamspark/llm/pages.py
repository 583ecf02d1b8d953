"""Main text of web pages by tag-path ratios.

A page becomes a row of blocks, each with its path of open elements from the root (inline elements do not count; unclosed
paragraphs, items and cells end where HTML ends them). Text length, marks of punctuation and link text are summed per path. A
path's two ratios, text per block and marks per block, are smoothed over neighbouring blocks and fused into one score of a block;
the mean of a path's blocks is the path's score, and paths above the threshold are content. The smallest container with nearly all
of the content score is the article. Inside it the same scores decide: blocks of content paths stay, also paragraphs and items
lifted above the threshold by their neighbours, headings of a block that stays, and items, cells, quotes and captions without links between two
blocks that stay; anything else (teasers, lists of tags, unnamed notices and short comments) goes. An unnamed comment whose path
looks like the article's paragraphs cannot be told apart.

Menus, headers, footers, sidebars and hidden elements are left out by element and role before. A class or id leaves an element out
if a whole name of it says so (``cookie-notice``, ``main-nav``, not ``has-sidebar`` or ``ad-free``), and such a name, or a form,
is overruled if next to all of the page's content score lies in it; names of reader comments and notices are not.

Nulls and odd cases: null or empty html gives an empty text; html without any element is one block of text; a missing end tag
ends with its parent; repeated rows give the same result each; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pick, small_batches, table
from .registry import query

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe xmp noembed noframes svg math object audio video canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rp rt s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
BOILERPLATE = frozenset("head nav header footer aside button select option optgroup dialog menu fieldset legend".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog menu menubar alert alertdialog toolbar".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "footer header masthead toolbar topbar comment comments reply replies respond disqus share sharing social related "
    "recommended newsletter subscribe subscription signup login search widget skip hidden copyright".split()
)
#: Words that may stand beside a boilerplate word in a name.
NEUTRAL_NAMES = frozenset(
    "the my js site page main top bottom left right center inner outer upper lower global primary secondary mobile desktop list item items "
    "box bar block wrapper wrap container section area group panel row column col unit slot links link posts post articles stories "
    "icons buttons button form field text content header title thread feed".split()
)
#: Names that no content score overrules.
NEVER_CONTENT = frozenset("comment comments reply replies respond disqus cookie cookies consent gdpr notice notices alert hidden".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
BETWEEN = frozenset("li dt dd td th caption blockquote pre figcaption figure p".split())
CONTAINERS = frozenset("html body main article section div td table tbody tr center".split())
ARTICLE = frozenset(("article", "main"))
#: An element that begins ends these open ones, up to the nearest of its scope.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
MARKS = re.compile(r"[.,;:!?…。，、！？¿¡]")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME_BREAK = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
THRESHOLD = 0.5
#: Left-out names are overruled if no more than this share of the content score lies elsewhere.
ELSEWHERE = 0.1
CONTENT_SHARE = 0.6
#: Weights of a block and its two neighbours on each side when ratios are smoothed.
SMOOTHING = (0.4, 0.2, 0.1)


class Element:
    """``named``: the elements from the root to this one that a class, an id or a form leaves out unless the scores overrule it."""

    __slots__ = ("name", "label", "dropped", "named", "firm", "parent", "in_article")

    def __init__(self, name: str, label: str, dropped: bool, named: bool, firm: bool, parent: Element | None):
        self.name, self.label, self.firm, self.parent = name, label, firm, parent
        self.dropped = dropped or bool(parent and parent.dropped)
        self.named = (*(parent.named if parent else ()), *((self,) if named else ()))
        self.in_article = name in ARTICLE or bool(parent and parent.in_article)


def _says_boilerplate(names: str) -> tuple[bool, bool]:
    """Whether a whole name says that the element is something else, and whether that is final."""
    said = firm = False
    for name in names.split():
        words = [w.lower() for w in NAME_BREAK.split(name) if w]
        own = [w for w in words if w in BOILERPLATE_NAMES]
        if own and all(w in BOILERPLATE_NAMES or w in NEUTRAL_NAMES for w in words):
            said, firm = True, firm or not NEVER_CONTENT.isdisjoint(own)
    return said, firm


def _element(name: str, attributes: str, parent: Element) -> Element:
    label, drop, named, firm = name, name in BOILERPLATE, name == "form", False
    if name == "header" and parent.in_article:
        drop = False  # an article's own heading
    for key, a, b, c in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            if key == "class":
                label += "." + re.sub(r"\d+", "", value.lower())  # numbered classes and ids do not part paths
            if name not in ("html", "body") and name not in ARTICLE:
                says, final = _says_boilerplate(value)
                named, firm = named or says, firm or final
        elif key == "role":
            drop |= value.lower() in BOILERPLATE_ROLES
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            drop = True
        elif key == "style":
            drop |= "display:none" in value.lower().replace(" ", "")
    return Element(name, label, drop, named, firm, parent)


class Block:
    __slots__ = ("text", "element", "links")

    def __init__(self, text: str, element: Element, links: int):
        self.text, self.element, self.links = text, element, links

    def path(self) -> tuple[str, ...]:
        out, at = [], self.element
        while at:
            out.append(at.label)
            at = at.parent
        return tuple(reversed(out))


def blocks(page: str) -> list[Block]:
    """Runs of text without a block border in page order, character references decoded, white space made one space."""
    root = Element("", "", False, False, False, None)
    at, out, pieces, link_chars, links, position = root, [], [], 0, 0, 0

    def flush() -> None:
        nonlocal pieces, link_chars
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            out.append(Block(text, at, min(link_chars, len(text))))
        pieces, link_chars = [], 0

    def close_to(names: set, scope: set) -> None:
        nonlocal at
        seek = at
        while seek.parent and seek.name not in scope:
            if seek.name in names:
                at = seek.parent
                return close_to(names, scope)
            seek = seek.parent

    def text_to(end: int) -> None:
        nonlocal link_chars
        if end > position:
            pieces.append(page[position:end])
            if links:
                link_chars += end - position

    match = TAG.search(page)
    while match:
        text_to(match.start())
        position = match.end()
        slash, name, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if name:
            name = name.lower()
            if name in RAW and not slash:
                if name not in ("svg", "math") or not (attributes or "").rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, position)
                    position = end.end() if end else len(page)
            elif name == "br":
                pieces.append(" ")
            elif name in INLINE:
                if name == "a":
                    links = 0 if slash else 1
            elif name in VOID:
                flush()
            elif slash:
                seek = at
                while seek and seek.name != name:
                    seek = seek.parent
                flush()
                if seek and seek.parent:
                    at, links = seek.parent, 0
            else:
                flush()
                links = 0
                close_to({"p"}, {"td", "th", "button", "table"})
                if name in ENDS:
                    close_to(ENDS[name], SCOPE[name])
                at = _element(name, attributes or "", at)
        match = TAG.search(page, position)
    text_to(len(page))
    flush()
    return out


def _smooth(x: list[float]) -> list[float]:
    out = []
    for i in range(len(x)):
        total = weight = 0.0
        for d in range(-2, 3):
            if 0 <= i + d < len(x):
                total += SMOOTHING[abs(d)] * x[i + d]
                weight += SMOOTHING[abs(d)]
        out.append(total / weight)
    return out


def scores(found: list[Block]) -> tuple[list[float], list[float]]:
    """Fused score of each block from the smoothed ratios of its path, and the score of its path. Only elements of running text are
    lifted by their neighbours; others (``div``) score no more than their own ratios."""
    chars, marks, links, count = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    paths = [b.path() for b in found]
    for path, block in zip(paths, found):
        chars[path] += len(block.text)
        marks[path] += len(MARKS.findall(block.text))
        links[path] += block.links
        count[path] += 1
    text_ratio, mark_ratio = [chars[p] / count[p] for p in paths], [marks[p] / count[p] for p in paths]

    def fuse(texts: list[float], marks: list[float]) -> list[float]:
        return [math.log1p(t) * (1 + math.log1p(m)) * (1 - links[p] / chars[p]) for t, m, p in zip(texts, marks, paths)]

    own, fused = fuse(text_ratio, mark_ratio), fuse(_smooth(text_ratio), _smooth(mark_ratio))
    fused = [f if b.element.name in BETWEEN else min(f, o) for f, o, b in zip(fused, own, found)]
    total = defaultdict(float)
    for f, path in zip(fused, paths):
        total[path] += f
    return fused, [total[p] / count[p] for p in paths]


def _without_named(found: list[Block]) -> list[Block]:
    """Blocks outside of elements that a name leaves out, but for names that the content score overrules."""
    if not any(b.element.named for b in found):
        return found
    _, of_path = scores(found)
    share: dict[Element, float] = defaultdict(float)
    total = 0.0
    for f, block in zip(of_path, found):
        if any(e.firm for e in block.element.named):
            continue
        total += f * len(block.text)
        for e in block.element.named:
            share[e] += f * len(block.text)
    overruled = {e for e, s in share.items() if s >= (1 - ELSEWHERE) * total > 0}
    return [b for b in found if all(e in overruled and not e.firm for e in b.element.named)]


def _chosen(inside: list[tuple[Block, float, float]], threshold: float) -> str:
    """Blocks of the article that are content by their path's score, their own, or what stands around them."""
    keep = [max(f, p) >= threshold for _, f, p in inside]
    last = max((i for i, k in enumerate(keep) if k), default=-1)
    first = keep.index(True) if last >= 0 else 0
    for i in range(last - 1, -1, -1):
        block = inside[i][0]
        if block.element.name in HEADINGS:
            keep[i] |= keep[i + 1]
        elif first < i and block.element.name in BETWEEN:
            keep[i] |= 2 * block.links < len(block.text)
    return " ".join(b.text for (b, _, _), k in zip(inside, keep) if k)


def main_text(page: str | None) -> str:
    """The article's text; empty if none."""
    found = _without_named([b for b in blocks(page or "") if not b.element.dropped])
    if not found:
        return ""
    fused, of_path = scores(found)
    threshold = THRESHOLD * sum(f * len(b.text) for f, b in zip(of_path, found)) / sum(len(b.text) for b in found)
    share: dict[Element, float] = defaultdict(float)
    children: dict[Element, set] = defaultdict(set)
    for f, block in zip(of_path, found):
        at = block.element
        while at:
            share[at] += f * len(block.text) if f >= threshold else 0.0
            if at.parent:
                children[at.parent].add(at)
            else:
                top = at
            at = at.parent
    at = top
    while at.name not in ARTICLE:
        inner = [c for c in children[at] if c.name in CONTAINERS and share[c] >= CONTENT_SHARE * share[at] > 0]
        if not inner:
            break
        at = inner[0]
    rows = list(zip(found, fused, of_path))
    if at.name not in ARTICLE:  # several articles side by side are all content
        articles = [e for e in share if e.name == "article" and share[e] > 0]
        if articles and sum(share[e] for e in articles if not (e.parent and e.parent.in_article)) >= CONTENT_SHARE * share[at]:
            return _chosen([r for r in rows if r[0].element.in_article], threshold)

    def inside(element: Element | None) -> bool:
        while element and element is not at:
            element = element.parent
        return element is at

    return _chosen([r for r in rows if inside(r[0].element)], threshold)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars. A narrow job: pages are independent."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": batch.column("page_id").cast(pa.int64()), "url": batch.column("url").cast(pa.string()),
                    "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                }
            )

    return pick(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


@query("op9_main_text")
def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))
