"""HTML extraction by tag-path ratios: which root-to-leaf tag paths carry a page's prose, and the region that they span.

1. A tolerant scan turns the page into text nodes with their tag paths; markup that never is article text (menus, scripts) is
   left out with all it holds. Forms and elements that name themselves menus, comments and the like are left out only where they
   don't hold the page's prose.
2. For each path: code points and punctuation over its nodes give a length ratio and a punctuation ratio; ratios are smoothed
   over the nodes in page order and fused by multiplying, and a path's score is the mean over its text.
3. Paths of at least THRESHOLD of the page's mean score are content paths, and their nodes the content nodes.
4. The article is the least element that holds all content nodes (from an article element on: all on the article's own paths).
   All its blocks are the text, so short headings and list items stay in; so does a title just outside.
All passes are linear in the page: subtree sums run once over the elements, and tags are closed through counts of open ones.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, table

#: Share of the prose that the article's element must hold before it is widened.
HOLDS = 0.7
#: Shares of the prose that keep an element in against its name: with a landmark in it; without one, if none is elsewhere.
KEEPS, KEEPS_BARE = 0.5, 0.9
#: Standard deviation of the smoothing, in text nodes, and its reach.
SIGMA, REACH = 1.0, 2
#: Content paths have at least this share of the mean score over the page's code points.
THRESHOLD = 0.3

VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements left out with all they hold.
DROP = frozenset("head nav header footer aside script style noscript template svg math canvas object embed iframe button select option textarea input dialog menu audio video map applet title xmp noembed noframes".split())
BLOCK = frozenset("address article blockquote body center dd details dir div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 hgroup hr html legend li main ol optgroup p pre section summary table tbody td tfoot th thead tr caption ul".split())
#: A start tag ends these open elements, up to the given bounds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
BOUND = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "tbody": ("table",), "tfoot": ("table",)}
ENDS_P = (BLOCK | {"nav", "header", "footer", "aside", "menu"}) - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: Words in class or id of elements that aren't the article.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist commentary consent cookie cookies copyright dialog disclaimer discussion disqus "
    "footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager paginate pagination paywall popup promo promotion recommended related "
    "replies reply respond search share sharebar sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
#: Those that parts of an article bear as well: such an element stays if its text is on paths of the prose outside.
WEAK = frozenset("commentary consent discussion disclaimer login notice notices promotion reply respond search share sharing social subscription".split())
#: Those that the head of an article bears as well: inside an article element they say nothing.
HEADS = frozenset("banner header masthead".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar tooltip".split())
#: Elements that a class or id name alone doesn't leave out.
KEPT = frozenset(("html", "body", "main"))
LANDMARKS = frozenset(("article", "main", "h1"))
#: Elements at which the search for an open paragraph, or for an open list item or cell, may end.
P_STOPS = frozenset("p td th button table li div article section body".split())
ITEM_STOPS = frozenset("li dt dd tr td th option tbody thead ul ol menu dir dl table".split())
#: Elements that can be an article's region.
REGIONS = frozenset("article main section div form td body html #page center".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？]")


class _Element:
    __slots__ = ("tag", "parent", "index", "depth", "path", "drop", "block", "suspect", "weak", "article", "h1", "p_stop", "item_stop")

    def __init__(self, tag: str, parent: _Element | None, index: int, paths: dict, drop: bool, named: frozenset[str] = frozenset()):
        self.tag, self.parent, self.index = tag, parent, index
        self.depth = parent.depth + 1 if parent else 0
        self.path = paths.setdefault((parent.path if parent else -1, tag), len(paths))
        self.article = tag == "article" or bool(parent and parent.article)
        if parent and parent.article:
            drop, named = drop and tag != "header", named - HEADS
        self.drop, self.block = drop or bool(parent and parent.drop), tag in BLOCK
        self.suspect, self.weak = bool(named), bool(named) and named <= WEAK
        self.h1 = tag == "h1" or bool(parent and parent.h1)
        self.p_stop = self if tag in P_STOPS or parent is None else parent.p_stop
        self.item_stop = self if tag in ITEM_STOPS or parent is None else parent.item_stop


def _judged(tag: str, attrs: str) -> tuple[bool, frozenset[str]]:
    """(left out in any case, the words that speak against the element)."""
    if tag in DROP:
        return True, frozenset()
    words = frozenset(("form",)) if tag == "form" else frozenset()
    if not attrs or not attrs.strip() or tag in KEPT:
        return False, words
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True, words
    return False, words | NAMED.intersection(w.lower() for w in _NAME.findall(f"{found.get('class', '')} {found.get('id', '')}"))


class _Node:
    """A text node: its element, the number of its block, its text and the code points that aren't white space."""

    __slots__ = ("element", "block", "text", "size")

    def __init__(self, element: _Element, block: int, text: str):
        self.element, self.block, self.text = element, block, text
        self.size = len("".join(text.split()))


class _Page:
    """Text nodes outside what is left out, and all elements, parents first."""

    def __init__(self, page: str):
        paths: dict = {}
        self.elements = [_Element("#page", None, 0, paths, False)]
        self.nodes: list[_Node] = []
        at, open_tags = self.elements[0], Counter()
        block, place, end = 0, 0, len(page)

        def shut(upto: _Element) -> None:
            """Close all elements below `upto`."""
            nonlocal at, block
            while at is not upto:
                block += at.block or at.tag in DROP
                open_tags[at.tag] -= 1
                at = at.parent

        while place < end:
            m = _TOKEN.search(page, place)
            text = page[place : m.start() if m else end]
            if text and not at.drop:
                self.nodes.append(_Node(at, block, html.unescape(text)))
            if not m:
                break
            place = m.end()
            if m[1]:
                tag = m[1].lower()
                if tag == "br" and not at.drop:
                    self.nodes.append(_Node(at, block, " "))
                elif open_tags[tag] > 0:
                    found = at
                    while found.tag != tag:
                        found = found.parent
                    shut(found.parent)
            elif m[2]:
                tag, attrs = m[2].lower(), m[3] or ""
                if tag in ENDS_P and open_tags["p"] > 0 and at.p_stop.tag == "p":
                    shut(at.p_stop.parent)
                if tag in CLOSES and any(open_tags[x] > 0 for x in CLOSES[tag]):
                    up, last = at.item_stop, None
                    while up.parent is not None and up.tag not in BOUND.get(tag, ()):
                        if up.tag in CLOSES[tag]:
                            last = up
                        up = up.parent.item_stop
                    if last:
                        shut(last.parent)
                block += tag in BLOCK or tag in DROP
                if tag in VOID or attrs.rstrip().endswith("/") and tag not in BLOCK and tag not in RAW:
                    if tag == "br" and not at.drop:
                        self.nodes.append(_Node(at, block, " "))
                    continue
                if tag in RAW:
                    stop = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, place)
                    place = stop.end() if stop else end
                    continue
                at = _Element(tag, at, len(self.elements), paths, *_judged(tag, attrs))
                self.elements.append(at)
                open_tags[tag] += 1
            elif m[0].startswith("<![CDATA[") and not at.drop:
                self.nodes.append(_Node(at, block, m[0][9:].removesuffix("]]>")))

    def sums(self, nodes: list[_Node], weight: Callable[[_Node], int]) -> list[int]:
        """For each element, the sum over the nodes in it."""
        out = [0] * len(self.elements)
        for x in nodes:
            out[x.element.index] += weight(x)
        return self.gathered(out)

    def gathered(self, out: list[int]) -> list[int]:
        for e in reversed(self.elements):
            if e.parent is not None:
                out[e.parent.index] += out[e.index]
        return out

    def ends(self) -> list[int]:
        """The index of the last element in each element."""
        out = list(range(len(self.elements)))
        for e in reversed(self.elements):
            if e.parent is not None and out[e.index] > out[e.parent.index]:
                out[e.parent.index] = out[e.index]
        return out


def path_scores(nodes: list[_Node]) -> dict[int, float]:
    """The score of each path: its fused ratio, or the mean of the smoothed one over its text, whichever is less."""
    chars, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for x in nodes:
        path = x.element.path
        chars[path] += x.size
        marks[path] += len(_PUNCT.findall(x.text))
        count[path] += x.size > 0
    length = [chars[x.element.path] / max(1, count[x.element.path]) for x in nodes]
    pointed = [(1 + marks[x.element.path]) / max(1, count[x.element.path]) for x in nodes]
    fused, total = [a * b for a, b in zip(_smooth(length), _smooth(pointed), strict=True)], defaultdict(float)
    for x, r in zip(nodes, fused, strict=True):
        total[x.element.path] += r * x.size
    return {p: min(total[p] / n, n / count[p] * (1 + marks[p]) / count[p]) for p, n in chars.items() if n}


_WEIGHTS = [(d, math.exp(-(d * d) / (2 * SIGMA * SIGMA))) for d in range(-REACH, REACH + 1)]


def _smooth(values: list[float]) -> list[float]:
    out = []
    for i in range(len(values)):
        pairs = [(w, values[i + d]) for d, w in _WEIGHTS if 0 <= i + d < len(values)]
        out.append(sum(w * v for w, v in pairs) / sum(w for w, _ in pairs))
    return out


def content_paths(nodes: list[_Node]) -> set[int]:
    scores = path_scores(nodes)
    whole = sum(x.size for x in nodes)
    least = THRESHOLD * sum(scores[x.element.path] * x.size for x in nodes if x.size) / max(1, whole)
    return {p for p, score in scores.items() if score >= least}


def unsuspected(page: _Page) -> list[_Node]:
    """The nodes outside forms and named elements, but for those of such elements that hold the prose.

    A name alone doesn't part comments from prose, as both are prose by their paths. So a suspect stays if it holds KEEPS of the
    page's prose and a landmark (article, main, h1), or KEEPS_BARE of it where no landmark is elsewhere; and one of weak names
    also if half its text is on paths that carry prose outside of suspects.
    """
    nodes, elements = page.nodes, page.elements
    if not any(e.suspect for e in elements):
        return nodes
    content = content_paths(nodes)
    prose = page.sums(nodes, lambda x: x.size if x.element.path in content else 0)
    sizes = page.sums(nodes, lambda x: x.size)
    landmark = [e.tag in LANDMARKS and sizes[e.index] > 0 for e in elements]
    marks = page.gathered([int(x) for x in landmark])
    bare = page.gathered([int(x and not e.suspect) for x, e in zip(landmark, elements, strict=True)])

    def holds(e: _Element) -> bool:
        mass = prose[e.index]
        return (bare[e.index] > 0 or landmark[e.index]) and mass >= KEEPS * prose[0] or marks[e.index] == marks[0] and mass >= KEEPS_BARE * prose[0]

    kept = [not e.suspect or mass > 0 and holds(e) for e, mass in zip(elements, prose, strict=True)]
    plain = content & {x.element.path for x, free in zip(nodes, _free(page, kept), strict=True) if free}
    on = page.sums(nodes, lambda x: x.size if x.element.path in plain else 0)
    kept = [k or e.weak and sizes[e.index] > 0 and 2 * on[e.index] >= sizes[e.index] for k, e in zip(kept, elements, strict=True)]
    return [x for x, free in zip(nodes, _free(page, kept), strict=True) if free]


def _free(page: _Page, kept: list[bool]) -> list[bool]:
    """Whether all elements around each node are kept."""
    free: list[bool] = []
    for e, k in zip(page.elements, kept, strict=True):
        free.append(k and (e.parent is None or free[e.parent.index]))
    return [free[x.element.index] for x in page.nodes]


def _region(page: _Page, nodes: list[_Node], ends: list[int]) -> _Element | None:
    """The least element that holds all content nodes.

    It grows from the innermost element that holds HOLDS of the content; an article element grows only to nodes on the paths that
    its own content has. None without text.
    """
    content = content_paths(nodes)
    held = [x for x in nodes if x.size and x.element.path in content]
    if not held:
        return None
    mass = page.sums(held, lambda x: x.size)
    best = max((e for e in page.elements if mass[e.index] >= HOLDS * mass[0]), key=lambda e: e.depth)
    while best.tag not in REGIONS:
        best = best.parent
    up = best
    while up is not None and up.tag != "article":
        up = up.parent
    chosen = up or best
    if up:
        own = {x.element.path for x in held if chosen.index <= x.element.index <= ends[chosen.index]}
        held = [x for x in held if x.element.path in own]
    low, high = min(x.element.index for x in held), max(x.element.index for x in held)
    while not (chosen.index <= low and high <= ends[chosen.index]):
        chosen = chosen.parent
    return chosen


def _title(nodes: list[_Node], inside: list[bool]) -> int | None:
    """The block of the last h1 before the article, if the article holds none."""
    found, begun = None, False
    for x, within in zip(nodes, inside, strict=True):
        if x.element.h1 and x.size:
            if within:
                return None
            found = found if begun else x.block
        elif within and found is not None:
            begun = True
    return found if begun else None


def extract(page: str | None) -> str:
    """The article's blocks, joined by empty lines; empty for null, empty or textless pages."""
    if not page:
        return ""
    scanned = _Page(page)
    ends, nodes = scanned.ends(), unsuspected(scanned)
    chosen = _region(scanned, nodes, ends)
    if chosen is None:  # everything calls itself something else
        nodes = scanned.nodes
        chosen = _region(scanned, nodes, ends)
        if chosen is None:
            return ""
    inside = [chosen.index <= x.element.index <= ends[chosen.index] for x in nodes]
    title = _title(nodes, inside)
    blocks: dict[int, list[str]] = {}
    for x, within in zip(nodes, inside, strict=True):
        if within or x.block == title:
            blocks.setdefault(x.block, []).append(x.text)
    return "\n\n".join(b for b in (" ".join("".join(parts).split()) for parts in blocks.values()) if b)


_FIELDS = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add text and n_chars (code points) of each page's article; whole pages, no shuffle.

    Null, empty and textless html: empty text. Repeated rows are extracted each; an empty table gives an empty table. Columns of
    pages called text or n_chars are replaced. Of equally deep elements that hold enough prose, the first in the page.
    """

    def make():
        def work(pages_):
            texts = [extract(p).replace("\x00", "�") for p in pages_]
            return [texts, [len(t) for t in texts]]

        return work

    return append_columns(pages, _FIELDS, [html_col], make)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.col("n_chars"))
