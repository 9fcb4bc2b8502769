"""HTML extraction by composite text density.

A page becomes a tree. Each node has its characters, tags, link characters and link tags; its composite density is the
characters per tag, weighed down by the share of links. The node with the largest sum of its children's densities holds the
article; the smallest density on its way up to the body is the threshold. From the body down, each node as dense as the
threshold marks the node of the largest sum below it, and nodes less dense are left out with all below them. So parts of
an article that lies in several places are found, and menus and link lists aren't.

Elements that say that they are navigation, footer, sidebar, form, script or style are no part of the tree. A class, an id
or a role may say the same by a whole name (sidebar, cookie-banner, site-footer). That is weak evidence: where hardly any
text is left without such elements, the largest of them is taken for the page's wrapper, and what it holds is looked at.

What is kept: all in a marked node; all in the article or main element around the node of the largest sum; headings and
paragraphs that stand beside that node on its way up (in the body itself: headings before it). Within these a list or box
of links less dense than the threshold goes, unless it lies in that article or main element.

A null or empty page, or one of markup only, has an empty text. Of equal sums the first node in the page counts. Pages are
worked on one by one, without recursion and in time that grows with their length, however deep or unclosed their elements.
Repeated rows give equal texts. Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from helixframe.llm.common import slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAMED = re.compile(r"[a-z]+|[A-Z][a-z]*")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
#: Elements that are never article.
APART = frozenset("head nav footer aside script style noscript iframe template svg canvas button select input textarea dialog object embed audio video map menu title noembed noframes".split())
#: Names in a class, an id or a role that say the same, alone or joined with each other and with the words of place.
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist disqus cookie cookies consent gdpr footer header masthead menu menubar menus nav navbar navigation navi notice notices notification popup modal overlay promo promoted promotion related recommended recommendations share sharing shares sidebar sidebars social sponsor sponsored sponsors subscribe subscription newsletter signup login search toolbar widget widgets pagination pager skip contentinfo complementary reply replies respond".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
PLACE_WORDS = frozenset("bar block bottom box button buttons col column container form global group head inner item items left link links list main outer page panel placeholder posts primary right row secondary section site slot space thread top unit wrap wrapper area".split())
#: Share of the page's text without links that must be left outside elements set apart by name.
LEFT = 0.1
#: What an opening tag ends, up to the nearest element of the second set.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_KEEPS_P = BLOCKS - {"option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "body", "html", "legend", "summary"}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Node:
    __slots__ = ("tag", "apart", "named", "parent", "article", "items", "chars", "tags", "link_chars", "link_tags", "density", "total", "most", "marked")

    def __init__(self, tag: str, parent: Node | None, apart: bool = False, named: str | None = None):
        self.tag, self.parent, self.apart, self.named = tag, parent, apart, named
        #: The article or main element around the node, or the node itself.
        self.article: Node | None = self if tag in ("article", "main") else parent.article if parent is not None else None
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.most: Node = self
        self.marked = False

    def elements(self) -> Iterator[Node]:
        """Child elements that aren't apart."""
        return (y for y in self.items if isinstance(y, Node) and not y.apart)


def _said(tag: str, attrs: str) -> str | None:
    """Whether a form, or an element's class, id or role, says that it is no article: None, "part" or "comments"."""
    if tag == "form":
        return "part"
    if not attrs or tag in ("html", "body", "article", "main") or "=" not in attrs:
        return None
    for name, a, b, c in _ATTR.findall(attrs):
        if name.lower() in ("class", "id", "role"):
            for token in (a or b or c).split():
                words = {x.lower() for x in _NAMED.findall(token)}
                own = words & APART_WORDS
                if own and words <= APART_WORDS | PLACE_WORDS:
                    return "comments" if own & COMMENT_WORDS else "part"
    return None


def parse(page: str) -> Node:
    """The tree of a page; elements that are never article are kept as empty nodes apart."""
    root = Node("html", None)
    open_: list[Node] = [root]
    #: Places of the open elements of each tag, and of the open blocks: no end tag walks what is open.
    places: dict[str, list[int]] = {"html": [0]}
    block_places: list[int] = [0]
    last = lambda tags: max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(k: int) -> None:
        while len(open_) > k:
            x = open_.pop()
            places[x.tag].pop()
            if x.tag in BLOCKS:
                block_places.pop()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            open_[-1].items.append(page[at:])
            break
        if m.start() > at:
            open_[-1].items.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                open_[-1].items.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag, ends, attrs = tag.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if ends:
            if tag == "br":
                open_[-1].items.append(" ")
                continue
            k = places[tag][-1] if places.get(tag) else 0
            # A misplaced end of an inline element doesn't end the block around it.
            if k and (tag in BLOCKS or k > block_places[-1]):
                close(k)
            continue
        if tag in ("html", "body") and places.get(tag):
            continue
        if tag in _ENDS:
            what, until = _ENDS[tag]
            while (k := last(what)) > last(until):
                close(k)
        elif tag in _KEEPS_P:
            above = open_[block_places[-1]].tag
            if above == "p" or tag in _HEADINGS and above in _HEADINGS:
                close(block_places[-1])
        if tag in ("body", "div", "article", "nav", "main") and open_[-1].tag == "head":
            close(len(open_) - 1)
        above = open_[-1]
        # An article's own header holds its title.
        node = Node(tag, above, tag in APART or tag == "header" and above.article is None, _said(tag, attrs))
        above.items.append(node)
        if tag in RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not attrs.rstrip().endswith("/"):
            places.setdefault(tag, []).append(len(open_))
            if tag in BLOCKS:
                block_places.append(len(open_))
            open_.append(node)
    return root


def _length(s: str) -> int:
    return len("".join((html.unescape(s) if "&" in s else s).split()))


def _post_order(root: Node) -> list[Node]:
    """Nodes that aren't apart, children before parents, the later of two siblings first."""
    out, wait = [], [root]
    while wait:
        x = wait.pop()
        out.append(x)
        wait += x.elements()
    return out[::-1]


def _count(nodes: list[Node]) -> None:
    """Characters, tags, link characters and link tags of nodes, children first."""
    for x in nodes:
        x.chars = x.tags = x.link_chars = x.link_tags = 0
        for y in x.items:
            if isinstance(y, str):
                x.chars += _length(y)
            elif not y.apart:
                x.chars += y.chars
                x.tags += y.tags + 1
                x.link_chars += y.chars if y.tag == "a" else y.link_chars
                x.link_tags += y.link_tags + (y.tag == "a")


def set_apart(root: Node) -> list[Node]:
    """Take the elements that say that they are no article for what they say, as long as text is left without them; returns
    the nodes that stay, children first, with their counts."""
    nodes = _post_order(root)
    _count(nodes)
    if any(x.named for x in nodes):
        plain = lambda x: x.chars - x.link_chars
        # Text without links outside named elements, for each node; the named ones right below each of them.
        outside: dict[int, int] = {}
        below: dict[int, list[Node]] = {}
        for x in nodes:
            outside[id(x)], below[id(x)] = plain(x), []
            for y in x.elements():
                outside[id(x)] -= plain(y) - (0 if y.named else outside[id(y)])
                # The smaller list goes into the larger.
                found = [y] if y.named else below[id(y)]
                if len(found) > len(below[id(x)]):
                    found, below[id(x)] = below[id(x)], found
                below[id(x)] += found
        left, enough = outside[id(root)], LEFT * plain(root)
        rank = {id(x): -i for i, x in enumerate(nodes)}
        key = lambda x: (x.named == "comments", -plain(x), rank[id(x)])
        heap = [(*key(x), x) for x in below[id(root)]]
        heapq.heapify(heap)
        while heap and left < enough and (heap[0][0] is False or left == 0):
            x = heapq.heappop(heap)[-1]
            x.named = None
            left += outside[id(x)]
            for y in below[id(x)]:
                heapq.heappush(heap, (*key(y), y))
        for x in nodes:
            x.apart = x.named is not None
        nodes = _post_order(root)
        _count(nodes)
    return nodes


def measure(root: Node) -> list[Node]:
    """Fill in counts, densities, sums and the node of the largest sum below each; returns the nodes, children first."""
    nodes = set_apart(root)
    all_chars, all_links = max(1, root.chars), root.link_chars
    for x in nodes:
        if x.chars:
            c, t, lc, lt = x.chars, max(1, x.tags), x.link_chars, x.link_tags
            base = math.log(c / max(1, c - lc) * lc + all_links / all_chars * c + math.e)
            x.density = c / t * max(0.0, math.log(c / max(1, lc) * (t / max(1, lt)))) / max(math.log(base + math.e - 1), 1e-9)
    for x in nodes:
        x.total, x.most = sum(y.density for y in x.elements()), x
        for y in x.elements():
            if y.most.total > x.most.total:
                x.most = y.most
    return nodes


def article(root: Node) -> tuple[Node, list[Node], float]:
    """The node of the largest sum, its way up to the body, and the threshold; the nodes that hold the article are marked."""
    nodes = measure(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    best = body.most
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    wait = [body]
    while wait:
        x = wait.pop()
        if x.density >= threshold and x.chars:
            x.most.marked = True
            if x.most is not x:
                wait += x.elements()
    return best, path, threshold


def _links(x: Node, threshold: float) -> bool:
    """A list or box that is links for the most part, less dense than the threshold."""
    return x.density < threshold and x.link_tags >= 2 and x.link_chars > 0.6 * x.chars and x.tag in ("ul", "ol", "div", "section", "table", "dl", "p")


def kept(root: Node) -> Iterator[tuple[Node, bool]]:
    """The elements in page order, with whether their own text is kept; those that are left out with all below are missing."""
    best, path, threshold = article(root)
    body, way = path[-1], {id(x) for x in path}
    home = best.article
    before = True
    wait: list[tuple[Node, bool] | None] = [(body, False)]
    while wait:
        x, inside = wait.pop()
        if x is best:
            before = False
        beside = x.parent is not None and id(x.parent) in way and x is not best
        inside = inside or x.marked or x is home or beside and (x.tag in _HEADINGS and (before or x.parent is not body) or x.tag == "p" and x.parent is not body)
        if inside and (home is None or x.article is not home) and x is not best and id(x) not in way and _links(x, threshold):
            continue
        yield x, inside
        wait += [(y, inside) for y in x.elements()][::-1]


def blocks(root: Node) -> list[str]:
    """Texts of the kept blocks in page order: references decoded, white space one space, none empty."""
    seen = list(kept(root))
    keep = {id(x): own for x, own in seen}
    out: list[str] = []
    part: list[str] = []

    def close() -> None:
        if part:
            text = " ".join(html.unescape("".join(part)).split())
            part.clear()
            if text:
                out.append(text)

    wait: list = [(seen[0][0], False)]
    while wait:
        x, own = wait.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            if own:
                part.append(x)
        elif x.tag == "br":
            part.append(" ")
        elif not x.apart:
            if x.tag in BLOCKS:
                close()
                wait.append((None, False))
            if id(x) in keep:
                wait += [(y, keep[id(x)]) for y in x.items[::-1]]
    close()
    return out


def extract(page: str | None) -> str:
    """The main text of a page."""
    return "\n\n".join(blocks(parse(page))) if page else ""


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars for every page."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                text = [extract(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["id", "url", "text", "n_chars"])

    slim = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    return slim.mapInArrow(rows, f"id {slim.schema['id'].dataType.simpleString()}, url string, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})


def query(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    return main_text(pages)
