"""Main text of web pages by composite text density.

Every DOM node has characters, tags, link characters and link tags; its density is characters per
tag, adjusted for links, and its density sum that of its children. The node of the largest sum is the
core of the text; the smallest density on its path to the body is the threshold above which other
subtrees belong to the text as well. Tags only choose between subtrees with the same text above it.
Elements that name themselves as navigation, advert, form, comment and the like don't take part, unless
they hold the article or half of the page's text.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SLICE = 256

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table caption tbody thead tfoot tr ul".split()
)
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: What a start tag closes first, up to an element of the second set.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th", "caption"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tbody": (frozenset({"tr", "td", "th", "thead", "tbody", "caption"}), frozenset({"table"})),
    "tfoot": (frozenset({"tr", "td", "th", "thead", "tbody"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("html body table td th caption button object".split())

# Elements, roles and name parts that are not the article.
OUT_TAGS = frozenset("nav footer aside form button select option input datalist object embed canvas audio video map dialog menu head".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu sidebar footer header masthead comment comments disqus respond notice alert cookie cookies consent gdpr banner popup modal overlay breadcrumb breadcrumbs share sharing social related recommended newsletter subscribe subscription signup login pagination pager toolbar widget form search copyright skip".split()
)
#: With these, a name part still says what it says alone (site-footer); with any other word it may not (social-studies).
PLAIN_NAMES = frozenset(
    "site page main global top bottom left right inner outer box block area wrap wrapper container content list item items section bar link links icon icons group row col column primary secondary mobile desktop fixed sticky large small big floating post posts article articles entry story stories news blog js is has more all latest module region zone slot unit panel id text title new old btn buttons".split()
)
#: A header is the article's own unless its name says whose it is.
OF_PAGE = frozenset("header site page main global top wrap wrapper container inner outer bar nav navbar menu fixed sticky masthead".split())
KEPT_TAGS = frozenset({"html", "body", "main"})
ARTICLES = frozenset({"article", "main"})
#: These never wrap the article where it is marked elsewhere.
BESIDE_TAGS = frozenset("nav footer aside header menu".split())

TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "out", "chars", "tags", "link_chars", "link_tags", "density", "total", "hidden", "whole", "articles")

    def __init__(self, tag: str, parent: Node | None, out: bool, hidden: bool = False):
        self.tag, self.parent, self.children, self.out, self.hidden = tag, parent, [], out, hidden
        self.whole = self.articles = 0
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _names_out(words: list[str]) -> bool:
    """Whether the parts of one class or id name something beside the article."""
    named = [w for w in words if w in OUT_NAMES]
    if not named or any(w not in OUT_NAMES and w not in PLAIN_NAMES and len(w) > 1 for w in words):
        return False
    return set(named) != {"header"} or OF_PAGE.issuperset(words)


def _is_out(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in OUT_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes or tag in KEPT_TAGS:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name in ("class", "id"):
            if tag not in HEADINGS and any(_names_out(WORD.findall(token)) for token in value.split()):
                return tag != "article" or "comment" in value
        elif name == "role":
            if value in OUT_ROLES:
                return True
        elif name == "aria-hidden" and value == "true":
            return True
    return False


def _is_hidden(tag: str, attributes: str) -> bool:
    if tag == "head":
        return True
    if not attributes or tag in KEPT_TAGS:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", (a or b or c).lower())):
            return True
    return False


def _path(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


class Open:
    """The open elements, with the places of each tag among them: what a tag closes is found without walking up."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {"html": [0]}
        self.blocks: list[int] = []
        self.walls = [0]

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in BLOCKS:
            self.blocks.append(at)
        if node.tag in BLOCKS or node.tag in SCOPE:
            self.walls.append(at)

    def cut(self, at: int) -> None:
        """Close all from this place on; the root stays."""
        while len(self.nodes) > max(at, 1):
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            if tag in BLOCKS or tag in SCOPE:
                self.walls.pop()

    def end(self, tag: str) -> None:
        """An end tag: inline ones don't reach beyond the nearest block, none beyond the body."""
        at = self.last(tag)
        if at > 0 and at >= max(self.last("body"), self.blocks[-1] if tag in INLINE and self.blocks else 0):
            self.cut(at)

    def start(self, tag: str) -> None:
        """What a start tag closes: a block an open paragraph, list items and cells their like, links and headings each other."""
        if tag in BLOCKS and self.nodes[self.walls[-1]].tag == "p":
            self.cut(self.walls[-1])
        if tag in CLOSES:
            which, upto = CLOSES[tag]
            wall = self.last("body", "html", *upto)
            first = [open_[bisect_right(open_, wall)] for open_ in map(self.places.get, which) if open_ and open_[-1] > wall]
            if first:
                self.cut(min(first))
        elif tag in HEADINGS and self.nodes[-1].tag in HEADINGS:
            self.cut(len(self.nodes) - 1)
        elif tag == "a" and self.last("a") > self.walls[-1]:
            self.cut(self.last("a"))


def parse(page: str) -> Node:
    """A tree of Nodes, with strings among the children for text; linear in the page."""
    root = Node("html", None, False)
    top, at, low = Open(root), 0, None
    last = page.rfind(">")
    comment = page.find("<!--", last + 1)
    page = page if comment < 0 else page[:comment]
    n = len(page)
    while at < n:
        m = TOKEN.search(page, at) if at <= last else None
        if m is None:
            top.nodes[-1].children.append(page[at:])
            break
        if m.start() > at:
            top.nodes[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag not in ("html", "body"):  # what follows these still belongs to the body
                top.end(tag)
            continue
        if tag == "html":
            continue
        attributes = m[3] or m[6] or ""
        if tag == "body" and top.last("body") > 0:
            continue
        if tag in ("body", "frameset"):
            top.cut(1)
        top.start(tag)
        if tag in RAW:
            low = page.lower() if low is None else low
            end = low.find("</" + tag, at) if not attributes.endswith("/") else at
            if end < 0:
                end = n if len(low) == n else at
            at = page.find(">", end) + 1 if end < n and end > at or low.startswith("</" + tag, end) else end
            at = at or n
            continue
        hidden = _is_hidden(tag, attributes)
        node = Node(tag, top.nodes[-1], hidden or _is_out(tag, attributes, top.last("article", "main") > 0), hidden)
        node.parent.children.append(node)
        if tag not in VOID and not (attributes.endswith("/") and tag not in BLOCKS and tag not in INLINE):
            top.push(node)
    _spare(root)
    return root


def _spare(root: Node) -> None:
    """Takes back what is out by name only but holds an article or half of the text: it is a wrapper."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if not isinstance(c, str) and not c.hidden)
    for node in reversed(order):
        node.whole += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if node.parent is not None:
            node.parent.whole += node.whole
            node.parent.articles += node.articles + (node.tag in ARTICLES and not node.out and node.whole > 0)
    for node in order:
        if node.out and not node.hidden and node.whole:
            beside = node.tag in BESIDE_TAGS and root.articles
            if node.articles or (node.whole * 2 >= root.whole and not beside):
                node.out = False


def measure(root: Node) -> tuple[Node, list[Node]]:
    """Densities and density sums; the body and all nodes, parents first."""
    nodes: list[tuple[Node, bool]] = []
    body, stack = root, [(root, False)]
    while stack:
        node, link = stack.pop()
        link = link or node.tag == "a"
        nodes.append((node, link))
        if node.tag == "body":
            body = node
        for child in node.children:
            if isinstance(child, str):
                size = len(child.strip())
                node.chars += size
                node.link_chars += size * link
            elif not child.out:
                stack.append((child, link))
    for node, _ in reversed(nodes):
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (node.tag == "a")
    share = body.link_chars / max(body.chars, 1)
    for node, _ in nodes:
        if node.chars:
            c, t, lc, lt = node.chars, node.tags or 1, node.link_chars or 1, node.link_tags or 1
            base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + share * c + math.e)
            node.density = c / t * math.log(max(c / lc * t / lt, 1e-9)) / base
            if node.parent is not None:
                node.parent.total += node.density
    return body, [n for n, _ in nodes]


def select(root: Node) -> Node:
    """The subtree of the article; what doesn't belong to it inside is out."""
    body, nodes = measure(root)
    core = max(nodes, key=lambda n: (n.total, n.tag in ARTICLES))
    if core.total <= 0:
        return body
    path = []
    for node in _path(core):
        path.append(node)
        if node is body:
            break
    on_path = set(path)
    holders = {n.parent for n in path if n.tag == "article"}
    least = min((n.density for n in path if n.tag not in ("html", "body")), default=core.density)

    def others(node: Node) -> list[Node]:
        return [c for c in node.children if isinstance(c, Node) and not c.out and c.chars and c not in on_path]

    def enough(c: Node) -> bool:
        """Whether a node beside the path is text: dense, or another part next to an article (one link lowers a density by far)."""
        return c.density >= least or (c.tag == "article" and c.link_chars * 4 <= c.chars and c.parent in holders)

    top = core
    for node in path[1:]:
        if any(enough(c) for c in others(node)):
            top = node
    # the same subtrees are over the threshold in all nodes from here to the next one: a tag decides
    above = list(_path(top))
    wider = [n for n in above if n.tag == "article"][-1:] or [n for n in above if n.tag == "main"][:1]
    top = wider[0] if wider else top
    for node in path:
        if node is core:
            continue
        for c in others(node):
            if not enough(c) and c.tag not in HEADINGS and (c.link_chars * 2 > c.chars or (node is body and c.tag != "p")):
                c.out = True
    # around marked articles that hold most of the text, a core keeps what is as dense as itself
    marked = {c for c in others(core) if c.tag in ARTICLES or c.articles}
    if core.tag not in ARTICLES and sum(c.chars for c in marked) * 2 >= core.chars:
        for c in others(core):
            if c not in marked and c.density < core.density and c.tag not in HEADINGS:
                c.out = True
    for c in others(core):
        if c.tag in ("ul", "ol", "div", "section", "table") and c.link_chars * 10 > c.chars * 8:
            c.out = True
    return top


def main_text(page: str) -> str:
    """Blocks of the article in page order, joined by two newlines."""
    if not page:
        return ""
    chosen = select(parse(page))
    blocks: list[str] = []
    open_block: list[str] = []

    def close() -> None:
        if open_block:
            text = " ".join(html.unescape("".join(open_block)).split())
            if text:
                blocks.append(text)
            open_block.clear()

    stack: list = [chosen]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            open_block.append(x)
        elif not x.out or x is chosen:
            if x.tag in BLOCKS:
                close()
                stack.append(None)
            elif x.tag in ("br", "td", "th", "wbr", "img"):
                open_block.append("" if x.tag == "wbr" else " ")
            stack.extend(reversed(x.children))
    close()
    return "\n\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Null or empty html, and pages without text, give an empty string. Rows are judged each by itself,
    so repeated rows give repeated results; null ids and urls stay null. Some megabytes of pages are
    taken at once, a longer page alone. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in C.slices(batches, "html", SLICE):
            yield pa.RecordBatch.from_pydict({"page_id": piece["page_id"], "url": piece["url"], "text": pa.array([main_text(x or "") for x in piece["html"].to_pylist()], pa.string())})

    found = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return found.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages"))
