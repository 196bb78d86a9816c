"""Main text of web pages by composite text density.

For every node of the page: characters per tag, lowered where they stand in links. A node's density sum is the
sum of its children's densities; the node with the largest sum holds the article. The lowest density on the
way from it up to the body is the threshold for subtrees beside that way. <article> and <main> only weigh in, and
names such as "sidebar" are evidence that a node's text and density can outweigh.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from carestrata.llm.merge_replay import batches_of

_mark = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_named = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_part = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in
       ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "noembed",
        "noframes", "xmp")}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp "
             "small span strike strong sub sup time tt u var wbr br img picture".split())
SKIPPED = set("head nav footer aside form button select option menu dialog audio video canvas map input fieldset "
              "header".split())
#: Words in a class, id or role that mark what is not the article.
UNWANTED = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
               "complementary consent contentinfo cookie cookies disqus footer gdpr header masthead menu modal nav navbar "
               "navigation newsletter notice popup promo promoted promotion related respond search share sharing sidebar "
               "signup social sponsor sponsored subscribe toolbar".split())
ARTICLE = {"article", "main"}
#: How much the sum of an article counts, and of a node under an unwanted name.
MARKED, NAMED = 2.0, 0.5
#: Characters from which the text under an unwanted name counts in full.
ENOUGH = 500
#: Part of the threshold that text beside the way needs inside an <article>; headings in <article> and <main> need none.
EASED = 1 / 32
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: A start tag on the left ends open elements on the right.
_blocks = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
              "header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
        "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"}, "body": {"head"}}
#: An element on the left keeps open ones outside it from being ended.
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}, "body": set()}


class Node:
    __slots__ = ("tag", "parent", "parts", "unwanted", "named", "marked", "chars", "tags", "link_chars", "link_tags",
                 "density", "total")

    def __init__(self, tag: str, parent: Node | None, unwanted: bool = False, named: bool = False):
        self.tag, self.parent, self.unwanted, self.named = tag, parent, unwanted, named
        self.marked = False  # holds an article or main element with text
        self.parts: list = []  # texts and nodes in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _unwanted(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether the node is no text of the page at all, and whether its name speaks against it."""
    if tag in SKIPPED:
        return True, False
    named = False
    if attributes:
        for found in _named.finditer(attributes):
            name = found[1].lower()
            value = found[2] or found[3] or found[4] or ""
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True, False
            if name == "style":
                if re.search(r"display\s*:\s*none", value, re.I):
                    return True, False
            elif tag not in ("body", "html", "article", "main") and not UNWANTED.isdisjoint(
                    x.lower() for x in _part.findall(value)):
                named = True
    return False, named


def parse(html: str) -> Node:
    """The page's tree; unclosed and misplaced tags are mended as browsers do in the plain cases."""
    root = at = Node("html", None)
    position, end = 0, len(html)
    while position < end:
        found = _mark.search(html, position)
        start = found.start() if found else end
        if start > position:
            at.parts.append(html[position:start])
        if not found:
            break
        position = found.end()
        tag = found[2] or found[5]
        if not tag:
            if found[0].startswith("<![CDATA["):
                at.parts.append(found[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if found[1] or found[4]:
            node: Node | None = at
            while node is not None and node.tag != tag:
                # an inline end tag does not close blocks
                node = None if tag in INLINE and node.tag not in INLINE else node.parent
            if node is not None and node.parent is not None:
                at = node.parent
            elif tag in ("br", "p"):
                at.parts.append(Node(tag, at))
            continue
        if tag in RAW:
            close = RAW[tag].search(html, position)
            position = close.end() if close else end
            continue
        if tag in ("html", "body") and at.parent is None and tag == "html":
            continue
        ends, walls = ENDS.get(tag), WALLS.get(tag, ())
        if tag in _blocks:
            ends, walls = {"p"}, {"div", "td", "th", "li", "article", "section", "table", "body", "button"}
        if ends:
            node, outermost = at, None
            while node is not None and node.tag not in walls:
                if node.tag in ends:
                    outermost = node
                    if tag in _blocks or tag == "li":
                        break
                node = node.parent
            if outermost is not None and outermost.parent is not None:
                at = outermost.parent
        child = Node(tag, at, *_unwanted(tag, found[3] or found[6] or ""))
        at.parts.append(child)
        if tag not in VOID:
            at = child
    return root


def _subtree(node: Node) -> list[Node]:
    """Wanted nodes, children before parents."""
    order, stack = [], [node]
    while stack:
        at = stack.pop()
        order.append(at)
        stack += [p for p in at.parts if isinstance(p, Node) and not p.unwanted]
    order.reverse()
    return order


def _measure(root: Node) -> list[Node]:
    """Counts of every wanted node, children before parents."""
    order = _subtree(root)
    for node in order:
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len("".join(part.split()))
            elif not part.unwanted:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.chars if part.tag == "a" else part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
                node.marked |= part.marked
        node.marked |= node.tag in ARTICLE and node.chars > 0
    return order


def _densities(order: list[Node], body: Node) -> None:
    share = body.link_chars / max(body.chars, 1)
    for node in order:
        chars, tags = node.chars, max(node.tags, 1)
        if not chars:
            continue
        links, link_tags = max(node.link_chars, 1), max(node.link_tags, 1)
        free = max(chars - node.link_chars, 1)
        base = log(chars / free * node.link_chars + share * chars + e)
        node.density = chars / tags * max(log(chars / links * tags / link_tags), 0.0) / max(log(base), 1.0)
    for node in order:
        node.total = sum(p.density for p in node.parts if isinstance(p, Node) and not p.unwanted
                         and (p.marked or not p.named)) or node.density


def _blocks_of(node: Node, keep) -> list[str]:
    """Texts of the blocks of a subtree in page order."""
    out, line = [], []

    def close() -> None:
        words = unescape("".join(line)).split()
        if words:
            out.append(" ".join(words))
        line.clear()

    stack: list = [node]
    while stack:
        part = stack.pop()
        if part is None:
            close()
        elif isinstance(part, str):
            line.append(part)
        elif part.unwanted or not keep(part):
            if part.tag not in INLINE:
                close()
        elif part.tag == "br":
            line.append(" ")
        else:
            inline = part.tag in INLINE
            if not inline:
                close()
                stack.append(None)
            stack += reversed(part.parts)
    close()
    return out


def main_text(html: str | None) -> str:
    """The article's blocks joined by line feeds; empty if the page has none."""
    root = parse(html or "")
    order = _measure(root)
    body = next((n for n in reversed(order) if n.tag == "body" and n.chars), root)
    if not body.chars:
        return ""
    inner = _subtree(body)
    _densities(inner, body)
    doubted: dict[int, float] = {}  # nodes at or below an unwanted name, up to an article in it
    for node in reversed(inner):
        if not node.marked and (node.named or id(node.parent) in doubted):
            doubted[id(node)] = doubted.get(id(node.parent)) or min(node.chars / ENOUGH, 1.0)
    best = max(inner, key=lambda n: n.total * (MARKED if n.tag in ARTICLE else NAMED * doubted[id(n)] if id(n) in doubted else 1.0))
    way = [best]
    while way[-1] is not body:
        way.append(way[-1].parent)
    threshold = min(n.density for n in way)
    path, marks, eased = {id(n) for n in way}, set(), {}
    for node in reversed(way):
        marks |= ARTICLE & {node.tag}
        eased[id(node)] = "article" in marks, bool(marks)

    def keep(part: Node) -> bool:
        """Beside the way to the densest subtree only what reaches the threshold counts, and so do large named nodes."""
        if id(part) in path:
            return True
        if part.named and not part.marked and (
                part.chars * doubted[id(part)] < body.chars - part.chars or part.density < threshold):
            return False
        if part.parent is best or id(part.parent) not in path or part.tag in INLINE:
            return True
        article, marked = eased[id(part.parent)]
        return marked and part.tag in HEADINGS or part.density >= threshold * (EASED if article else 1.0)

    return "\n".join(_blocks_of(body, keep))


def _rows(batches):
    for batch in batches:
        pages = [h or "" for h in batch.column(2).to_pylist()]
        for first, some in batches_of(pages):
            texts = [main_text(page) for page in some]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(some)).cast(pa.int64()), batch.column(1).slice(first, len(some)),
                 pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one
    line feed in page order. Null or empty pages, and pages without an article, have an empty text. Repeated
    rows stay; other columns are ignored; an empty table gives an empty result. Nothing is shuffled.
    """
    return pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"), pages[html].alias("html")).mapInArrow(
        _rows, "page_id long, url string, text string, n_chars long")
