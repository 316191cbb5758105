"""Main text of web pages by a minimum cut.

A page becomes blocks of text. A small classifier gives each block a cost for either label, which
are its capacities to the two terminals; blocks next to each other, and blocks and the elements that
hold them, are tied by smoothness edges. The maximum flow separates content from boilerplate.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of HTML by their part in a page.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "svg", "math", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl",
         "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
         "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section",
         "select", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "button", "label"}
NEVER = {"nav", "footer", "aside", "form", "header", "head", "button", "select", "dialog", "menu", "fieldset", "label",
         "search"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that an opening tag of the same group ends when they are still open.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}

#: Words of class, id and role that mark what isn't the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|breadcrumbs?|comments?|complementary|consent|contentinfo|"
    r"cookies?|disqus|footer|form|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|notification|"
    r"pagination|popup|promos?|promoted|reactions?|related|replies|reply|respond|search|shar(?:e|ing)|sidebar|signup|skip|"
    r"social|sponsor(?:ed)?|subscribe|toolbar|topbar|warning|widgets?|alert)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)|[^<]+|<",
                    re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\s(?:hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)

#: What a block can't be for any sum of the other capacities.
HARD = 1e6

#: Smoothness: neighbours in the page, alike or not; a block and its element; an element and its parent; the
#: factor for the last two where only one of both is marked.
NEXT, NEXT_APART, INSIDE, NESTED, UNLIKE = 0.8, 0.1, 0.5, 0.4, 0.1


@dataclass
class Element:
    tag: str
    parent: int
    never: bool = False
    marked: bool = False
    article: bool = False


@dataclass
class Block:
    text: str
    element: int
    linked: int


@dataclass
class Page:
    elements: list[Element] = field(default_factory=lambda: [Element("", -1)])
    blocks: list[Block] = field(default_factory=list)


def parse(source: str) -> Page:
    """The text blocks of a page, each in the block element that holds it. Any input gives some page."""
    page = Page()
    elements, stack = page.elements, [0]
    parts: list[str] = []
    linked, in_link, raw = 0, 0, ""

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                page.blocks.append(Block(text, stack[-1], linked))
            parts.clear()
        linked = 0

    at, size = 0, len(source)
    match_at = _TOKEN.match
    while at < size:
        m = match_at(source, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                parts.append(text)
                if in_link:
                    linked += len(text)
            elif text.startswith("<![CDATA["):
                parts.append(html.escape(text[9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.I).search(source, at)
                at = closing.end() if closing else size
            if tag in ("iframe", "svg", "math", "canvas", "textarea"):
                parts.append(" ")
            continue
        if tag == "a":
            in_link = 0 if m[1] else 1
            continue
        if tag in ("br", "td", "th", "wbr"):
            parts.append("" if tag == "wbr" else " ")
            continue
        if tag not in BLOCK:
            continue
        end_block()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if elements[stack[depth]].tag == tag:
                    del stack[depth:]
                    in_link = 0
                    break
            continue
        for open_tag in CLOSES.get(tag, ()) or ({"p"} if tag not in VOID else ()):
            if elements[stack[-1]].tag == open_tag:
                stack.pop()
                break
        if tag in VOID:
            continue
        above = elements[stack[-1]]
        attributes = m[3]
        marked, hidden = False, False
        if attributes:
            # What holds the whole page isn't boilerplate by its name.
            marked = tag not in ("html", "body", "article", "main") and any(
                MARKS.search(a or b or c) for a, b, c in _ATTRIBUTE.findall(attributes))
            hidden = _HIDDEN.search(attributes) is not None
        elements.append(Element(tag, stack[-1], above.never or tag in NEVER or hidden, above.marked or marked,
                                above.article or tag in ("article", "main")))
        stack.append(len(elements) - 1)
    end_block()
    return page


def evidence(block: Block, element: Element) -> float:
    """Log-odds of content, linear in a block's figures."""
    if element.never:
        return -HARD
    words = block.text.count(" ") + 1
    score = -0.3 + 0.08 * min(words, 40) - 4.0 * min(1.0, block.linked / len(block.text))
    if block.text[-1] in ".!?…:;\"'»”)。":
        score += 0.6
    if element.tag == "p":
        score += 0.5
    elif element.tag in HEADINGS:
        score += 0.2
    if element.article:
        score += 4.0
    if element.marked:
        score -= 12.0
    if words < 25 and (block.text[0] == "©" or "all rights reserved" in block.text.lower()) and not element.article:
        score -= 4.0
    return score


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node stays with the source. Dinic's method; only unlike nodes send flow.

    ``odds`` above 0 is a node's capacity from the source, below 0 to the sink; edges go both ways.
    """
    size = len(odds)
    around: list[list[int]] = [[] for _ in range(size)]
    ends: list[int] = []
    room: list[float] = []
    for a, b, weight in edges:
        around[a].append(len(ends))
        around[b].append(len(ends) + 1)
        ends += (b, a)
        room += (weight, weight)
    supply = [max(0.0, x) for x in odds]
    demand = [max(0.0, -x) for x in odds]
    tiny = 1e-9
    while True:
        level = [-1] * size
        queue = deque(i for i in range(size) if supply[i] > tiny)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            node = queue.popleft()
            reached = reached or demand[node] > tiny
            for arc in around[node]:
                other = ends[arc]
                if level[other] < 0 and room[arc] > tiny:
                    level[other] = level[node] + 1
                    queue.append(other)
        if not reached:
            return [x >= 0 for x in level]
        used = [0] * size
        for start in range(size):
            while level[start] == 0 and supply[start] > tiny:
                path: list[int] = []
                node = start
                while demand[node] <= tiny:
                    moved = False
                    while used[node] < len(around[node]):
                        arc = around[node][used[node]]
                        if room[arc] > tiny and level[ends[arc]] == level[node] + 1:
                            path.append(arc)
                            node = ends[arc]
                            moved = True
                            break
                        used[node] += 1
                    if not moved:
                        if not path:
                            break
                        node = ends[path.pop() ^ 1]
                        used[node] += 1
                if demand[node] <= tiny:
                    break
                flow = min([supply[start], demand[node], *[room[arc] for arc in path]])
                supply[start] -= flow
                demand[node] -= flow
                for arc in path:
                    room[arc] -= flow
                    room[arc ^ 1] += flow


def main_text(source: str | None) -> str:
    """The content blocks of a page in order, one per line; empty if there are none."""
    page = parse(source or "")
    blocks, elements = page.blocks, page.elements
    if not blocks:
        return ""
    odds = [evidence(b, elements[b.element]) for b in blocks]
    if min(odds) > 0:
        return "\n".join([b.text for b in blocks])
    edges: list[tuple[int, int, float]] = []
    for i in range(len(blocks) - 1):
        a, b = elements[blocks[i].element], elements[blocks[i + 1].element]
        alike = (a.parent, a.tag, a.marked, a.never) == (b.parent, b.tag, b.marked, b.never)
        edges.append((i, i + 1, NEXT if alike else NEXT_APART))
    # Elements that hold blocks, and those above them, as nodes without a cost of their own.
    node: dict[int, int] = {}
    for i, block in enumerate(blocks):
        inner, element, below, weight = elements[block.element], elements[block.element].parent, i, INSIDE
        while element >= 0:
            new = element not in node
            at = node.setdefault(element, len(odds))
            if new:
                odds.append(-HARD if elements[element].never else 0.0)
            outer = elements[element]
            like = (inner.marked, inner.never) == (outer.marked, outer.never)
            edges.append((below, at, weight if like else weight * UNLIKE))
            if not new:
                break
            inner, element, below, weight = outer, outer.parent, at, NESTED
    kept = minimum_cut(odds, edges)
    return "\n".join([b.text for b, keep in zip(blocks, kept, strict=False) if keep])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages``; ``n_chars`` counts code points.

    Null and empty pages have no text. Character references are decoded, white space inside a block is one
    space, blocks are joined by a line feed. Repeated rows give repeated rows; other columns are ignored.
    """
    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                          F.col(html_col).cast("string").alias("html"))
    kinds = [chosen.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return chosen.mapInArrow(_run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
