"""Main text of web pages by a minimum cut.

A page becomes a row of text blocks.  A logistic classifier on text, link and
element features gives each block the cost of either label: the capacities of its
edges to the two terminals.  What an element says against its text counts less, the
more of the page's text it holds, so no name and no wrapping form empties a page.  Blocks that follow one another, and blocks of one
parent element, are tied by smoothness edges.  The minimum cut, found by maximum
flow, parts content from boilerplate at the least total cost.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from reconweave.llm.words import texts

_START = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
#: What follows a tag's name: quotes that close before the next "<"; any up to the
#: next ">"; quotes that hold "<" (the group is empty where the tag does not end).
_CLOSE = re.compile(r"(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+>")
_LOOSE = re.compile(r"[^<>]*+>")
_QUOTED = re.compile(r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+(>?)")
#: Elements whose text is never shown; the first two reach to the page's end if they have none.
RAW = {"script", "style"}
UNSHOWN = RAW | {"noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "head"}
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in UNSHOWN}
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)

#: Elements that never hold an end tag, and those that part blocks.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
#: An open element of the key ends where one of the values begins.
ENDED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SCOPE = {"table", "ul", "ol", "dl", "select", "article", "section", "div", "body", "main"}

#: Log-odds of content for what surrounds a block.
#: An element's word against its text counts in full up to the first share of the page's text, and not at all from the second.
WEAK, STRONG = (0.4, 0.7), (0.85, 0.97)
WEAK_TAGS = {"form", "fieldset", "search", "header", "label", "button"}
BOILER_TAGS = {"nav": -6.0, "footer": -6.0, "aside": -5.0, "form": -5.0, "menu": -6.0, "dialog": -5.0, "button": -5.0, "option": -6.0, "label": -2.0, "header": -3.0, "search": -5.0, "fieldset": -4.0, "title": -6.0}
CONTENT_TAGS = {"article": 3.5, "main": 2.5}
_BOILER_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv(?:ert\w*)?|banner|breadcrumbs?|comments?|replies|reply|disqus|cookies?|consent|gdpr|copyright|dialog|disclaimer|footer|foot|header|masthead|hidden|legal|login|signup|menu\w*|modal|nav\w*|newsletter|notice|notification|overlay|pag(?:er|ination)|popup|promo\w*|recommend\w*|related|share|sharing|sidebar|side(?!-by-side)(?<!side-by-side)|skip|social|sponsor\w*|subscribe|subscription|tags|toolbar|tracking|widget|contentinfo|complementary|navigation|search|alert)(?:$|[\s_-])",
    re.I,
)
_CONTENT_NAME = re.compile(r"(?:^|[\s_-])(?:article\w*|articlebody|post|entry|story|content|main|body|text|prose)(?:$|[\s_-])", re.I)
#: Utility names say how boxes are drawn: overflow-hidden, md:block; hidden beside one of the latter is shown on some screens.
_UTILITY = re.compile(r"overflow-|[a-z0-9]+:")
_SHOWN = re.compile(r"[a-z0-9]+:(?:block|flex|grid|inline\S*|table\S*|contents)$")
#: Names that say how a page is laid out, and those of an element that holds the whole page or article count only from here.
_STATE = re.compile(r"(?:has|have|no|with|without|is|not)[_-]", re.I)
_INSIDE = re.compile(r"comment|repl|disqus|\bads?\b|adv|sponsor|promo|cookie|consent|gdpr|newsletter|login|signup|hidden|modal|popup|overlay|related|recommend", re.I)
WHOLE = {"html", "body", "main", "article"}
BOILER_NAME, CONTENT_NAME = -5.0, 1.5
BIAS, PER_LOG_CHAR, LINKS, HEADING = -2.0, 0.55, -5.0, 0.8
#: For the share of the page's text outside links that stands beside a block, below one element.
TOGETHER = 2.0
#: Ties of blocks that follow one another, by the elements between them, and of one parent's blocks.
NEXT_TO, SAME_PARENT = 0.9, 0.6
SCALE = 1000


@dataclass
class Element:
    tag: str
    parent: "Element | None"
    #: What speaks for its text, against it weakly, and against it strongly.
    own: tuple[float, float, float] = (0.0, 0.0, 0.0)
    depth: int = 0
    chars: int = 0
    odds: float = 0.0
    #: This element or the nearest above it, below an element of SCOPE, that others may end.
    ends: "Element | None" = None


@dataclass
class Block:
    parent: Element
    parts: list[str] = field(default_factory=list)
    chars: int = 0
    linked: int = 0
    heading: bool = False
    text: str = ""
    together: float = 0.0


def _name_odds(tag: str, value: str) -> tuple[float, float, float]:
    """What the names of an attribute say; a name of both kinds says nothing, names of both kinds weigh half of each."""
    weak = strong = content = False
    names = value.split()
    shown = any(_SHOWN.match(n) for n in names)
    for name in names:
        if _STATE.match(name) or _UTILITY.match(name) or name.lower() == "hidden" and shown:
            continue
        good, bad = bool(_CONTENT_NAME.search(name)), bool(_BOILER_NAME.search(name))
        inside = bool(_INSIDE.search(name))
        if bad and (inside or not good):
            strong = strong or inside
            weak = weak or not inside and tag not in WHOLE
        elif good and not bad:
            content = True
    half = 1 / (1 + ((weak or strong) and content))
    return CONTENT_NAME * content * half, BOILER_NAME * (weak and not strong) * half, BOILER_NAME * strong * half


def _odds(tag: str, raw: str) -> tuple[float, float, float]:
    """What an element says for its text, against it weakly, and against it strongly."""
    against = BOILER_TAGS.get(tag, 0.0)
    good, weak, strong = CONTENT_TAGS.get(tag, 0.0), against * (tag in WEAK_TAGS), against * (tag not in WEAK_TAGS)
    if raw and "=" in raw or "hidden" in raw:
        for name, value in _ATTRIBUTE.findall(raw):
            name, value = name.lower(), value.strip("\"'")
            if name in ("hidden", "aria-hidden") and value.lower() != "false" or name == "style" and "display:none" in value.replace(" ", ""):
                strong -= 6.0
            elif name in ("class", "id", "role", "itemprop"):
                x, y, z = _name_odds(tag, value)
                good, weak, strong = good + x, weak + y, strong + z
    return good, weak, strong


def _fading(share: float, bounds: tuple[float, float]) -> float:
    """1 up to the first bound, 0 from the second, a line between."""
    return min(1.0, max(0.0, (bounds[1] - share) / (bounds[1] - bounds[0])))


def weigh(elements: list[Element]) -> None:
    """Sets every element's odds from its own and those above it, by the share of the text below; elements follow their parents."""
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.chars += e.chars
    every = max(1, elements[0].chars)
    for e in elements:
        share = e.chars / every
        good, weak, strong = e.own
        e.odds = (e.parent.odds if e.parent else 0.0) + good + weak * _fading(share, WEAK) + strong * _fading(share, STRONG)


def tokens(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Start, end, whether it closes, name and attributes of each tag, in page order.

    Comments, declarations and elements whose text is not shown have no name.  A tag
    without ">" ends where the next begins.  No place of a page is looked at more than
    a few times, whatever is left open.
    """
    at, tried, endless = 0, 0, set()
    while m := _START.search(page, at):
        start, tag, closing, attributes = m.start(), (m[3] or "").lower(), bool(m[2]), ""
        if not tag:
            end = page.find("-->" if m[1] else ">", m.end())
            end = len(page) if end < 0 else end + (3 if m[1] else 1)
        else:
            close = _CLOSE.match(page, m.end()) or _LOOSE.match(page, m.end())
            if close is None and start >= tried:
                close = _QUOTED.match(page, m.end())
                if not close[1]:
                    tried = len(page) if page[close.end() : close.end() + 1] in ('"', "'") else close.end()
                    close = None
            end = close.end() if close else page.find("<", m.end())
            end = len(page) if end < 0 else end
            attributes = page[m.end() : end].rstrip(">")
            if tag in UNSHOWN and not closing:
                over = None if tag in endless or tag not in RAW and attributes.endswith("/") else _END[tag].search(page, end)
                if over:
                    tag, end = "", over.end()
                elif tag in RAW:
                    tag, end = "", len(page)
                elif not attributes.endswith("/"):
                    endless.add(tag)
        yield start, end, closing, tag, attributes
        at = end


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in page order."""
    root = Element("", None)
    at, out, links = root, [], 0
    elements = [root]
    opened: Counter[str] = Counter()
    current: Block | None = None

    def text(raw: str) -> None:
        nonlocal current
        if not raw or current is None and raw.isspace():
            return
        if current is None:
            current = Block(at)
        current.parts.append(raw)
        n = len(raw)
        current.chars += n
        current.linked += n if links else 0

    def end() -> None:
        nonlocal current
        if current is not None:
            current.text = " ".join(html.unescape("".join(current.parts)).split())
            if current.text:
                up = current.parent
                current.heading = up.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
                up.chars += len(current.text)
                out.append(current)
            current = None

    def leave(up: Element) -> None:
        """Closes the open elements down from `up`."""
        nonlocal at
        while at is not up.parent:
            opened[at.tag] -= 1
            at = at.parent

    place = 0
    for start, stop, closing, tag, attributes in tokens(page):
        if start > place:
            text(page[place:start])
        place = stop
        if not tag:
            continue
        if tag == "br":
            text(" ")
        elif tag in BLOCK:
            end()
            if closing:
                if opened[tag]:
                    up = at
                    while up.tag != tag:
                        up = up.parent
                    leave(up)
                links = 0 if tag not in ("li", "p") else links
            else:
                up = at.ends
                while up is not None:
                    if tag in ENDED_BY[up.tag]:
                        leave(up)
                        break
                    up = up.parent.ends
                if tag not in VOID:
                    at = Element(tag, at, _odds(tag, attributes), at.depth + 1)
                    elements.append(at)
                    at.ends = at if tag in ENDED_BY else None if tag in SCOPE else at.parent.ends
                    opened[tag] += 1
        elif tag == "a":
            links = 0 if closing else 1
    text(page[place:])
    end()
    weigh(elements)
    unlinked = [max(0.0, len(b.text) * (1 - b.linked / max(b.chars, 1))) for b in out]
    beside: dict[int, float] = {}
    for b, n in zip(out, unlinked, strict=True):
        above = id(b.parent.parent or b.parent)
        beside[above] = beside.get(above, 0.0) + n
    every = max(1.0, sum(unlinked))
    for b in out:
        b.together = beside[id(b.parent.parent or b.parent)] / every
    return out


def content_odds(b: Block) -> float:
    """Log-odds that a block is content."""
    links = b.linked / max(b.chars, 1)
    return BIAS + PER_LOG_CHAR * math.log1p(len(b.text)) + LINKS * links + HEADING * b.heading + TOGETHER * b.together + max(-9.0, min(6.0, b.parent.odds))


def _apart(a: Element, b: Element) -> int:
    """Edges of the tree between two elements."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


class Flow:
    """Maximum flow by blocking flows of level graphs; integer capacities."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def edge(self, u: int, v: int, there: int, back: int = 0) -> None:
        for a, b, c in ((u, v, there), (v, u, back)):
            self.out[a].append(len(self.to))
            self.to.append(b)
            self.room.append(c)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source], queue = 0, deque([source])
        while queue:
            u = queue.popleft()
            for e in self.out[u]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[u] + 1
                    queue.append(self.to[e])
        return level

    def run(self, source: int, sink: int) -> list[int]:
        """Saturates all paths; returns levels, 0 or more on the source's side of the cut."""
        while (level := self.levels(source))[sink] >= 0:
            following = [0] * len(self.out)
            path: list[int] = []
            u = source
            while True:
                if u == sink:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    k = next(i for i, e in enumerate(path) if not self.room[e])
                    u = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                while following[u] < len(self.out[u]):
                    e = self.out[u][following[u]]
                    if self.room[e] and level[self.to[e]] == level[u] + 1:
                        break
                    following[u] += 1
                else:
                    if u == source:
                        break
                    e = path.pop()
                    u = self.to[e ^ 1]
                    following[u] += 1
                    continue
                path.append(e)
                u = self.to[e]
        return level


def labels(found: list[Block]) -> list[bool]:
    """Which blocks are content: the source's side of the minimum cut."""
    n = len(found)
    flow, source, sink = Flow(n + 2), n, n + 1
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        z = content_odds(b)
        as_content, as_boiler = math.log1p(math.exp(-z)), math.log1p(math.exp(z))  # costs of the labels
        less = min(as_content, as_boiler)  # flows through the block alone
        flow.edge(source, i, round(SCALE * (as_boiler - less)))
        flow.edge(i, sink, round(SCALE * (as_content - less)))
        ties = {}
        if i:
            ties[i - 1] = NEXT_TO / (1 + _apart(found[i - 1].parent, b.parent) / 2)
        above = b.parent.parent or b.parent
        if (k := last.get(id(above))) is not None:
            ties[k] = ties.get(k, 0.0) + SAME_PARENT
        last[id(above)] = i
        for k, w in ties.items():
            c = round(SCALE * w)
            flow.edge(k, i, c, c)
    level = flow.run(source, sink)
    return [level[i] >= 0 for i in range(n)]


def main_text(page: str | None) -> str:
    """Content blocks joined by blank lines; empty for a null or empty page."""
    found = blocks(page or "")
    if not found:
        return ""
    return "\n\n".join(b.text for b, keep in zip(found, labels(found), strict=True) if keep)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [main_text(x.as_py()) for x in texts(batch.column("html"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    A null or empty page has empty text.  Other columns are ignored, repeated rows
    each get a row, an empty table gives none.
    """
    kept = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(_run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
