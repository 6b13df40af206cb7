"""HTML main-text extraction by minimum-cut labelling.

A page becomes text blocks (runs of inline content) with the elements around them. A linear classifier gives two kinds of
nodes log-odds of being content, the terminal capacities of a flow network: blocks by their own text (length relative to
the page's longest plain block, link density, punctuation, kind), and elements by their tag, role, class and id words.
Smoothness edges join blocks that follow each other, blocks that follow each other under one element (weaker with the
distance in the tree, and more so across the border of a part of the page), and each block to the telling elements around
it. A block is thus labelled with its surroundings: the minimum cut, found by maximum flow over all nodes, separates
content from boilerplate at the least total cost.
"""

from __future__ import annotations

import html as _html
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes noembed".split())
#: Elements whose text isn't page text at all.
DROPPED = RAW | frozenset("head template svg math canvas audio video object select datalist button".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption colgroup".split()
)
#: Start tags that end an open element of the given kinds, up to the nearest boundary.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "option": ("option",)}
BOUNDARY = frozenset("ul ol dl table menu dir article section div main aside nav header footer form body html blockquote".split())
CLOSES_P = BLOCK - {"body", "html", "tbody", "td", "th", "tr", "thead", "tfoot", "caption", "colgroup", "option", "optgroup", "legend", "frameset"}

#: Log-odds of content. Parts of a page that are never its article:
PART, HEADER = -6.0, -5.0
BAD_TAGS = {**dict.fromkeys(("nav", "footer", "aside", "form", "dialog", "menu", "search"), PART), "header": HEADER, "fieldset": -2.0, "address": -0.5}
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status tooltip".split())
#: Class and id words that name such a part, and others that only hint at one.
PART_WORDS = frozenset(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar banner ad ads adv advert adverts advertisement advertising adsense "
    "adsbygoogle promo promos promotion promoted sponsor sponsors sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login signin "
    "social share sharing sharebar related recommended recommendations comment comments commentlist reply replies disqus pagination pager".split()
)
HINT_WORDS = frozenset("foot head subscription respond discussion widget widgets copyright disclaimer legal hidden skip paywall form search".split())
HINT, UNSEEN = -1.2, -30.0
_STATES = frozenset("has no not with without open closed enabled disabled".split())
GOOD_TAGS = {"article": 1.8, "main": 1.8}
GOOD_WORDS = {"article": 0.8, "content": 0.6, "post": 0.6, "entry": 0.6, "story": 0.8, "body": 0.4, "text": 0.4, "main": 0.6, "blog": 0.4}
#: What the block itself says; lengths count up to the page's longest plain block, or FULL characters.
BASE, LENGTH, FULL, LINKED, HEADING, ITEM, SENTENCE, LEGAL = 0.2, 3.0, 120, 2.5, 0.8, -0.4, 0.3, -2.5
#: Edges: of two blocks under one element; the factor for each further step in the tree, and at the border of a part.
NEAR, APART, BORDER, SIBLING = 1.2, 0.65, 0.2, 0.6
#: A form or a hinted part that holds more than this share of the page's plain text is the page.
WHOLE = 0.6

_TAG = re.compile(
    r"""<!--(?:>|->|.*?--!?>|.*)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|[="'])*+)>|</[^a-zA-Z][^>]*>""",
    re.S,
)
_ATTRS = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[^A-Za-z0-9]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_LEGAL = re.compile(r"^\s*(?:©|\(c\)\s|copyright\b|all rights reserved)", re.I)


class Element:
    __slots__ = ("name", "up", "depth", "good", "bad", "hint", "main", "chars")

    def __init__(self, name: str, up: Element | None, good: float = 0.0, bad: float = 0.0, hint: float = 0.0):
        self.name, self.up, self.good, self.bad, self.hint, self.main, self.chars = name, up, good, bad, hint, False, 0
        self.depth = up.depth + 1 if up else 0


@lru_cache(50_000)
def evidence(name: str, attrs: str) -> tuple[float, float, float]:
    """(content, boilerplate, hints of boilerplate) of one start tag."""
    good, bad, hint = GOOD_TAGS.get(name, 0.0), BAD_TAGS.get(name, 0.0), 0.0
    if attrs and name not in ("body", "html"):
        for m in _ATTRS.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _UNSEEN.search(value)):
                bad = UNSEEN
            elif key == "role":
                roles = set(value.lower().split())
                if roles & BAD_ROLES:
                    bad = min(bad, PART)
                if roles & {"main", "article"}:
                    good = max(good, GOOD_TAGS["main"])
            elif key in ("class", "id"):
                for part in value.split():
                    words = {w.lower() for w in _CAMEL.split(part) if w}
                    if _STATES & words:  # says what the page has around here, not what this element is
                        continue
                    head = {"header", "head"} & words and {"article", "entry", "post", "story"} & words
                    if not head and PART_WORDS & words:
                        bad = min(bad, PART)
                    elif not head and HINT_WORDS & words:
                        hint = HINT
                    good = max([good, *(GOOD_WORDS.get(w, 0.0) for w in words)])
    return good, bad, hint


class Block:
    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: Element, linked: int):
        self.text, self.element, self.linked = text, element, linked


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, white space collapsed, character references decoded. Broken markup is mended."""
    top = Element("html", None)
    stack, out = [top], []
    parts: list[str] = []
    linked, links, pos, n = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, next(e for e in reversed(stack) if e.name in BLOCK or e is top), linked))
            parts.clear()
        linked = 0

    def say(raw: str, decode: bool = True) -> None:
        nonlocal linked
        text = _html.unescape(raw) if decode and "&" in raw else raw
        parts.append(text)
        if links:
            linked += len("".join(text.split()))

    def pop_to(k: int) -> None:
        nonlocal links
        if any(e.name in BLOCK for e in stack[k:]):
            flush()
        links -= sum(e.name == "a" for e in stack[k:])
        del stack[k:]

    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            say(page[pos:])
            break
        if lt > pos:
            say(page[pos:lt])
        m = _TAG.match(page, lt)
        if not m:  # a < that begins no tag is text; a tag that never ends takes the rest
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]):
                break
            say("<")
            pos = lt + 1
            continue
        pos = m.end()
        if m["cdata"] is not None:
            say(m["cdata"], False)
            continue
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name == "br":
                parts.append(" ")
                continue
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            if not k:
                continue
            above = [e for e in stack[k + 1 :] if e.name in BLOCK]
            if name in BLOCK:
                pop_to(k)
            elif above:  # an inline end tag doesn't end the blocks opened since
                links -= name == "a"
                del stack[k]
            else:
                pop_to(k)
            continue
        if name in DROPPED:
            if name == "head" or name not in RAW:
                close = re.compile(rf"</{name}\s*>|<body[\s>]" if name == "head" else rf"</{name}[\s>/]", re.I).search(page, pos)
                if name in ("button", "select", "object", "template", "svg", "math", "canvas", "audio", "video", "datalist", "head"):
                    if not m[0].endswith("/>"):
                        pos = n if not close else close.start() if close[0].lower().startswith("<body") else page.find(">", close.start()) + 1 or n
            elif not m[0].endswith("/>") or name in ("script", "style", "title", "textarea"):
                close = re.compile(rf"</{name}[\s>/]", re.I).search(page, pos)
                pos = (page.find(">", close.start()) + 1 or n) if close else n
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in ("html", "body"):
            flush()
            if name == "body" and not any(e.name == "body" for e in stack):
                pop_to(1)
                stack.append(Element(name, stack[-1], *evidence(name, m["attrs"] or "")))
            continue
        if name in CLOSES_P:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == "p" or stack[k].name in BOUNDARY), 0)
            if k and stack[k].name == "p":
                pop_to(k)
        if name in ENDS:
            kinds, k = ENDS[name], 0
            for j in range(len(stack) - 1, 0, -1):
                if stack[j].name in kinds:
                    k = j
                elif stack[j].name in BOUNDARY:
                    break
            if k:
                pop_to(k)
        elif re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", stack[-1].name):
            pop_to(len(stack) - 1)
        if name in BLOCK:
            flush()
        e = Element(name, stack[-1], *evidence(name, m["attrs"] or ""))
        if e.name in GOOD_TAGS and not e.bad:
            up = e.up
            while up is not None and not up.main:
                up.main = True
                up = up.up
        if not m[0].endswith("/>") or name in BLOCK:
            stack.append(e)
            links += name == "a"
    flush()
    return out


def _chain(e: Element | None) -> list[Element]:
    out = []
    while e is not None:
        out.append(e)
        e = e.up
    return out


def _bad(e: Element, total: int) -> float:
    """Evidence against content that an element gives, if it isn't the page itself. Elements around an article give none."""
    if e.main:
        return 0.0
    whole = e.chars > WHOLE * total
    return (0.0 if whole and e.name == "form" and e.bad == PART else e.bad) + (0.0 if whole else e.hint)


def network(blocks: list[Block]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Log-odds of content of a page's blocks, then of the telling elements around them; and the edges of all."""
    plain = [len(b.text.replace(" ", "")) - b.linked for b in blocks]
    chains = [_chain(b.element) for b in blocks]
    for n, chain in zip(plain, chains, strict=True):
        for e in chain:
            e.chars += n
    total = sum(plain)
    held: dict[int, tuple[float, list[int]]] = {}  # element: its evidence, its blocks
    apart = []
    for i, (b, chain) in enumerate(zip(blocks, chains, strict=True)):
        best = max(chain, key=lambda e: e.good)
        if best.good:
            held.setdefault(-id(best), (best.good, []))[1].append(i)
        part = False
        for k, e in enumerate(chain):
            own = e.name == "header" and b.element.name in HEADINGS and e.bad == HEADER and any(x.name in GOOD_TAGS for x in chain[k + 1 :])
            if (bad := 0.0 if own else _bad(e, total)) < 0:
                held.setdefault(id(e), (bad, []))[1].append(i)
                part = part or bad <= -2.0
        apart.append(part)
    full = max([1, *(min(FULL, n) for n, x in zip(plain, apart, strict=True) if not x)])
    costs, edges = [], edges_of(blocks)
    for b, n, chain in zip(blocks, plain, chains, strict=True):
        linked = b.linked / max(1, n + b.linked)
        s = BASE + LENGTH * min(1.0, max(0.0, n / full)) ** 0.5 - LENGTH / 2 - LINKED * linked
        s += HEADING * (b.element.name in HEADINGS) + ITEM * (b.element.name in ("li", "td", "dd", "dt")) + SENTENCE * (b.text[-1] in ".!?:…\"”»")
        costs.append(s + LEGAL * bool(not any(e.name in GOOD_TAGS for e in chain) and _LEGAL.match(b.text)))
    for evidence_, inside in held.values():
        edges += [(i, len(costs), abs(evidence_)) for i in inside]
        costs.append(evidence_ * len(inside))
    return costs, edges


HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def nearness(a: Element, b: Element) -> float:
    """Weight of the edge between blocks of two elements."""
    if a is b:
        return NEAR
    if a.up is b.up:
        return NEAR * (BORDER if min(a.bad, b.bad) <= -2.0 else 1.0)
    steps, border = -2, False
    while a is not b:
        if a.depth < b.depth:
            a, b = b, a
        border = border or a.bad <= -2.0 or a.name in GOOD_TAGS
        a, steps = a.up, steps + 1
    return NEAR * APART ** max(0, steps) * (BORDER if border else 1.0)


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labels of least total cost: costs[i] > 0 is paid if i is False, -costs[i] if costs[i] < 0 and i is True, and
    an edge's weight if its ends differ. Found by maximum flow from a source (True) to a sink (False)."""
    n = len(costs)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def add(u: int, v: int, forth: float, back: float) -> None:
        graph[u].append(len(to))
        to.append(v)
        cap.append(forth)
        graph[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i, c in enumerate(costs):
        if c > 0:
            add(s, i, c, 0.0)
        elif c < 0:
            add(i, t, -c, 0.0)
    for u, v, w in edges:
        add(u, v, w, w)
    while True:  # Dinic: layers, then blocking flow
        level = {s: 0}
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if cap[e] > 1e-12 and to[e] not in level:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if t not in level:
            return [i in level for i in range(n)]
        tried = [0] * (t + 1)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if cap[e] <= 1e-12)
                u = to[path[k] ^ 1]
                del path[k:]
            while tried[u] < len(graph[u]):
                e = graph[u][tried[u]]
                if cap[e] > 1e-12 and level.get(to[e]) == level[u] + 1:
                    path.append(e)
                    u = to[e]
                    break
                tried[u] += 1
            else:
                if u == s:
                    break
                e = path.pop()
                u = to[e ^ 1]
                tried[u] += 1


def main_text(page: str | None) -> str:
    """The page's main text: blocks labelled content, in page order, joined by two line feeds. None or no content: empty."""
    if not page:
        return ""
    blocks = blocks_of(page)
    keep = min_cut(*network(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=False) if k)


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """(i, j, weight): blocks that follow each other in the page, and under one element."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        up = id(b.element.up)
        if i:
            edges.append((i - 1, i, nearness(blocks[i - 1].element, b.element)))
        if up in last and last[up] < i - 1:
            edges.append((last[up], i, SIBLING / NEAR * nearness(blocks[last[up]].element, b.element)))
        last[up] = i
    return edges


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row; n_chars: code points of text.

    Null and empty html give an empty text; ids and urls may be null or repeated and are passed on; no rows give none.
    Pages of any length are read in full. Other columns are ignored.
    """
    ship(pages.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                texts = [main_text(x) for x in part["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["id"], part["url"], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long").withColumnRenamed("page_id", id)
