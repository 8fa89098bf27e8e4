"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is read into text blocks with their place in the element tree. A small linear classifier over
each block's container, tag, names, length and links gives the costs of calling it content or boilerplate,
which are the capacities from the source and to the sink; blocks that follow each other and blocks
near in the tree are tied by smoothness edges. The maximum flow's source side is the content.

The weights are set by hand, there being no labelled pages. Ties weigh as much as what a short or a linked block has for or against
itself, so its neighbours decide it; a container that says what it holds (article, navigation, comments) outweighs them.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow.llm.common import ship

# HTML element names by what they do to text.
RAW = frozenset("script style noscript template iframe textarea select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo mrow ms msub msup mtext nobr q rp rt ruby s samp small span strike strong sub sup svg text time tspan tt u var".split())
#: The open elements that a new one of these ends, besides paragraphs.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

# What an element says about all text in it. A mark against content holds until its element ends; where only a name says so, an article within ends it too.
GOOD, BAD, NAMED_BAD, TOP, HIDDEN, PLAIN, LIKELY = "good", "bad", "named bad", "top", "hidden", "plain", "likely"
CONTAINER = {"article": GOOD, "main": GOOD, "nav": BAD, "footer": BAD, "aside": BAD, "form": BAD, "button": BAD, "dialog": BAD, "menu": BAD, "head": HIDDEN, "header": TOP}
ROLE = {"navigation": BAD, "banner": TOP, "contentinfo": BAD, "complementary": BAD, "search": BAD, "dialog": BAD, "alert": BAD, "alertdialog": BAD, "menu": BAD, "menubar": BAD, "main": GOOD, "article": GOOD}
NAMES_BAD = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side aside footer cookie cookies consent gdpr "
    "notice notices alert alerts comment comments commentlist disqus respond reply replies discussion related recommended recommendations share sharing social newsletter subscribe subscription signup login popup modal overlay widget widgets "
    "pagination pager toolbar tags copyright legal search form".split()
)
NAMES_TOP = frozenset("header masthead sitehead".split())
NAMES_GOOD = frozenset("article content main post entry story body text prose".split())
#: Words that make a name tell of the page's make-up, not of the element.
MODIFIERS = frozenset("has have with no without is not hide show".split())

# Weights of the block classifier, in favour of content; sums are log odds.
STATE_WEIGHT = {GOOD: 3.5, LIKELY: 1.5, PLAIN: 0.0, TOP: -4.5, NAMED_BAD: -6.0, BAD: -6.0, HIDDEN: -40.0}
TAG_WEIGHT = {"p": 0.5, "h1": 1.5, "h2": 0.8, "h3": 0.5, "h4": 0.3, "blockquote": 0.5, "pre": 1.0, "figcaption": 0.5, "li": -0.3, "td": -0.3}
LENGTH_WEIGHT, LINK_WEIGHT, BIAS = 1.6, -3.0, -2.0
#: Smoothness: between blocks in a row, halved for each step apart in the tree, UNLIKE of it where their containers say different things; and between neighbours with the same parent.
NEXT_EDGE, SIBLING_EDGE, UNLIKE, SCALE = 1.5, 2.0, 0.2, 1000

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRS = re.compile(r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW_END = {t: re.compile("</" + t, re.I | re.A) for t in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block:
    """A text block: the element that holds it, what its containers say, and its text."""

    __slots__ = ("holder", "links", "parts", "state", "tag", "text")

    def __init__(self, holder: int, tag: str, state: str) -> None:
        self.holder, self.tag, self.state = holder, tag, state
        self.parts: list[str] = []
        self.links = 0
        self.text = ""


def _named(value: str) -> str | None:
    """What a class or id says of its element."""
    found = None
    for name in value.lower().split():
        words = re.split("[-_]+", name)
        if MODIFIERS.intersection(words[:-1]):
            continue
        if NAMES_BAD.intersection(words):
            return NAMED_BAD
        if NAMES_TOP.intersection(words):
            found = TOP
        elif NAMES_GOOD.intersection(words):
            found = found or LIKELY
    return found


def _state(before: str, tag: str, attrs: str, names: bool) -> str:
    """What holds for the text of an element with these attributes, within a container's."""
    said = [CONTAINER[tag]] if tag in CONTAINER else []
    if attrs.strip():
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                if names and tag not in ("body", "html") and (s := _named(value)):
                    said.append(s)
            elif name == "role":
                said += [ROLE[value]] if value in ROLE else []
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
                said.append(HIDDEN)
    for state in (HIDDEN, BAD, NAMED_BAD):
        if state in said:
            return HIDDEN if before == HIDDEN else BAD if before == BAD else state
    if before in (HIDDEN, BAD):
        return before
    if GOOD in said:
        return GOOD
    if TOP in said:
        return TOP if before in (PLAIN, LIKELY) else before  # an article's own head is part of it
    return LIKELY if LIKELY in said and before == PLAIN else before


def blocks(html: str, names: bool = True) -> tuple[list[Block], list[int], list[int]]:
    """The page's text blocks in page order, with white space and character references resolved; blocks without text are left out. And of all block elements the parent and the depth.

    One pass over the page: each tag is read once, and elements are closed once. A quote that never closes counts as any other character from there on.
    """
    found: list[Block] = []
    parent, depth = [-1], [0]
    stack: list[tuple[str, int, str]] = [("", 0, PLAIN)]  # tag, element number, state
    count: dict[str, int] = {}
    block: Block | None = None
    linked, quotes, at, end = False, True, 0, len(html)

    def add(text: str) -> None:
        nonlocal block
        if block is None:
            if not text.strip():
                return
            block = Block(stack[-1][1], stack[-1][0], stack[-1][2])
            found.append(block)
        block.parts.append(unescape(text))
        if linked:
            block.links += len(text.strip())

    def pop() -> str:
        tag = stack.pop()[0]
        count[tag] -= 1
        return tag

    start = 0  # of the text not yet added
    while at < end:
        at = html.find("<", at)
        if at < 0 or (stop := html.find(">", at)) < 0:
            break
        m = _TAG.match(html, at)
        if m is None:
            if html[at + 1 : at + 2] not in ("!", "?", "/"):
                at += 1
                continue
            add(html[start:at])
            if html.startswith("<!--", at):
                stop = html.find("-->", at + 4)
                stop = end if stop < 0 else stop + 2
            elif html.startswith("<![CDATA[", at):
                stop = html.find("]]>", at)
                stop = end if stop < 0 else stop + 2
            at = start = stop + 1
            continue
        add(html[start:at])
        if quotes:
            whole = _ATTRS.match(html, m.end())
            quotes = whole is not None
            stop = whole.end() - 1 if whole else stop
        close, tag, attrs = m.group(1), m.group(2).lower(), html[m.end() : stop]
        at = start = stop + 1
        if tag == "a":
            linked = not close
        if close:
            if tag not in INLINE:
                block = None
                if count.get(tag):
                    while pop() != tag:
                        pass
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                raw_end = _RAW_END[tag].search(html, at)
                stop = html.find(">", raw_end.start()) if raw_end else -1
                at = start = end if stop < 0 else stop + 1
        elif tag == "br":
            if block is not None:
                block.parts.append(" ")
        elif tag not in INLINE:
            block = None
            if tag in VOID:
                continue
            ends = ENDS.get(tag, ())
            while stack[-1][0] == "p" or stack[-1][0] in ends:  # a block element ends an open paragraph
                pop()
            parent.append(stack[-1][1])
            depth.append(depth[stack[-1][1]] + 1)
            stack.append((tag, len(parent) - 1, _state(stack[-1][2], tag, attrs, names)))
            count[tag] = count.get(tag, 0) + 1
    add(html[start:])
    for b in found:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in found if b.text], parent, depth


def log_odds(b: Block) -> float:
    """The classifier: how far the block looks like content."""
    size = len(b.text)
    return BIAS + STATE_WEIGHT[b.state] + TAG_WEIGHT.get(b.tag, 0.0) + LENGTH_WEIGHT * min(3.0, (size / 40) ** 0.5) + LINK_WEIGHT * min(1.0, b.links / size)


def _apart(a: int, b: int, parent: list[int], depth: list[int], most: int = 14) -> int:
    """Steps between two elements in the tree; not counted further than ``most``."""
    steps = 0
    while a != b and steps < most:
        if depth[a] < depth[b]:
            a, b = b, a
        a = parent[a]
        steps += 1
    return steps


def edges(found: list[Block], parent: list[int], depth: list[int]) -> list[tuple[int, int, int]]:
    """Smoothness edges with whole-number capacities: each block with the next, and with the next of which the element has the same parent and the containers say the same."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            before = found[i - 1]
            weight = SCALE * NEXT_EDGE * (1 if before.state == b.state else UNLIKE)
            c = round(weight / 2 ** max(0, _apart(before.holder, b.holder, parent, depth) - 2))
            if c:
                out.append((i - 1, i, c))
        kin = parent[b.holder], b.state
        if kin in last:
            out.append((last[kin], i, round(SCALE * SIBLING_EDGE)))
        last[kin] = i
    return out


def source_side(gain: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source after the maximum flow: gain > 0 is the capacity from the source, < 0 that to the sink; ties bind both ways.

    A node whose own capacity is more than all its ties together is on its side in every minimum cut; it goes first, and its ties become
    capacities of its neighbours. Flow is worked out for what is left.
    """
    n = len(gain)
    gain, rest = list(gain), [0] * n
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, c in ties:
        near[a].append((b, c))
        near[b].append((a, c))
        rest[a] += c
        rest[b] += c
    side: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if side[i] is not None or -rest[i] < gain[i] <= rest[i]:
            continue
        side[i] = gain[i] > rest[i]
        for j, c in near[i]:
            if side[j] is None:
                gain[j] += c if side[i] else -c
                rest[j] -= c
                todo.append(j)
    left = [i for i in range(n) if side[i] is None]
    at = {i: k for k, i in enumerate(left)}
    flowing = _flow([gain[i] for i in left], [(at[a], at[b], c) for a, b, c in ties if a in at and b in at])
    for i, s in zip(left, flowing, strict=True):
        side[i] = s
    return side


def _flow(gain: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """source_side() by the maximum flow, found along shortest ways."""
    n = len(gain)
    source, sink = n, n + 1
    to, cap, out = [], [], [[] for _ in range(n + 2)]

    def edge(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(there)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            edge(source, i, g, 0)
        elif g < 0:
            edge(i, sink, -g, 0)
    for a, b, c in ties:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                f = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f
                k = next(k for k, e in enumerate(path) if not cap[e])
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[a] < len(out[a]):
                e = out[a][nxt[a]]
                if cap[e] and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                nxt[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                e = path.pop()
                a = to[e ^ 1]


def labelled(html: str, names: bool = True) -> list[tuple[Block, bool]]:
    """The page's blocks and whether each is content."""
    found, parent, depth = blocks(html, names)
    keep = source_side([round(SCALE * log_odds(b)) for b in found], edges(found, parent, depth))
    return list(zip(found, keep, strict=True))


def main_text(html: str | None) -> str:
    """The page's content blocks in page order, one space between; empty for a page without any.

    Where the names of classes leave nothing of a page, it is labelled without them.
    """
    found = labelled(html or "")
    if not any(k for _, k in found) and any(b.state == NAMED_BAD for b, _ in found):
        found = labelled(html or "", names=False)
    return " ".join(b.text for b, k in found if k)


def extract(pages: DataFrame) -> DataFrame:
    """pages with their columns but html, and ``text`` and ``n_chars``. A null page has an empty text; columns with these names are replaced."""
    ship(pages.sparkSession)
    kept = pages.drop("text", "n_chars")
    names = [c for c in kept.columns if c != "html"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "html"] + ["text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return kept.mapInArrow(run, schema)
