"""Main text of web pages by minimum-cut labelling.

A page becomes a sequence of text blocks in page order. A logistic model over each block's place in the
document tree, link density, length and punctuation gives its cost as content and as boilerplate, and
these become the capacities to the two terminals. Blocks that follow one another, and blocks close in
the tree, are joined by smoothness edges. The maximum flow between the terminals separates content from
boilerplate at the least total cost: a lone doubtful block goes with its surroundings. Equal cuts keep
more text. Script, style and other elements that are never text are left out when the page is read.

Markup may be unclosed, badly nested or cut off; whatever can be read is read. Null and empty pages, and
pages without content, have the empty text. No text is capped. Repeated rows get equal values.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import shared

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s>]+)))?")
#: What is worth parsing attributes for.
HIDES, GONE = re.compile(r"hidden|style", re.I), re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NEVER = frozenset("script style noscript template iframe object svg canvas math select option textarea button title head audio video".split())
#: Any other start tag, or text, ends a head that isn't closed.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag ends an open element of these first, up to the given boundary.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Weights of the model: by the nearest element that says something, by words in its class, id or role, and by the block itself.
PLACES = {"article": 7.0, "main": 5.0, "nav": -9.0, "header": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "menu": -9.0, "dialog": -9.0}
BAD = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|alert|popup|modal|newsletter|subscribe|signup|login|nav\w*|menu\w*|breadcrumb\w*|header|masthead|footer|side-?bar|widget\w*|related|recommend\w*|share|social|comment\w*|replies|reply|respond|disqus\w*|pagination|pager|skip\w*|copyright|legal|disclaimer|contentinfo|complementary|search|tags)(?:$|[\s_-])", re.I)
GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|post-?(?:body|content)|entry-?content|content|story\w*|main\w*|page-?(?:body|content)|text)(?:$|[\s_-])", re.I)
NAMED_BAD, NAMED_GOOD = -9.0, 5.0
NEIGHBOURS, SIBLINGS, COUSINS, SCALE = 0.6, 0.8, 0.3, 64


def is_hidden(raw: str) -> bool:
    """Whether the attributes of a start tag hide its element: one named hidden, or a style that displays nothing."""
    if not HIDES.search(raw):
        return False
    return any((name := m[1].lower()) == "hidden" or name == "style" and GONE.search(unescape(m[2] or m[3] or m[4] or "")) for m in ATTRIBUTE.finditer(raw))


class Block:
    __slots__ = ("parts", "linked", "path", "place", "heading")

    def __init__(self, path: tuple[int, ...], place: float, heading: bool):
        self.parts: list[str] = []
        self.linked = 0
        self.path, self.place, self.heading = path, place, heading


def blocks(html: str) -> list[tuple[str, Block]]:
    """The page's blocks with their texts, white space and references resolved."""
    # open elements: (tag, number, place, hidden)
    stack: list[tuple[str, int, float, bool]] = [("", 0, 0.0, False)]
    out: list[Block] = []
    now: Block | None = None
    at = number = links = 0

    def text(s: str) -> None:
        nonlocal now
        if stack[-1][0] == "head" and not s.isspace():
            pop(len(stack) - 1)
        if stack[-1][3] or not s:
            return
        if now is None:
            if s.isspace():
                return
            path = tuple(e[1] for e in stack if e[0] in BLOCKS)
            now = Block(path, stack[-1][2], any(e[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for e in stack[-3:]))
            out.append(now)
        s = unescape(s)
        now.parts.append(s)
        if links:
            now.linked += len(s)

    def pop(to: int) -> None:
        nonlocal links
        links -= sum(e[0] == "a" for e in stack[to:])
        del stack[to:]

    n = len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if not m[1] and stack[-1][0] == "head" and tag not in IN_HEAD:
            pop(len(stack) - 1)
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if stack[k][0] in BLOCKS and tag not in BLOCKS:
                    break
            if tag in BLOCKS:
                now = None
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCKS:
            now = None
            for k in range(len(stack) - 1, 0, -1):  # a paragraph ends where a block begins
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
            if tag in ENDS:
                ended, bound = ENDS[tag]
                first = None
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in bound:
                        break
                    if stack[k][0] in ended:
                        first = k
                if first:
                    pop(first)
        if tag in VOID:
            continue
        place, hidden = stack[-1][2], stack[-1][3] or tag in NEVER
        if tag in PLACES:
            place = PLACES[tag] if place > -9 else place
        if m[3]:
            named = " ".join(a or b or c for a, b, c in NAMED.findall(m[3]))
            if named and place > -9:
                place = NAMED_BAD if BAD.search(named) and tag not in ("body", "html", "article", "main") else max(place, NAMED_GOOD) if GOOD.search(named) else place
            hidden = hidden or is_hidden(m[3])
        if m[3].endswith("/") and tag not in BLOCKS and tag not in ("a", "b", "i", "em", "span", "strong"):
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\b[^>]*(?:>|$)", re.I).search(html, at)
            at = end.end() if end else n
            continue
        number += 1
        stack.append((tag, number, place, hidden))
        links += tag == "a"
    done = ((" ".join("".join(b.parts).split()), b) for b in out)
    return [x for x in done if x[0]]


def score(text: str, b: Block) -> float:
    """Log-odds that a block is content."""
    words = text.count(" ") + 1
    linked = min(1.0, b.linked / max(1, sum(map(len, b.parts))))
    z = -1.2 + b.place + 0.12 * min(words, 30) - 4.0 * linked + (0.8 if text[-1] in ".!?…:;\"”»)" else 0.0) + (0.6 if b.heading else 0.0)
    if "©" in text[:40] or "all rights reserved" in text[:200].lower():
        z -= 2.0 if b.place < 5 else 0.0
    return z


def cut(z: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """Which nodes lie on the content side of a minimum cut; z are capacities to content's terminal (positive) or boilerplate's (negative)."""
    n = len(z)
    supply, room = [max(x, 0) for x in z], [max(-x, 0) for x in z]
    left: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), c in edges.items():
        left[a][b] = left[a].get(b, 0) + c
        left[b][a] = left[b].get(a, 0) + c
    sources = deque(i for i in range(n) if supply[i])
    closed = [False] * n  # from here no room can be reached any more
    while sources:
        s = sources[0]
        if closed[s]:
            sources.popleft()
            continue
        came, queue, end = {s: s}, deque([s]), -1
        while queue and end < 0:
            u = queue.popleft()
            for v, c in left[u].items():
                if c > 0 and v not in came and not closed[v]:
                    came[v] = u
                    if room[v]:
                        end = v
                        break
                    queue.append(v)
        if end < 0:
            for v in came:
                closed[v] = True
            continue
        path, v = [], end
        while v != s:
            path.append((came[v], v))
            v = came[v]
        flow = min(supply[s], room[end], *(left[u][v] for u, v in path))
        supply[s] -= flow
        room[end] -= flow
        for u, v in path:
            left[u][v] -= flow
            left[v][u] += flow
        if not supply[s]:
            sources.popleft()
    # boilerplate: what still reaches its terminal
    out, queue = [True] * n, deque(i for i in range(n) if room[i])
    for i in queue:
        out[i] = False
    while queue:
        v = queue.popleft()
        for u in left[v]:
            if out[u] and left[u][v] > 0:
                out[u] = False
                queue.append(u)
    return out


def labelled(html: str | None) -> list[tuple[str, bool]]:
    """The page's blocks, and which are content."""
    found = blocks(html) if html else []
    if not found:
        return []
    z = [round(SCALE * score(t, b)) for t, b in found]
    edges: dict[tuple[int, int], int] = {}
    last: dict[tuple[str, int], int] = {}
    for i, (_, b) in enumerate(found):
        if i:
            edges[i - 1, i] = edges.get((i - 1, i), 0) + round(SCALE * NEIGHBOURS)
        for kind, depth, weight in (("parent", 2, SIBLINGS), ("grandparent", 3, COUSINS)):
            if len(b.path) >= depth:
                key = (kind, b.path[-depth])
                if (j := last.get(key)) is not None:
                    edges[j, i] = edges.get((j, i), 0) + round(SCALE * weight)
                last[key] = i
    return [(t, keep) for (t, _), keep in zip(found, cut(z, edges))]


def main_text(html: str | None) -> str:
    return " ".join(t for t, keep in labelled(html) if keep)


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without the column html, with text and n_chars, which replace columns of these names; all others stay, whatever their names. One pass, no shuffle."""
    kept = [f for f in pages.schema if f.name not in (html, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.columns[-1].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*b.schema.names[:-1], "text", "n_chars"])

    own = "_html"
    while own.lower() in {f.name.lower() for f in kept}:
        own = f"_{own}"
    rows = pages.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{html}`").cast("string").alias(own))
    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string, n_chars long"]))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(shared.table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
