"""Main text of web pages: block costs from a classifier, labels from a minimum cut over adjacency and DOM proximity."""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator, Sequence
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from citeloom.llm.common import in_pieces, text_of
from citeloom.llm.labelled_pages import PAGES

# Elements of HTML by their part in the page.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary "
                  "table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math object audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PROSE = frozenset(("p", "blockquote", "pre", "figcaption", "dd"))

#: Elements, roles and words of class and id names that mark a part of a page as text or as something else.
TEXT_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset("button fieldset head label legend menu optgroup option search select".split())
TEXT_WORDS = frozenset("article body content entry main maincontent post story".split())
OTHER_WORDS = frozenset(
    "alert aside banner breadcrumb breadcrumbs complementary consent contentinfo copyright dialog disclaimer footer form gdpr header legal login masthead "
    "menu modal nav navbar navigation notice pager pagination popup search share sharing sidebar signup skip social tags toolbar topbar".split())
#: Parts that stay what they are even if they hold an article.
REMARK_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts comment comments cookie cookies discussion newsletter promo promotion recommended related "
    "replies reply respond sponsor sponsored subscribe widget".split())
REMARK_TAGS = frozenset(("aside", "dialog", "footer", "form", "nav"))
#: ``class="post-header"`` names the head of a text, ``class="main-header"`` that of a page.
HEADED = frozenset(("article", "entry", "post", "story"))

_TOKEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|([!?]))")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|data-main)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = re.compile(r"""[.!?:;…。！？]["'”’»)\]]*$""")
_COPYRIGHT = re.compile(r"©|\bcopyright\b|\ball rights reserved\b", re.I)


class Element(NamedTuple):
    """An open or closed element; ``mark`` is 1 in a part marked as text, -1 in one marked otherwise, -2 in remarks, else 0."""

    tag: str
    parent: int
    depth: int
    mark: int
    labelled: bool


class Block(NamedTuple):
    text: str
    element: int
    linked: int  # characters inside links


class _Reader:
    """Blocks of one page, in page order. Time is linear in the page: every element is opened and closed once."""

    def __init__(self, html: str):
        self.elements = [Element("", -1, 0, 0, False)]
        self.open, self.names, self.inner = [0], Counter(), [0]
        self.parts: list[str] = []
        self.linked, self.links = 0, 0
        self.blocks: list[Block] = []
        at, quotes, end = 0, True, len(html)
        while at < end:
            found = _TOKEN.search(html, at)
            if not found:
                self._say(html[at:])
                break
            if found.start() > at:
                self._say(html[at:found.start()])
            comment, closing, name, _ = found.groups()
            if comment:
                # a comment may be closed by the dashes that open it
                close = html.find("-->", found.end() - 2)
                at = close + 3 if close >= 0 else end
                continue
            if name is None:
                close = html.find(">", found.end())
                at = close + 1 if close >= 0 else end
                continue
            rest = _REST.match(html, found.end()) if quotes else None
            if rest is None:
                # a quote that never ends: from here on quotes mean nothing in tags
                quotes = False
                close = html.find(">", found.end())
                if close < 0:
                    break
                rest_end = close + 1
            else:
                rest_end = rest.end()
            at, name = rest_end, name.lower()
            if closing:
                self._close(name)
            elif name in RAW:
                if not html.startswith("/>", rest_end - 2) or name in ("script", "style", "title", "textarea"):
                    close = re.compile(f"</{name}(?![^\\s/>])", re.I).search(html, rest_end)
                    at = close.start() if close else end
            else:
                self._start(name, html[found.end():rest_end - 1])
        self._flush()

    def _say(self, raw: str) -> None:
        text = unescape(raw)
        self.parts.append(text)
        if self.links:
            self.linked += len("".join(text.split()))

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.inner[-1], self.linked))
            self.parts.clear()
            self.linked = 0

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.parts.append(" ")
        if name in VOID:
            if name == "hr":
                self._flush()
            return
        if name in BLOCK:
            self._flush()
            inner = self.elements[self.inner[-1]].tag
            if inner == "p" or inner in HEADING and name in HEADING or inner == name and name in ("li", "option", "tr", "td", "th"):
                self._close(inner)
            elif inner in ("dt", "dd") and name in ("dt", "dd") or inner in ("td", "th") and name in ("td", "th", "tr"):
                self._close(inner)
        elif name == "a" and self.names["a"]:
            self._close("a")
        above = self.elements[self.open[-1]]
        mark, labelled = self._mark(name, attributes, above)
        number = len(self.elements)
        self.elements.append(Element(name, self.open[-1], above.depth + 1, above.mark if mark is None else mark, labelled or above.labelled))
        self.open.append(number)
        self.names[name] += 1
        if name in BLOCK:
            self.inner.append(number)
        elif name == "a":
            self.links += 1

    def _mark(self, name: str, attributes: str, above: Element) -> tuple[int | None, bool]:
        """What the element itself says of its content, and whether a label calls it main text."""
        words, hidden, labelled = set(), False, False
        for key, value in _NAMED.findall(attributes) if attributes.strip() else ():
            key = key.lower()
            if key == "data-main":
                labelled = True
            elif key == "hidden" or key == "aria-hidden":
                hidden |= key == "hidden" or "true" in value.lower()
            elif name not in ("html", "body"):
                words.update(w.lower() for w in _WORDS.findall(value))
        if name in REMARK_TAGS or words & REMARK_WORDS or hidden:
            return -2, labelled
        if name == "header" or "header" in words and words & HEADED:
            # a text's own header holds its title
            return (-1 if name == "header" and above.mark <= 0 else None), labelled
        if name in OTHER_TAGS or words & OTHER_WORDS:
            return min(-1, above.mark), labelled
        # inside other parts only an element made for main text changes that, and in remarks not even an article
        if name == "main" or name == "article" and above.mark > -2 or above.mark >= 0 and (name in TEXT_TAGS or words & TEXT_WORDS):
            return 1, labelled
        return None, labelled

    def _close(self, name: str) -> None:
        if name in BLOCK:
            self._flush()
        if not self.names[name]:
            return
        while True:
            number = self.open.pop()
            tag = self.elements[number].tag
            self.names[tag] -= 1
            if tag == "a":
                self.links -= 1
            elif tag in BLOCK:
                self._flush()
                self.inner.pop()
            if tag == name:
                return


def features(reader: _Reader) -> np.ndarray:
    """A row per block: what its place says, then what its text says."""
    rows = []
    for text, number, linked in reader.blocks:
        own = reader.elements[number]
        chars, words = len(text), text.count(" ") + 1
        solid = max(1, chars - words + 1)
        rows.append((1.0, own.mark > 0, own.mark < 0, min(1.0, linked / solid), min(1.0, math.log1p(chars) / 6), bool(_END.search(text)),
                     own.tag in HEADING, own.tag in PROSE, own.tag == "li", min(1.0, text.count(",") * 8 / words), bool(_COPYRIGHT.search(text))))
    return np.array(rows, "float64").reshape(len(rows), 11)


def train(pages: Sequence[str] = PAGES, rounds: int = 3000, rate: float = 0.5, shrink: float = 2e-4) -> np.ndarray:
    """Logistic regression of main text on block features; ``pages`` is a small labelled table, as in ``labelled_pages``."""
    read = [_Reader(p) for p in pages]
    x = np.concatenate([features(r) for r in read])
    y = np.array([r.elements[b.element].labelled for r in read for b in r.blocks], "float64")
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        w -= rate * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + shrink * w)
    return w


UNIT = 1000
NEAR = 1.2  # cost, in nats, of telling two neighbouring blocks of one parent apart
FAR_STEPS = 6


def _steps(elements: list[Element], a: int, b: int) -> int:
    """Edges of the DOM tree between two elements, as far as ``FAR_STEPS``."""
    steps = 0
    while a != b and steps < FAR_STEPS:
        if elements[a].depth >= elements[b].depth:
            a = elements[a].parent
        else:
            b = elements[b].parent
        steps += 1
    return steps


def smoothness(reader: _Reader) -> list[tuple[int, int, int]]:
    """Edges ``(i, j, capacity)``: each block with the next one, and with the next block under the same parent. The capacity
    falls with the steps between them in the DOM and across parts that are marked differently."""
    elements, blocks, edges, last = reader.elements, reader.blocks, [], {}
    for j, block in enumerate(blocks):
        parent = elements[block.element].parent
        before = {j - 1} if j else set()
        if parent in last:
            before.add(last[parent])
        for i in sorted(before):
            own, other = elements[blocks[i].element], elements[block.element]
            weight = NEAR * 2 / max(2, _steps(elements, blocks[i].element, block.element))
            if own.mark != other.mark:
                weight /= 8
            edges.append((i, j, round(UNIT * weight)))
        last[parent] = j
    return edges


def minimum_cut(excess: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The smallest source side of a minimum cut. ``excess`` is a node's capacity from the source less that to the sink;
    edges bind both ways. Shortest augmenting paths in layers, each edge looked at once per layering."""
    size = len(excess)
    left, heads, room, out = list(excess), [], [], [[] for _ in range(size)]
    for i, j, capacity in edges:
        out[i].append(len(heads))
        out[j].append(len(heads) + 1)
        heads += (j, i)
        room += (capacity, capacity)
    while True:
        level = [-1] * size
        queue = deque(i for i in range(size) if left[i] > 0)
        starts = list(queue)
        for i in starts:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            if left[i] < 0:
                reached = True
                continue
            for e in out[i]:
                j = heads[e]
                if room[e] and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not reached:
            return [x >= 0 for x in level]
        turn = [0] * size
        for start in starts:
            path, i = [], start
            while left[start] > 0:
                if left[i] < 0:
                    push = min(left[start], -left[i], *(room[e] for e in path))
                    left[start] -= push
                    left[i] += push
                    back = len(path)
                    for k in range(len(path) - 1, -1, -1):
                        e = path[k]
                        room[e] -= push
                        room[e ^ 1] += push
                        if not room[e]:
                            back = k
                    if left[i] == 0 or back < len(path):
                        # go on from the tail of the first full edge, or through the node that takes no more
                        if back < len(path):
                            i = heads[path[back] ^ 1]
                            del path[back:]
                    continue
                while turn[i] < len(out[i]):
                    e = out[i][turn[i]]
                    if room[e] and level[heads[e]] == level[i] + 1:
                        break
                    turn[i] += 1
                if turn[i] < len(out[i]):
                    path.append(out[i][turn[i]])
                    i = heads[path[-1]]
                elif path:
                    i = heads[path.pop() ^ 1]
                    turn[i] += 1
                else:
                    break


def label(reader: _Reader, model: np.ndarray) -> list[bool]:
    """Which blocks are main text. The cost of a label is the classifier's negative log probability of it; their difference
    is the capacity that is left of a block's two terminal edges."""
    if not reader.blocks:
        return []
    # log p - log(1 - p) is the score itself
    excess = np.rint(np.clip(features(reader) @ model, -50, 50) * UNIT).astype("int64").tolist()
    return minimum_cut(excess, smoothness(reader))


def main_text(html: str, model: np.ndarray) -> str:
    reader = _Reader(html)
    return "\n".join(b.text for b, main in zip(reader.blocks, label(reader, model)) if main)


def extract(pages: DataFrame, model: np.ndarray | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: ``page_id, url, text, n_chars``; the text is the chosen blocks in page order, one a line.

    ``model`` comes from ``train``, by default on the labelled pages of this subpackage. A page is decided in its row, so
    nothing is shuffled.

    Nulls: a null html is empty, a null id or url is kept. A page without blocks, or without main text, gives an empty text.
    Broken markup (tags, quotes, comments or entities cut short) is read to the end of the page. Pages of any length are
    read whole, in time linear in their length but for the cut. Repeated rows stay. An empty table gives an empty result.
    Columns other than the three named are not read.
    """
    weights = train() if model is None else model
    names = ["page_id", "url", "text", "n_chars"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 8 << 20):
            texts = [main_text(h, weights) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array(map(len, texts), pa.int64())], names=names)

    source = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    return source.mapInArrow(work, "page_id bigint, url string, text string, n_chars bigint")
