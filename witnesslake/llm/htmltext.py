"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes blocks of text. A logistic classifier of a block's own text (its
length, links, last mark and element) costs either label of the block, and so
does, within bounds, what the element that holds it is or is called: those are
the capacities to the two terminals. The classifier is fitted on the pages
themselves, where blocks of articles and of menus, footers and the like show
what both look like. Blocks that follow each other or share a parent are tied by
smoothness capacities, the more so the nearer they stand in the tree, and so are
all blocks of a holder, through a node of its own. The minimum cut labels all
blocks of a page at once: a short line amid an article stays and a fluent advert
goes, against their own leans, and a holder's name is outvoted where its blocks
look otherwise.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from witnesslake.llm.common import small_batches

MARKUP = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORDS = re.compile(r"[a-z]+")

# Elements by their part in a page.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = set("script style noscript template iframe textarea select svg annotation annotation-xml object canvas audio video title button datalist".split())
#: Elements that may close themselves, as may all inside them; math is read without its annotations.
FOREIGN = {"svg", "math"}
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
CLOSES = {"p": BLOCKS - {"body", "html", "head"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
BESIDE = set("nav header footer aside form dialog menu search".split())
BESIDE_ROLES = set("navigation banner contentinfo complementary form search dialog alertdialog alert menu menubar toolbar".split())
BESIDE_NAMES = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal overlay share sharing social related recommended comment comments reply replies respond disqus discussion subscribe subscription newsletter signup login search pagination pager widget copyright legal disclaimer".split())
WITHIN = {"article", "main"}
#: What a class says the element has or lacks, not is.
HAS = re.compile(r"(?:(?<=[\s_-])|^)(?:has|no|with)[_-]\S*")
WITHIN_NAMES = set("article content entry post story body text main".split())

HEADINGS, LISTED = set("h1 h2 h3 h4 h5 h6".split()), set("li dd dt td th option".split())
#: The classifier's costs are cut off here. Flows below TINY are none.
MOST, TINY = 2.0, 1e-9
#: Capacities of ties between blocks: those that follow each other, by their distance in the tree, and neighbours of one parent; steps that lie between two holders.
FOLLOWS, PARENT, BOUNDARY = 1.5, 1.0, 8
#: Weights where pages show no blocks of one kind: none, words, links, sentence, heading, list item.
DEFAULT = (-2.0, 1.0, -4.0, 0.7, 1.0, -1.0)
#: The fit: weight of all blocks of a kind, penalty and steps.
KIND_WEIGHT, RIDGE, STEPS = 100.0, 1.0, 30
#: What holds a block: nothing that says what it is, a name of text, an element of text, an element beside it, a name beside it.
NOTHING, NAMED, MAIN, BESIDE_TEXT, BESIDE_NAMED = 0, 1, 2, 3, 4


BESIDES = (BESIDE_TEXT, BESIDE_NAMED)
#: What a holder adds to the lean of each block in it, no more than looks may add; what a name beside adds where no element or name on the page says that it holds the text.
EVIDENCE, LONE_NAME = {NOTHING: 0.0, NAMED: 1.2, MAIN: 2.0, BESIDE_TEXT: -1.2, BESIDE_NAMED: -1.2}, -0.4
#: What each block adds to its holder's own capacity, the same for a name on such a page, and the capacity of a block's tie to its holder.
TRUST, LONE_TRUST, HELD = 1.5, 0.2, 2.0


@dataclass
class Block:
    text: str
    linked: float
    tag: str
    #: The innermost element, its place in Reader.above, and the holder: the element that last changed what is held.
    element: int
    holder: int
    kind: int


@dataclass
class Open:
    """An element that is not closed yet."""

    name: str
    number: int
    #: In main text by element, by name; beside it by element, by name.
    main: bool
    named: bool
    beside: bool
    by_name: bool
    holder: int
    #: The innermost block element.
    block: str

    def kind(self) -> int:
        return kind(self.main, self.named, self.beside, self.by_name)


class Reader:
    """Blocks of a page in its order; markup that isn't closed or is cut off is read as far as it goes.

    Time grows with the page alone, however deep its elements stand in each other.
    """

    def __init__(self, page: str) -> None:
        self.blocks: list[Block] = []
        #: By element its parent and depth.
        self.above, self.depth = [0], [0]
        self.stack = [Open("", 0, False, False, False, False, 0, "")]
        #: How many of each name are open.
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = 0
        at = 0
        while m := MARKUP.search(page, at):
            if m.start() > at:
                self.words(page[at : m.start()])
            at = m.end()
            if name := m["name"] or m["name2"]:
                name, rest = name.lower(), m["rest"] or m["rest2"] or ""
                if m["close"] or m["close2"]:
                    self.end(name)
                elif SELF_CLOSED.search(rest) and (name in FOREIGN or any(self.open[x] for x in FOREIGN)):
                    self.parts.append(" ")
                elif name in UNREAD:
                    found = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                    if name not in ("button", "svg", "annotation", "annotation-xml") or found:
                        at = found.end() if found else len(page)
                    self.parts.append(" ")
                else:
                    self.begin(name, rest)
        if at < len(page):
            self.words(page[at:])
        self.flush()

    def words(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if self.open["a"]:
            self.linked += len(text)

    def flush(self) -> None:
        raw, linked = "".join(self.parts), self.linked
        self.parts, self.linked = [], 0
        if text := " ".join(raw.split()):
            top = self.stack[-1]
            self.blocks.append(Block(text, linked / max(1, len(raw)), top.block, top.number, top.holder, top.kind()))

    def begin(self, name: str, rest: str) -> None:
        if name in BLOCKS:
            self.flush()
            for tag, by in CLOSES.items():
                if name in by:
                    self.shut(tag)
        elif name == "br":
            self.parts.append(" ")
        if name in VOID:
            return
        top = self.stack[-1]
        main, named, beside, by_name, within = top.main, top.named, top.beside, top.by_name, name in WITHIN
        if rest and name not in ("html", "body"):
            given = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)}
            said = f"{given.get('class', '')} {given.get('id', '')}".lower()
            hidden = given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", given.get("style", "")) or re.search(r"(?:^|\s)hidden(?:\s|/|$)", rest)
            beside = beside or bool(hidden) or bool(BESIDE_ROLES & set(given.get("role", "").lower().split()))
            by_name = by_name or (not within and bool(BESIDE_NAMES & set(WORDS.findall(HAS.sub(" ", said)))))
            named = named or bool(WITHIN_NAMES & set(WORDS.findall(said)))
            within = within or given.get("role", "").lower() in WITHIN
        # the outermost one only: articles inside the main text's comments are comments
        if within and not main:
            by_name = False
        main, beside = main or within, beside or name in BESIDE or name == "head"
        number = len(self.above)
        self.above.append(top.number)
        self.depth.append(self.depth[top.number] + 1)
        changed = kind(main, named, beside, by_name) != top.kind()
        self.stack.append(Open(name, number, main, named, beside, by_name, number if changed else top.holder, name if name in BLOCKS else top.block))
        self.open[name] += 1

    def close(self, at: int) -> None:
        for x in self.stack[at:]:
            self.open[x.name] -= 1
        del self.stack[at:]

    def shut(self, name: str) -> None:
        """Closes an open `name` in the innermost block, as its next like does."""
        for i in range(len(self.stack) - 1, 0, -1) if self.open[name] else ():
            if self.stack[i].name == name:
                self.close(i)
                return
            if self.stack[i].name in BLOCKS:
                return

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        for i in range(len(self.stack) - 1, 0, -1) if self.open[name] else ():
            if self.stack[i].name == name:
                self.close(i)
                return
            if name not in BLOCKS and self.stack[i].name in BLOCKS:
                return

    def apart(self, a: int, b: int) -> int:
        """Steps between two elements in the tree."""
        steps = 0
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a, steps = self.above[a], steps + 1
        return steps


def kind(main: bool, named: bool, beside: bool, by_name: bool) -> int:
    return BESIDE_TEXT if beside else BESIDE_NAMED if by_name else MAIN if main else NAMED if named else NOTHING


Cell = tuple[int, int, bool, bool, bool]


def cell(b: Block) -> Cell:
    """What the classifier sees of a block, in few values: its holder isn't of it."""
    return (min(14, int(2 * math.log2(2 + b.text.count(" ")))), round(4 * b.linked), b.text[-1] in ".!?…", b.tag in HEADINGS, b.tag in LISTED)


def _row(c: Cell) -> tuple[float, ...]:
    return (1.0, c[0] / 4, c[1] / 4, float(c[2]), float(c[3]), float(c[4]))


def learn(cells: dict[tuple[Cell, bool], int]) -> tuple[float, ...]:
    """Weights of a logistic regression on counted blocks of the text (True) and beside it, both kinds of equal weight."""
    of_kind = [sum(n for (_, y), n in cells.items() if y == k) for k in (False, True)]
    if not all(of_kind):
        return DEFAULT
    x = np.array([_row(c) for c, _ in cells])
    y = np.array([float(k) for _, k in cells])
    weight = np.array([KIND_WEIGHT * n / of_kind[k] for (_, k), n in cells.items()])
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve(x.T * (weight * p * (1 - p)) @ x + RIDGE * np.eye(len(w)), x.T @ (weight * (y - p)) - RIDGE * w)
    return tuple(w.tolist())


def lean(b: Block, weights: tuple[float, ...]) -> float:
    """What labelling the block as boilerplate costs more than labelling it as text: the classifier's log odds, cut off."""
    return max(-MOST, min(MOST, sum(w * v for w, v in zip(weights, _row(cell(b)), strict=True))))


def evidence(blocks: list[Block]) -> dict[int, tuple[float, float]]:
    """What each kind of holder adds to each block's lean and each block to the holder's. A name that says beside weighs less on a page where nothing else is called text."""
    out = {k: (x, math.copysign(TRUST, x)) for k, x in EVIDENCE.items()}
    return out if any(b.kind in (MAIN, NAMED) for b in blocks) else out | {BESIDE_NAMED: (LONE_NAME, -LONE_TRUST)}


def ties(read: Reader) -> list[tuple[int, int, float]]:
    """Edges between blocks: those that follow each other, by their distance in the tree, and neighbours of one parent."""
    out, last, blocks = [], {}, read.blocks
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            out.append((i - 1, i, FOLLOWS / (1 + read.apart(a.element, b.element) + BOUNDARY * (a.holder != b.holder))))
        if (before := last.get((read.above[b.element], b.holder))) is not None:
            out.append((before, i, PARENT))
        last[read.above[b.element], b.holder] = i
    return out


def graph(read: Reader, weights: tuple[float, ...]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Leans and ties of the blocks and, behind them, of their holders.

    A block leans by its looks and by what holds it. A holder is a node of its
    own, tied to all blocks in it: what it says of one block can be outvoted by
    looks, and of all by the looks of all.
    """
    blocks, said = read.blocks, evidence(read.blocks)
    leans, edges, at = [lean(b, weights) + said[b.kind][0] for b in blocks], ties(read), {}
    for i, b in enumerate(blocks):
        if b.kind != NOTHING:
            if b.holder not in at:
                at[b.holder] = len(leans)
                leans.append(0.0)
            leans[at[b.holder]] += said[b.kind][1]
            edges.append((i, at[b.holder], HELD))
    return leans, edges


def minimum_cut(leans: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for each node on the source's side of a minimum cut; of several, the one with fewest there.

    A node whose lean outweighs all its ties has its label in every minimum cut
    and passes its ties on as leans; the rest goes through max-flow.
    """
    n, leans = len(leans), list(leans)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    label: list[bool | None] = [None] * n
    ready = deque(range(n))
    while ready:
        i = ready.popleft()
        if label[i] is None and (abs(leans[i]) > sum(near[i].values()) or not near[i]):
            label[i] = leans[i] > 0
            for j, w in near[i].items():
                leans[j] += w if label[i] else -w
                del near[j][i]
                ready.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _flow([leans[i] for i in rest], _renumbered(rest, near)), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _renumbered(rest: list[int], near: list[dict[int, float]]) -> list[dict[int, float]]:
    at = {i: k for k, i in enumerate(rest)}
    return [{at[j]: w for j, w in near[i].items()} for i in rest]


def _flow(leans: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Maximum flow by blocking flows in levels; the source's side is what it still reaches."""
    n = len(leans)
    source, sink = n, n + 1
    # each edge with its reverse behind it
    to: list[int] = []
    room: list[float] = []
    edges: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        for x, y, w in ((a, b, forth), (b, a, back)):
            edges[x].append(len(to))
            to.append(y)
            room.append(w)

    for i, x in enumerate(leans):
        if x:
            join(*((source, i) if x > 0 else (i, sink)), abs(x), 0.0)
    for i, ties_of in enumerate(near):
        for j, w in ties_of.items():
            if i < j:
                join(i, j, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source], walk = 0, deque([source])
        while walk:
            i = walk.popleft()
            for e in edges[i]:
                if room[e] > TINY and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    walk.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        # every way along the levels, each dead end left once
        tried, path, at = [0] * (n + 2), [], source
        while True:
            if at == sink:
                much = min(room[e] for e in path)
                for e in path:
                    room[e] -= much
                    room[e ^ 1] += much
                full = next(k for k, e in enumerate(path) if room[e] <= TINY)
                at = to[path[full] ^ 1]
                del path[full:]
                continue
            while tried[at] < len(edges[at]) and not (room[e := edges[at][tried[at]]] > TINY and level[to[e]] == level[at] + 1):
                tried[at] += 1
            if tried[at] < len(edges[at]):
                path.append(edges[at][tried[at]])
                at = to[path[-1]]
            elif path:
                at = to[path.pop() ^ 1]
                tried[at] += 1
            else:
                break


def main_text(page: str | None, weights: tuple[float, ...] = DEFAULT) -> str:
    read = Reader(page or "")
    return "\n".join(b.text for b, k in zip(read.blocks, minimum_cut(*graph(read, weights)), strict=False) if k)


def fit(pages: DataFrame) -> tuple[float, ...]:
    """The classifier's weights, from the counts of what blocks of all pages look like inside main text and beside it."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[tuple[Cell, bool]] = Counter()
        for batch in batches:
            for page in batch["html"]:
                seen.update((cell(b), b.kind == MAIN) for b in Reader(page or "").blocks if b.kind in (MAIN, *BESIDES))
        yield pd.DataFrame([(*c, y, n) for (c, y), n in seen.items()], columns=["words", "linked", "sentence", "heading", "listed", "y", "n"])

    keys = ["words", "linked", "sentence", "heading", "listed", "y"]
    counted = pages.select("html").mapInPandas(count, "words int, linked int, sentence boolean, heading boolean, listed boolean, y boolean, n long")
    rows = counted.groupBy(*keys).agg(F.sum("n").alias("n")).orderBy(*keys).collect()  # a row a cell, of which there are a few hundred
    return learn({((r.words, r.linked, r.sentence, r.heading, r.listed), r.y): r.n for r in rows})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page's whole html.

    Null and empty html, and pages of boilerplate alone, have an empty text.
    Repeated rows stay, an empty table stays empty, other columns are ignored.
    The classifier is fitted on all pages given; where these show no main text
    or nothing beside it, fixed weights serve.
    """
    small_batches(pages.sparkSession)
    weights = fit(pages)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(lambda page: main_text(page, weights), na_action=None)

    got = pages.select("page_id", "url", text_of(F.col("html")).alias("text"))
    return got.withColumn("n_chars", F.length("text").cast("long"))
