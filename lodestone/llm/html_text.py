"""Main text of web pages by minimum cut.

A page's text is cut into blocks at block-level tags. A classifier's costs of calling a block content or boilerplate are its terminal
capacities; neighbouring blocks, and blocks and the elements they stand in, are joined by smoothness edges that
weigh more the closer they are in the document tree. The maximum flow's cut labels all blocks of the page at once.

The classifier starts from fixed weights and is trained here, on pages that mark their article themselves (bounded sample); the
marks are hidden from half of its training rows, so that pages without them are judged by the rest.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

#: Pages that the classifier is trained on, at most.
TRAIN_PAGES = 400

# Names of elements and words in class, id and role attributes.
RAW = "script style noscript template textarea title xmp"
SKIP = "svg math iframe object select button"
BLOCK = "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul"
VOID = "area base br col embed hr img input link meta param source track wbr"
BAD = "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login search nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget widgets related recommended recommendations share sharing social footer masthead toolbar pagination pager comment comments disqus reply replies respond discussion copyright legal skip complementary contentinfo"
GOOD = "article content main post entry story body text page"

_RAW, _SKIP, _BLOCK, _VOID, _BAD, _GOOD = (frozenset(x.split()) for x in (RAW, SKIP, BLOCK, VOID, BAD, GOOD))
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(sorted(_RAW, key=len, reverse=True)) + r")\b(?P<rawattr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>(?:.*?(?:</(?P=raw)\s*+[^>]*>|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_REGION = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "dialog": "aside", "article": "article", "main": "article"}
FEATURES = ("one", "chars", "links", "heading", "paragraph", "item", "article", "nav", "header", "footer", "aside", "form", "bad", "good", "sentence", "words")
# Weights before training.
PRIOR = (-0.5, 0.35, -4.0, 0.4, 0.8, -0.3, 3.0, -5.0, -3.0, -5.0, -4.0, -5.0, -6.0, 0.8, 0.8, 0.6)
NEAR, APART, INSIDE, ABOVE = 0.5, 0.08, 0.3, 0.15


class Block:
    __slots__ = ("linked", "node", "regions", "tag", "text")

    def __init__(self, text, linked, tag, node, regions):
        self.text, self.linked, self.tag, self.node, self.regions = text, linked, tag, node, regions


def _skipped(tokens: list[tuple[str, bool, bool]]) -> dict[int, tuple[int, bool]]:
    """Token (name, whether it closes, whether it closes itself) that opens an element without text of the page -> the first token
    after it that counts again, and whether its own end tag is right before that: if there is none, or the elements around it or the
    next of its kind end it first, the next block-level tag ends it."""
    out: dict[int, tuple[int, bool]] = {}
    open_: list[list] = []
    count: dict[str, int] = {}
    for i, (name, close, alone) in enumerate(tokens):
        if close:
            if count.get(name):
                while True:
                    top, at = open_.pop()
                    count[top] -= 1
                    if top == name:
                        break
                if name in _SKIP:
                    out[at] = (i + 1, True)
        elif name in _SKIP:
            if alone and name in ("svg", "math"):
                out[i] = (i + 1, True)
                continue
            if name in ("select", "button") and count.get(name):  # these don't nest
                last = next(x for x in reversed(open_) if x[0] == name)
                last[0] = ""
                count[name] -= 1
                count[""] = count.get("", 0) + 1
            open_.append([name, i])
            count[name] = count.get(name, 0) + 1
        elif name in _BLOCK and name not in ("br", "hr", "option"):
            open_.append([name, i])
            count[name] = count.get(name, 0) + 1
    after = len(tokens)
    for i in range(len(tokens) - 1, -1, -1):
        name = tokens[i][0]
        if name in _SKIP and not tokens[i][1]:
            out.setdefault(i, (after, False))
        if name in _BLOCK and name != "option":
            after = i
    return out


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """(blocks in page order, parent of each container node). Elements left open and pages cut short are taken as they stand."""
    out: list[Block] = []
    parents = [-1]
    none: frozenset = frozenset()
    stack: list[tuple[str, int, frozenset]] = [("", 0, none)]
    buffer: list[str] = []
    links, linked, at = 0, 0, 0

    def put(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            buffer.append(text)
            if links:
                linked += len(text)

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                tag, node, regions = stack[-1]
                out.append(Block(text, min(1.0, linked / max(1, len(text))), tag, node, regions))
            buffer.clear()
            linked = 0

    found = list(_TOKEN.finditer(page))
    tokens = [((m["name"] or "").lower(), bool(m["close"]), bool(m["attr"]) and m["attr"].endswith("/")) for m in found]
    skipped = _skipped(tokens) if any(name in _SKIP for name, _, _ in tokens) else {}
    resume = 0
    for i, m in enumerate(found):
        if i < resume:
            continue
        put(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if i in skipped:
            put(" ")
            resume, ended = skipped[i]
            at = found[resume - 1].end() if ended else found[resume].start() if resume < len(found) else len(page)
            continue
        if name is None:
            if m["raw"] is not None:
                put(" ")
            continue
        name = name.lower()
        if m["close"]:
            if name == "a":
                links = max(0, links - 1)
            elif name in _BLOCK and name != "br":
                flush()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
        elif name == "a":
            links = 1
        elif name in _BLOCK:
            flush()
            if name in ("br", "hr"):
                continue
            links = 0 if name in ("p", "div", "article", "section", "main") else links
            top = stack[-1][0]
            if top == "p" or (name == "li" and top == "li") or (name in _HEADING and top in _HEADING):
                stack.pop()
            regions = stack[-1][2]
            region = _REGION.get(name)
            words = set()
            for a in _ATTR.findall(m["attr"]) if m["attr"] else ():
                words.update(_WORD.findall("".join(a).lower()))
            if region == "header" and "article" in regions:
                region = None
            add = {region} if region else set()
            if words & _BAD:
                add.add("bad")
            elif words & _GOOD:
                add.add("good")
            if add:
                regions = regions | add
            parents.append(stack[-1][1])
            stack.append((name, len(parents) - 1, regions))
    put(page[at:])
    flush()
    return out, parents


def features(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), len(FEATURES)))
    for i, b in enumerate(found):
        n, r, words = len(b.text), b.regions, b.text.count(" ") + 1
        x[i] = (1, np.log1p(min(n, 2000)) - 3, b.linked, b.tag in _HEADING, b.tag in ("p", "blockquote", "pre"), b.tag in ("li", "dd", "td"), "article" in r, "nav" in r, "header" in r, "footer" in r, "aside" in r, "form" in r, "bad" in r, "good" in r, b.text[-1] in ".!?\"”»…", words >= 8)
    return x


def train(pages: list[str]) -> np.ndarray:
    """Weights: logistic regression held towards PRIOR. Blocks of pages that mark an article are content if inside it and in no
    region of another kind. Without such pages PRIOR itself."""
    prior = np.array(PRIOR)
    rows, labels = [], []
    for page in pages:
        found, _ = blocks(page)
        if any("article" in b.regions for b in found):
            x = features(found)
            y = x[:, 6] * (x[:, 7:13].sum(axis=1) == 0)
            hidden = x.copy()
            hidden[:, 6] = 0
            rows += [x, hidden]
            labels += [y, y]
    if not rows:
        return prior
    x, y = np.concatenate(rows), np.concatenate(labels)
    w, scale = prior.copy(), 20.0 / len(x)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(x) + scale * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + scale * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


FREE, SOURCE, SINK = 0, 1, -1
#: Parents that are no arcs: the terminal itself, and none while another one is looked for.
ROOT, ORPHAN = -1, -2


class Flow:
    """Maximum flow between the nodes with something left over (extra > 0) and those that lack something (extra < 0), by two search trees that are kept from one
    path to the next: a tree grows from either terminal, where they meet flow is pushed, and only what hangs on a filled arc looks for another parent. So a page of many
    blocks is not searched anew for each path."""

    def __init__(self, extra: list[float], edges: list[tuple[int, int, float]]) -> None:
        n = len(extra)
        self.extra = extra
        self.head: list[int] = []
        self.room: list[float] = []  # of arc a; its reverse is a ^ 1
        self.arcs: list[list[int]] = [[] for _ in range(n)]
        for i, j, w in edges:
            if i != j:
                self.arcs[i].append(len(self.head))
                self.arcs[j].append(len(self.head) + 1)
                self.head += [j, i]
                self.room += [w, w]
        self.eps = 1e-12
        self.tree = [SOURCE if x > self.eps else SINK if x < -self.eps else FREE for x in extra]
        self.parent = [ROOT] * n  # arc from the node to its parent
        self.active = deque(i for i in range(n) if self.tree[i] != FREE)
        self.orphans: deque[int] = deque()
        self.seen, self.depth, self.time = [0] * n, [0] * n, 0

    def run(self) -> list[bool]:
        """Whether the source still reaches each node."""
        while self.active:
            p = self.active[0]
            met = self._grow(p) if self.tree[p] != FREE else None
            if met is None:
                self.active.popleft()
                continue
            self.time += 1
            self._push(met)
            while self.orphans:
                self._adopt(self.orphans.popleft())
        return [t == SOURCE for t in self.tree]

    def _grow(self, p: int) -> int | None:
        """An arc from the source's tree to the sink's, if p's neighbours have one; free neighbours join p's tree."""
        tree, room, head, side = self.tree, self.room, self.head, self.tree[p]
        for a in self.arcs[p]:
            if (room[a] if side == SOURCE else room[a ^ 1]) <= self.eps:
                continue
            q = head[a]
            if tree[q] == FREE:
                tree[q], self.parent[q] = side, a ^ 1
                self.seen[q], self.depth[q] = self.seen[p], self.depth[p] + 1
                self.active.append(q)
            elif tree[q] != side:
                return a if side == SOURCE else a ^ 1
            elif self.seen[q] <= self.seen[p] and self.depth[q] > self.depth[p] + 1 and self.parent[q] >= 0:
                self.parent[q], self.seen[q], self.depth[q] = a ^ 1, self.seen[p], self.depth[p] + 1  # a shorter way to the root
        return None

    def _push(self, met: int) -> None:
        head, room, parent = self.head, self.room, self.parent
        up, down = [], []  # arcs from the source's root to the meeting arc, and on to the sink's root
        v = head[met ^ 1]
        while parent[v] >= 0:
            up.append(parent[v] ^ 1)
            v = head[parent[v]]
        start, v = v, head[met]
        while parent[v] >= 0:
            down.append(parent[v])
            v = head[parent[v]]
        flow = min(self.extra[start], -self.extra[v], room[met], *[room[a] for a in up], *[room[a] for a in down])
        for a in (met, *up, *down):
            room[a] -= flow
            room[a ^ 1] += flow
        for a in up:
            if room[a] <= self.eps:
                self._orphan(head[a])
        for a in down:
            if room[a] <= self.eps:
                self._orphan(head[a ^ 1])
        self.extra[start] -= flow
        self.extra[v] += flow
        for root in (start, v):
            if abs(self.extra[root]) <= self.eps:
                self._orphan(root)

    def _orphan(self, v: int) -> None:
        if self.parent[v] != ORPHAN:
            self.parent[v] = ORPHAN
            self.orphans.append(v)

    def _rooted(self, v: int) -> int:
        """Steps from v to its terminal, or -1 if v hangs on an orphan; what is found is noted for this time."""
        path, parent, head = [], self.parent, self.head
        while self.seen[v] != self.time:
            path.append(v)
            if parent[v] == ORPHAN:
                return -1
            if parent[v] == ROOT:
                self.seen[v], self.depth[v] = self.time, 0
                path.pop()
                break
            v = head[parent[v]]
        steps = self.depth[v]
        for x in reversed(path):
            steps += 1
            self.seen[x], self.depth[x] = self.time, steps
        return steps

    def _adopt(self, v: int) -> None:
        side, best, steps = self.tree[v], None, 1 << 60
        for a in self.arcs[v]:
            q = self.head[a]
            if self.tree[q] == side and (self.room[a ^ 1] if side == SOURCE else self.room[a]) > self.eps and self.parent[q] != ORPHAN:
                d = self._rooted(q)
                if 0 <= d < steps:
                    best, steps = a, d
        if best is not None:
            self.parent[v], self.seen[v], self.depth[v] = best, self.time, steps + 1
            return
        for a in self.arcs[v]:
            q = self.head[a]
            if self.tree[q] == side:
                if (self.room[a ^ 1] if side == SOURCE else self.room[a]) > self.eps:
                    self.active.append(q)
                if self.parent[q] == a ^ 1:
                    self._orphan(q)
        self.tree[v], self.parent[v] = FREE, ROOT


#: Arcs of a node at most; one with more (a container of many blocks) becomes a tree of such nodes, whose arcs no cut can afford, so cuts stay the same.
WIDE = 8


def _split(n: int, edges: list[tuple[int, int, float]]) -> tuple[int, list[tuple[int, int, float]]]:
    """The same graph with WIDE arcs a node at most; added nodes come behind the n."""
    hangs: list[list[int]] = [[] for _ in range(n)]
    for k, (i, j, _) in enumerate(edges):
        if i != j:
            hangs[i].append(k)
            hangs[j].append(k)
    ends = [[i, j, w] for i, j, w in edges]
    never = 1.0 + sum(w for _, _, w in edges)
    for v in range(n):
        if len(hangs[v]) <= WIDE:
            continue
        level = []
        for a in range(0, len(hangs[v]), WIDE):
            for k in hangs[v][a : a + WIDE]:
                ends[k][0 if ends[k][0] == v else 1] = n
            level.append(n)
            n += 1
        while len(level) > WIDE:
            above = []
            for a in range(0, len(level), WIDE):
                ends += [[x, n, never] for x in level[a : a + WIDE]]
                above.append(n)
                n += 1
            level = above
        ends += [[x, v, never] for x in level]
    return n, [tuple(e) for e in ends]


def min_cut(content: list[float], boiler: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) that minimise the sum of the costs of the labels and the weights of edges between different labels; of several such labellings that with
    the fewest True.

    content[i] is the cost of calling i content. Maximum flow; what the source still reaches is content.
    """
    nodes, edges = _split(len(content), edges)
    # the flow source -> i -> sink is taken at once; what is left stands on one side
    extra = [b - c for c, b in zip(content, boiler, strict=True)]
    return Flow(extra + [0.0] * (nodes - len(extra)), edges).run()[: len(content)]


def label(found: list[Block], parents: list[int], p: np.ndarray) -> list[bool]:
    """Nodes: the blocks, then the containers they stand in (no cost of their own)."""
    if not found:
        return []
    n = len(found)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    content, boiler = (-np.log(p)).tolist(), (-np.log(1 - p)).tolist()
    place: dict[int, int] = {}
    joined: set[int] = set()
    edges: list[tuple[int, int, float]] = []

    def node(c: int) -> int:
        first = place.setdefault(c, n + len(place))
        while parents[c] > 0:  # containers join the one that they stand in, once each
            above, new = parents[c], parents[c] not in place
            if c not in joined:
                joined.add(c)
                edges.append((place[c], place.setdefault(above, n + len(place)), ABOVE))
            if not new:
                break
            c = above
        return first

    above = [parents[b.node] for b in found]
    for i, b in enumerate(found):
        edges.append((i, node(max(above[i], 0)), INSIDE))
        if i:
            edges.append((i - 1, i, NEAR if above[i - 1] == above[i] else APART))
        del b
    m = n + len(place)
    return min_cut(content + [0.0] * (m - n), boiler + [0.0] * (m - n), edges)[:n]


def main_text(page: str, weights: np.ndarray) -> str:
    found, parents = blocks(page)
    if not found:
        return ""
    p = 1 / (1 + np.exp(-np.clip(features(found) @ weights, -30, 30)))
    return " ".join(b.text for b, keep in zip(found, label(found, parents, p), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars. White space inside a block is one space, blocks are joined by one in page order.

    Null and empty pages give an empty text; character references are decoded, unknown ones stay. Repeated rows are kept, extra columns not read; an
    empty table gives no rows.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html")
    total = max(1, rows.count())
    some = rows.where(F.pmod(F.xxhash64(F.lit("pages"), "page_id"), F.lit(1 << 30)) < min(1 << 30, int(0.8 * TRAIN_PAGES / total * (1 << 30)))) if total > TRAIN_PAGES else rows
    weights = spark.sparkContext.broadcast(train([r.html for r in some.where("html is not null").limit(TRAIN_PAGES).collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(t or "", weights.value) for t in b.column(2).to_pylist()]
            yield batch({"page_id": b.column(0), "url": b.column(1), "text": pa.array(text, pa.string()), "n_chars": pa.array([len(t) for t in text], pa.int64())})

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
