"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text, with the elements they stand in. A block's log-odds of being content are the
capacity to the source or the sink: a logistic classifier of its text's shape and of what its elements say (signs).
Neighbours in page order and blocks that are close in the element tree are joined by smoothness edges. The minimum
cut, by maximum flow, is the cheapest labelling.

No sign decides alone, each has a bounded weight. Elements (article; nav, footer, aside, form) and names of classes and
ids speak; a name counts fully where it says nothing else (`comments`, `post-comments`), little where it is part of
another (`related-work`) or stands on a paragraph, heading or cell, and not at all as the id of a heading or where it
is about the article itself: on an element that holds all of the page's articles and at least HOLDS of its text (without
articles: MOST of its text).

The classifier is fitted in one task on a bounded sample of whole pages (about SAMPLE, those of small hashes): the weights of the shape
on blocks whose elements leave no doubt, then the weights of all signs, from PRIOR by up to BOUND, on the labels that the cut gives
the sample. Where doubtless blocks of either label are few, WITHOUT stands in for the shape.

Defined results: null or empty html, or a page without content, gives an empty text; repeated rows each give a row;
null ids and urls are carried through; other columns are ignored; an open element is closed by the end of the page, a
comment, script or style that isn't closed lasts to the end of the page; a block whose labels cost the same is
boilerplate unless its neighbours are content; formulas stay in their sentence, without their annotations.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import sampled, slices

SAMPLE, SEEDS = 1000, 20
#: Elements that don't break a line of text; that hold no text of their own; that are closed by a like one.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mfrac mi mmultiscripts mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object canvas textarea select audio video annotation annotation-xml".split())
LIKE = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Of LIKE, the elements within which a like one may stand open.
SCOPE = frozenset("ul ol dl table tbody thead tfoot div section article aside blockquote body main nav header footer form fieldset figure details".split())
#: Elements of text, on which the name of a class is rather a style.
LINES = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd tr td th pre caption figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements and roles, and words of classes and ids, that stand for boilerplate or content; words that say nothing beside those.
AWAY = frozenset("nav footer aside form menu dialog button label fieldset legend input head title option datalist".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus dropdown footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promos promotion related replies reply respond rss search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
HOME = frozenset("article main".split())
HOME_WORDS = frozenset("article entry post story".split())
BODY_WORDS = frozenset("content body text main".split())
PLAIN_WORDS = HOME_WORDS | BODY_WORDS | frozenset("area bar block bottom box button buttons col column container form global group holder icon icons inner item items left link links list lists module outer page panel posts primary reader region right row secondary section sections site slot title top user users visitor wrap wrapper".split())
#: Signs of a block, in this order, and the weights that fitting starts from.
SIGNS = ("home", "beside a home", "boilerplate element", "header", "hidden", "name", "name on a line", "part of a name", "home name", "body name")
PRIOR = np.array([3.0, -2.0, -10.0, -9.0, -14.0, -10.0, -3.0, -1.5, 2.0, 1.0])
#: How far fitting moves a sign's weight; most that the shape says either way; precision of PRIOR.
BOUND, SHAPE, TRUST = 1.5, 3.0, 0.05
HOLDS, MOST = 0.5, 0.8
NEXT_TO, NEAR, FAR = 1.0, 0.6, 0.05
#: Weights of shape() where no classifier can be fitted: longer, unlinked, punctuated text is content.
WITHOUT = np.r_[-2.5, 0.5, 0.3, -4.0, 2.0, 0.0, 1.0, 0.5, -0.5, 0.5, PRIOR]
SHAPES = len(WITHOUT) - len(PRIOR)

_tag = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
_attr = re.compile(r"""(?<!\S)(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_word = re.compile(r"[a-z]+|[A-Z][a-z]*")
_ends = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


@dataclass
class Element:
    name: str
    up: Element | None
    number: int
    #: What the element itself says: one of SIGNS each, but "beside a home".
    own: frozenset[str] = frozenset()
    #: Of its name, and those above it.
    signs: frozenset[str] = frozenset()
    chars: int = 0
    home_chars: int = 0


@dataclass
class Block:
    element: Element
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    link: float = 0.0
    signs: frozenset[str] = frozenset()


def _own(name: str, attributes: str) -> frozenset[str]:
    """Signs of an element's name and attributes."""
    found, role, hidden, tokens = set(), "", False, []
    for m in _attr.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "class" or key == "id" and name not in HEADINGS:
            tokens += value.split()
        elif key == "role":
            role = value.lower()
        elif key == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif key != "id":
            hidden |= key == "hidden" or value.lower() == "true"
    if hidden:
        found.add("hidden")
    if name in AWAY or role in AWAY_ROLES:
        found.add("boilerplate element")
    if name in HOME or role in ("main", "article"):
        found.add("home")
    if name == "header":
        found.add("header")
    for token in tokens if name not in ("html", "body") else ():
        words = {w.lower() for w in _word.findall(token)}
        says = words & (COMMENT_WORDS if name in HOME else AWAY_WORDS)
        if words == {"header"} and not says:
            found.add("header")
        if says:
            found.add("part of a name" if words - says - PLAIN_WORDS else "name on a line" if name in LINES else "name")
        elif words & HOME_WORDS:
            found.add("home name")
        elif words & BODY_WORDS:
            found.add("body name")
    return frozenset(found)


def _judge(elements: list[Element], found: list[Block]) -> None:
    """Signs of the blocks, from their elements and those above."""
    total = sum(len(b.text) for b in found)
    for x in elements:
        x.signs = x.own & {"home"} | (x.up.signs if x.up else frozenset())
    for b in found:
        b.element.chars += len(b.text)
        b.element.home_chars += len(b.text) if b.element.signs else 0
    for x in reversed(elements):
        if x.up:
            x.up.chars += x.chars
            x.up.home_chars += x.home_chars
    homes = elements[0].home_chars
    for x in elements:
        own = x.own
        if "name" in own and "home" not in own and x.home_chars == homes and x.chars >= (HOLDS if homes else MOST) * total:
            own -= {"name"}
        above = x.up.signs if x.up else frozenset()
        if "header" in own and ("home" in above or own & {"home", "home name"}):
            own -= {"header"}
        x.signs = above | own
    for b in found:
        b.signs = b.element.signs | ({"beside a home"} if homes and "home" not in b.element.signs else set())


def blocks(page: str | None) -> list[Block]:
    """Blocks that have text, in page order."""
    out: list[Block] = []
    if not page:
        return out
    root = Element("", None, 0)
    top, elements, links = root, [root], 0
    current = Block(root)

    def text(piece: str) -> None:
        if piece:
            current.pieces.append(piece)
            if links:
                current.linked += len(piece)

    def close() -> None:
        nonlocal current
        raw = "".join(current.pieces)
        if raw and not raw.isspace():
            current.text = " ".join(entities.unescape(raw).split())
            current.link = min(1.0, current.linked / max(1, len(raw)))
            if current.text:
                out.append(current)
        current = Block(top)

    at, end = 0, len(page)
    while at < end:
        m = _tag.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name == "a":
                links = max(0, links - 1)
            elif name not in INLINE:
                x = top
                while x.up and x.name != name:
                    x = x.up
                if x.up:
                    top, links = x.up, 0
                    close()
            continue
        if name in RAW:
            over = _ends[name].search(page, at)
            at = over.end() if over else end
            continue
        if name == "br" or name == "wbr":
            text(" " if name == "br" else "")
            continue
        if name in INLINE:
            links += name == "a"
            continue
        links = 0
        if top.name == "head" and name not in VOID and name != "title" or name == "body":
            while top.up and top.name in ("head", "title"):
                top = top.up
        if name in LIKE:
            x = top
            while x.up and x.name not in LIKE[name] and x.name not in SCOPE:
                x = x.up
            if x.name in LIKE[name]:
                top = x.up
        elif top.name == "p" and name not in VOID:
            top = top.up
        if name not in VOID:
            top = Element(name, top, len(elements), _own(name, m[3] or m[6] or ""))
            elements.append(top)
        close()
    close()
    _judge(elements, out)
    return out


def shape(b: Block) -> list[float]:
    t, name = b.text, b.element.name
    words = t.count(" ") + 1
    marks = sum(map(t.count, ".,;:!?"))
    return [1.0, np.log1p(len(t)), np.log1p(words), b.link, marks / words, len(t) / words / 10, float(t[-1] in ".!?\"'…"), float(name[:1] == "h" and name[1:].isdigit()), float(name == "li"), float(name == "p")]


def described(found: list[Block]) -> np.ndarray:
    """(blocks, shape and signs)."""
    return np.array([shape(b) + [float(x in b.signs) for x in SIGNS] for b in found]).reshape(len(found), len(WITHOUT))


def smoothness(found: list[Block]) -> dict[tuple[int, int], float]:
    """Weights between neighbours in page order (FAR where they share no near element) and between blocks close in the element tree."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, tuple[int, int]] = {}
    for i, b in enumerate(found):
        near = 0.0 if i and found[i - 1].element is not b.element else NEXT_TO
        x, step = b.element, 0
        while x and step < 3:  # the last block under the parent, and the parents above
            x, step = x.up, step + 1
            if x is not None:
                j, below = last.get(x.number, (-1, 0))
                if j >= 0:
                    # A block of another depth is rather of another part of the page.
                    apart = max(step, below) * (1 + abs(step - below)) ** 2
                    edges[j, i] = edges.get((j, i), 0.0) + NEAR / apart
                    if j == i - 1:
                        near = max(near, NEXT_TO / apart)
                last[x.number] = (i, step)
        if i:
            edges[i - 1, i] = edges.get((i - 1, i), 0.0) + max(near, FAR)
    return edges


def scores(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip(x[:, :SHAPES] @ weights[:SHAPES], -SHAPE, SHAPE) + x[:, SHAPES:] @ weights[SHAPES:]


def _newton(x: np.ndarray, label: np.ndarray, start: np.ndarray, trust: float, weight: np.ndarray, offset: np.ndarray | float = 0.0) -> np.ndarray:
    """Regularised logistic weights; the regulariser draws them to where they start."""
    w = start.copy()
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w + offset, -30, 30)))
        slope = x.T @ (weight * (p - label)) + trust * (w - start)
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + trust * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    return w


def fit(pages: list[tuple[np.ndarray, dict[tuple[int, int], float]]]) -> np.ndarray:
    """Described blocks and smoothness of pages → weights."""
    weights = WITHOUT.copy()
    if not sum(len(x) for x, _ in pages):
        return weights
    x = np.concatenate([x for x, _ in pages])
    of = {name: x[:, SHAPES + i] > 0 for i, name in enumerate(SIGNS)}
    away = of["boilerplate element"] | of["header"] | of["hidden"]
    named = of["name"] | of["name on a line"] | of["part of a name"]
    plain = (away | of["home"] & ~named) & ~(away & of["home"])
    n = np.array([(plain & ~away).sum(), (plain & away).sum()])
    if n.min() >= SEEDS:
        label = ~away[plain]
        weights[:SHAPES] = _newton(x[plain, :SHAPES], label.astype(float), np.zeros(SHAPES), 0.01, np.where(label, 0.5 / n[0], 0.5 / n[1]))
    for _ in range(2):
        label = np.concatenate([minimum_cut(scores(own, weights).tolist(), edges) for own, edges in pages if len(own)])
        says = np.clip(x[:, :SHAPES] @ weights[:SHAPES], -SHAPE, SHAPE)
        w = _newton(x[:, SHAPES:], label.astype(float), PRIOR, TRUST, np.full(len(x), 1 / len(x)), says)
        weights[SHAPES:] = np.clip(w, PRIOR - BOUND, PRIOR + BOUND)
    return weights


def minimum_cut(score: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels of least cost: True costs -score where negative, False score where positive, each edge its weight where its ends differ. Maximum flow by levels."""
    n = len(score)
    if all(s > 0 for s in score) or all(s <= 0 for s in score):
        return [s > 0 for s in score]
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    of: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, forth: float, back: float) -> None:
        of[a].append(len(to))
        of[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for (a, b), w in edges.items():
        add(a, b, w, w)
    for i, s in enumerate(score):
        add(source, i, s, 0.0) if s > 0 else add(i, sink, -s, 0.0)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in of[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        next_ = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            own = of[a]
            while next_[a] < len(own):
                e = own[next_[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                next_[a] += 1
            if next_[a] < len(own):
                path.append(own[next_[a]])
                a = to[path[-1]]
            elif a == source:
                break
            else:
                back = path.pop()
                a = to[back ^ 1]
                next_[a] += 1


def label(found: list[Block], weights: np.ndarray) -> list[bool]:
    return minimum_cut(scores(described(found), weights).tolist(), smoothness(found))


def main_text(page: str | None, weights: np.ndarray) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, label(found, weights)) if keep)


def learn(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """Weights from a bounded sample of the pages: each is described where it lies, the descriptions go to one task, and the driver gets the weights."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            rows = []
            for page in b.column("html").to_pylist():
                found = blocks(page)
                edges = smoothness(found)
                rows.append((described(found).astype("<f4").tobytes(), np.array(list(edges), "<i4").tobytes(), np.array(list(edges.values()), "<f8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], ["x", "ends", "w"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pages = []
        for x, ends, w in sorted(zip(pdf.x, pdf.ends, pdf.w)):
            edges = dict(zip(map(tuple, np.frombuffer(ends, "<i4").reshape(-1, 2).tolist()), np.frombuffer(w, "<f8").tolist()))
            pages.append((np.frombuffer(x, "<f4").reshape(-1, len(WITHOUT)).astype(float), edges))
        return pd.DataFrame({"w": [fit(pages).tolist()]})

    usable = pages.filter(F.col(html).isNotNull()).select(F.col(html).alias("html"))
    rows = sampled(usable, ["html"], sample).mapInArrow(describe, "x binary, ends binary, w binary")
    got = rows.groupBy().applyInPandas(run, "w array<double>").collect()
    return np.array(got[0].w) if got else WITHOUT


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), sample: int = SAMPLE) -> DataFrame:
    """pages → keep..., text, n_chars."""
    weights = learn(pages, html, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__html"):
            found = [main_text(p, weights) for p in b.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], [*keep, "text", "n_chars"])

    types = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, F.col(html).alias("__html")).mapInArrow(run, f"{types}, text string, n_chars long")
