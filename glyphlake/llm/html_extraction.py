"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into leaf blocks: runs of text between block-level tags. A block's features are its ancestors'
tags and the words of their class and id attributes, its length, link share and punctuation. The field has two
labels, text and boilerplate, and learned transitions; it is fitted on the driver to labelled pages and decoded
by Viterbi on the executors. The labelled pages are written by `labelled_pages` from layouts with known text,
for the tables hold no labels; `extract` takes other labelled pages just as well.
"""

from __future__ import annotations

import html as html_lib
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_of
from .language_id import forward_backward

WIDTH = 1 << 13
PAGES, STEPS = 500, 60
#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template textarea svg iframe title".split())
#: Those that hold markup: where one is never closed, its tag alone is left out. The others run to the end of the page.
MARKUP = frozenset("noscript template svg".split())
BLOCK = frozenset(
    "html head body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main nav header footer aside form fieldset legend label button select option blockquote pre figure figcaption address details summary dialog hr menu center".split()
)
VOID = frozenset("hr br img input meta link wbr source track area base col embed param".split())
TAG = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
NAME = re.compile(r"""(?i)(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORDS = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")


#: The rest of a tag. A ">" inside a quoted attribute value does not end it; quotes elsewhere are no quotes.
REST = re.compile(r"""((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")


class Place:
    """An open element: a node of the tree of element paths, which pages share. It keeps only what it adds to its parent."""

    __slots__ = ("parent", "tag", "own", "mark", "added", "children", "score")

    def __init__(self, parent: Place | None, tag: str, own: tuple[str, ...], mark: str, added: list[str]):
        self.parent, self.tag, self.own, self.mark, self.added = parent, tag, own, mark, added
        self.children: dict[tuple, Place] = {}
        self.score: tuple[float, float] | None = None

    def path(self) -> list[Place]:
        out, at = [], self
        while at.parent:
            out.append(at)
            at = at.parent
        return out[::-1]


@dataclass
class Block:
    text: str
    place: Place
    linked: int

    @property
    def mark(self) -> str:
        return self.place.mark

    @property
    def tags(self) -> list[str]:
        return [x.tag for x in self.place.path()]


class Paths:
    """The root of the tree, and how many nodes it has got."""

    def __init__(self):
        self.root, self.size = Place(None, "", (), "", []), 0


@dataclass
class _Reader:
    paths: Paths
    blocks: list[Block] = field(default_factory=list)
    stack: list[Place] = field(default_factory=list)
    #: Where in the stack each tag is open, and how many open elements have a feature.
    places: dict[str, list[int]] = field(default_factory=dict)
    features: dict[str, int] = field(default_factory=dict)
    held: list[str] = field(default_factory=list)
    linked: int = 0
    link: bool = False

    def text(self, raw: str) -> None:
        if raw:
            plain = html_lib.unescape(raw) if "&" in raw else raw
            self.held.append(plain)
            if self.link:
                self.linked += len(plain)

    def top(self) -> Place:
        return self.stack[-1] if self.stack else self.paths.root

    def flush(self) -> None:
        if self.held:
            text = SPACES.sub(" ", "".join(self.held)).strip()
            if text:
                self.blocks.append(Block(text, self.top(), min(self.linked, len(text))))
            self.held, self.linked = [], 0

    def open(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.link = True
        elif tag == "br":
            self.held.append(" ")
        elif tag in BLOCK:
            self.flush()
            self.link = False
            closes = {"p": ("p",), "li": ("li", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th"), "dt": ("dd", "dt", "p"), "dd": ("dd", "dt", "p"), "option": ("option",)}.get(tag, ("p",))
            while self.stack and self.stack[-1].tag in closes:
                self.cut(len(self.stack) - 1)
            if tag not in VOID and not attributes.endswith("/"):
                lower = attributes.lower()
                names = [w for m in NAME.finditer(attributes) for w in WORDS.findall((m[1] or m[2] or m[3] or "").lower())] if "class" in lower or "id" in lower or "role" in lower else []
                mark = re.search(r'data-label="(\w+)"', attributes)
                self.places.setdefault(tag, []).append(len(self.stack))
                self.push(tag, tuple(dict.fromkeys(names)), mark[1] if mark else "")

    def close(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        elif tag in BLOCK:
            self.flush()
            if self.places.get(tag):
                self.cut(self.places[tag][-1])

    def push(self, tag: str, own: tuple[str, ...], mark: str) -> None:
        parent, mine = self.top(), _place_names(tag, own)
        place = parent.children.get((tag, own, mark))
        if place is None:
            place = parent.children[tag, own, mark] = Place(parent, tag, own, mark or parent.mark, [f for f in mine if not self.features.get(f)])
            self.paths.size += 1
        for f in mine:
            self.features[f] = self.features.get(f, 0) + 1
        self.stack.append(place)

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            place = self.stack.pop()
            self.places[place.tag].pop()
            for f in _place_names(place.tag, place.own):
                self.features[f] -= 1


def _place_names(tag: str, own: tuple[str, ...]) -> list[str]:
    return [f"in:{tag}", *(f"name:{w}" for w in own)]


def leaf_blocks(page: str, paths: Paths | None = None) -> list[Block]:
    """The leaf blocks in page order, in one pass; broken markup never fails."""
    r, at, n = _Reader(paths or Paths()), 0, len(page)
    unclosed: set[str] = set()  # tags that nothing closes further on, so that they are looked for once
    while at < n:
        m = TAG.search(page, at)
        if not m:
            r.text(page[at:])
            break
        r.text(page[at : m.start()])
        if m[0] in ("<!--", "<![CDATA["):
            stop = page.find("-->" if m[0] == "<!--" else "]]>", m.end())
            at = n if stop < 0 else stop + 3
            continue
        if m[2] is None:
            stop = page.find(">", m.end())
            if stop < 0:
                break
            at = stop + 1
            continue
        rest = REST.match(page, m.end())
        stop = rest.end() - 1 if rest else page.find(">", m.end())
        if stop < 0:
            break
        attributes = page[m.end() : stop]
        at, tag = stop + 1, m[2].lower()
        if m[1]:
            r.close(tag)
        elif tag in RAW:
            if not attributes.endswith("/") and tag not in unclosed:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if end or tag not in MARKUP:
                    at = end.end() if end else n
                else:
                    unclosed.add(tag)
            if tag == "textarea":
                r.flush()
        else:
            r.open(tag, attributes)
    r.flush()
    return r.blocks


def here_features(place: Place) -> list[str]:
    """What the innermost element says, beside what all open ones do."""
    return ["bias", f"leaf:{place.tag}", *(f"own:{w}" for w in place.own)]


def place_features(place: Place) -> list[str]:
    """What a block's place in the page says; equal for all blocks in one element."""
    return [*here_features(place), *(f for x in place.path() for f in x.added)]


def own_features(b: Block, first: bool) -> list[str]:
    words = b.text.count(" ") + 1
    return [
        f"size{min(words.bit_length(), 7)}",
        f"link{round(4 * b.linked / len(b.text))}",
        "end." if b.text[-1] in ".!?…»\"”" else "end-",
        "first" if first else "later",
        "c" if "©" in b.text else "-",
    ]


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % WIDTH


def page_features(blocks: list[Block]) -> tuple[list[int], list[int]]:
    """Hashed features of all blocks, and how many each block has."""
    ids, sizes = [], []
    for i, b in enumerate(blocks):
        f = place_features(b.place) + own_features(b, i == 0)
        ids += map(slot, f)
        sizes.append(len(f))
    return ids, sizes


#: Layout names that the labelled pages use.
LAYOUT = {
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs topnav links tabs pagination pager toc",
    "header": "header head masthead top branding site logo topbar",
    "footer": "footer foot bottom copyright legal colophon",
    "aside": "sidebar aside related widget recommended trending popular tags rail side secondary complementary",
    "ad": "ad ads advert advertisement banner promo sponsor sponsored promotion adsense commercial",
    "notice": "cookie notice consent gdpr alert newsletter subscribe popup modal overlay warning disclaimer paywall signup",
    "comments": "comments comment replies reply discussion disqus respond thread reader",
    "form": "search form login contact signup poll survey",
    "share": "share social follow buttons toolbar author meta byline",
    "text": "content article post entry main story body text page blog news container wrapper",
}


def labelled_pages(n: int = PAGES, seed: int = 11) -> Iterator[str]:
    """Pages in many layouts; every element that decides a label carries it in data-label (text or other)."""
    rng = random.Random(seed)
    names = {k: v.split() for k, v in LAYOUT.items()}
    word = lambda: "".join(rng.choice("bcdfghlmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: (phrase(1, 1) if rng.random() < 0.15 else phrase(3, 18)).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])
    prose = lambda: " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 4, 8])))
    links = lambda k: "".join(f'<li><a href="/{word()}">{phrase(1, 3)}</a></li>' for _ in range(k))

    def box(kind: str, inner: str, label: str = "other") -> str:
        tag = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div"], "form": ["form", "div"], "comments": ["section", "div", "ol"], "text": ["article", "main", "section", "div"]}.get(kind, ["div", "div", "section", "p", "span"])
        tag = rng.choice(tag)
        bare = tag in ("nav", "header", "footer", "aside", "form", "article", "main") and rng.random() < 0.5
        name = "" if bare else f' {rng.choice(["class", "id", "class"])}="{rng.choice(names[kind])}{rng.choice(["", "-" + rng.choice(["box", "inner", "area", "block", "wrap", "list"])])}"'
        return f'<{"div" if tag == "span" else tag}{name} data-label="{label}">{inner}</{"div" if tag == "span" else tag}>'

    for _ in range(n):
        short = lambda: rng.choice([phrase(1, 6), prose(), f'<a href="/">{phrase(1, 5)}</a>', f"<p>{prose()}</p>", f"<h3>{phrase(1, 4)}</h3><ul>{links(rng.randint(1, 5))}</ul>"])
        text = [f"<h1>{phrase(1, 9)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 12)):
            text.append(rng.choice([f"<p>{prose()}</p>"] * 6 + [f"<p><b>{prose()}<br>", f"<h2>{phrase(1, 6)}</h2>", f"<ul><li>{sentence()}</li><li>{phrase(1, 5)}</li></ul>", f"<blockquote>{prose()}</blockquote>", f"<p>{sentence()} <a href='/x'>{phrase(1, 3)}</a> {sentence()}</p>", f"<table><tr><td>{phrase(1, 3)}</td><td>{phrase(1, 3)}</td></tr></table>", f"<pre>{prose()}</pre>"]))
            if rng.random() < 0.12:
                text.append(box(rng.choice(["ad", "share", "notice", "aside"]), short()))
        if rng.random() < 0.3:
            text.append(box("comments", "".join(f"<p>{prose()}</p>" for _ in range(rng.randint(1, 4)))))
        page = [box("text", "".join(text), "text")]
        before = [box("nav", f"<ul>{links(rng.randint(1, 8))}</ul>")] * (rng.random() < 0.8) + [box("header", short())] * (rng.random() < 0.5)
        after = [box("footer", rng.choice(["&copy; ", ""]) + short())] * (rng.random() < 0.9) + [box("comments", "".join(f"<div class='{rng.choice(names['comments'])}'><p>{prose()}</p></div>" for _ in range(rng.randint(1, 5))))] * (rng.random() < 0.3)
        for _ in range(rng.randint(0, 4)):
            rng.choice([before, after]).append(box(rng.choice(["ad", "notice", "aside", "form", "share"]), short()))
        rng.shuffle(before), rng.shuffle(after)
        yield f'<html><head><title>{phrase(1, 5)}</title></head><body data-label="other">{"".join(before + page + after)}</body></html>'


def fit(pages: Iterable[str], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x labels) and transitions, from pages whose elements carry data-label."""
    ids, sizes, counts, gold = [], [], [], []
    for page in pages:
        blocks = leaf_blocks(page)
        f, s = page_features(blocks)
        ids += f
        sizes += s
        counts.append(len(blocks))
        gold += [int(b.mark == "text") for b in blocks]
    ids, sizes, counts, gold = map(np.array, (ids, sizes, counts, gold))
    block, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    want = np.eye(2)[gold]
    inner = np.ones(len(gold), bool)
    inner[np.cumsum(counts) - 1] = False
    follow = np.zeros((2, 2))
    np.add.at(follow, (gold[:-1][inner[:-1]], gold[1:][inner[:-1]]), 1)
    weights, trans = np.zeros((WIDTH, 2)), np.zeros((2, 2))
    squares, tsquares = np.full_like(weights, 1e-6), np.full_like(trans, 1e-6)
    for _ in range(steps):
        e = np.add.reduceat(weights[ids], first, axis=0)
        seen = np.zeros((2, 2))
        g = want - forward_backward(e, counts, trans, seen)
        grad = np.stack([np.bincount(ids, weights=g[block, k], minlength=WIDTH) for k in (0, 1)], axis=1) - 0.05 * weights
        squares += grad**2
        weights += 0.3 * grad / np.sqrt(squares)
        tgrad = follow - seen
        tsquares += tgrad**2
        trans += 0.1 * tgrad / np.sqrt(tsquares)
    return weights, trans


def viterbi(e: list[tuple[float, float]], trans: np.ndarray) -> list[int]:
    """The best labels of one page."""
    (t00, t01), (t10, t11) = trans.tolist()
    (a, b), back = e[0], []
    for x, y in e[1:]:
        p, q = a + t00 < b + t10, a + t01 < b + t11
        back.append((p, q))
        a, b = (b + t10 if p else a + t00) + x, (b + t11 if q else a + t01) + y
    label = int(b > a)
    out = [label]
    for p, q in reversed(back):
        label = int(q if label else p)
        out.append(label)
    return out[::-1]


class Extractor:
    """Decodes pages; remembers the scores of places, which repeat from page to page (about PLACES of them)."""

    PLACES = 50_000

    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.weights, self.trans, self.paths = [tuple(w) for w in weights.tolist()], trans, Paths()
        self.own: dict[tuple, tuple[float, float]] = {}
        self.here: dict[tuple, tuple[float, float]] = {}

    def sum(self, features: list[str]) -> tuple[float, float]:
        w = [self.weights[slot(f)] for f in features]
        return sum(x for x, _ in w), sum(x for _, x in w)

    def above(self, place: Place) -> tuple[float, float]:
        """The score of all open elements, from the nearest one whose score is known."""
        todo, at = [], place
        while at.score is None and at.parent:
            todo.append(at)
            at = at.parent
        x, y = at.score or (0.0, 0.0)
        for at in reversed(todo):
            a, b = self.sum(at.added)
            at.score = x, y = x + a, y + b
        return x, y

    def score(self, b: Block, first: bool) -> tuple[float, float]:
        place = self.above(b.place)
        key = (b.place.tag, b.place.own)
        here = self.here.get(key)
        if here is None:
            if len(self.here) >= self.PLACES:
                self.here.clear()
            here = self.here[key] = self.sum(here_features(b.place))
        key = (min((b.text.count(" ") + 1).bit_length(), 7), round(4 * b.linked / len(b.text)), b.text[-1] in ".!?…»\"”", first, "©" in b.text)
        own = self.own.get(key)
        if own is None:
            own = self.own[key] = self.sum(own_features(b, first))
        return place[0] + here[0] + own[0], place[1] + here[1] + own[1]

    def text(self, page: str) -> str:
        if self.paths.size > self.PLACES:
            self.paths = Paths()
        blocks = leaf_blocks(page, self.paths)
        if not blocks:
            return ""
        labels = viterbi([self.score(b, i == 0) for i, b in enumerate(blocks)], self.trans)
        return "\n".join(b.text for b, x in zip(blocks, labels, strict=True) if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: Iterable[str] | None = None) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Null or empty html gives an empty text, as does a page without text blocks. Repeated rows are extracted
    each; an empty table gives no rows; other columns are not read.
    """
    lean(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(fit(labelled if labelled is not None else labelled_pages()))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Extractor(*model.value)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                texts = [reader.text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
