"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is read into leaf blocks, each with the names of its ancestors (tags, class and id words) and its text. The
field scores every block by features of both and every step from block to block, and Viterbi finds the best labelling
of the page, article or not. It is trained by gradient ascent on the exact likelihood of labelled pages.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import html_pages
from tidemark.llm.common import small_batches, table

TRAINING_PAGES = 1800

#: Fixed sets of HTML element names.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noframes xmp noembed".split())
#: Open tags that an open head stays open at; any other, or text, begins the body.
IN_HEAD = frozenset("base head html link meta noframes noscript script style template title".split())
NO_TEXT = frozenset("head title select option optgroup textarea button datalist svg".split())
CLOSES_P = BLOCKS - frozenset("body button caption dd dt fieldset head html label legend li optgroup option tbody td tfoot th thead tr".split())
#: An opening tag closes these open ones, as far up as the named boundary.
CLOSES = {"li": (frozenset(["li"]), frozenset("ul ol menu dir".split())), "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])), "tr": (frozenset("tr td th".split()), frozenset(["table"])), "td": (frozenset("td th".split()), frozenset(["tr", "table"])), "th": (frozenset("td th".split()), frozenset(["tr", "table"])), "option": (frozenset(["option"]), frozenset(["select"]))}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_STOP = re.compile(r"[>\"']")
_MOST_QUOTES = 256
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-zà-ÿ]+|[A-Z]+(?![a-z])")
_END_OF_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
#: Of an element's class, id and role so many words count; of its ancestors the nearest that have any, so many.
NAME_WORDS, NAMED_ANCESTORS = 12, 4


class Node:
    """An open element: what features need of it and of those around it, shared with its children, so that deep pages stay linear."""

    __slots__ = ("depth", "kinds", "named", "nearest", "parent", "tag", "tags")

    def __init__(self, parent: Node | None, tag: str, names: tuple[str, ...]):
        self.parent, self.tag = parent, tag
        tags, kinds, named, self.depth, self.nearest = (parent.tags, parent.kinds, parent.named, parent.depth, parent.nearest) if parent else (frozenset(), frozenset(), (), 0, "")
        if tag in BLOCKS:
            self.depth += 1
            if tag in ("article", "main", "nav", "aside", "header", "footer", "form", "section"):
                self.nearest = tag
            tags = tags if tag in tags else tags | {tag}
        if names:
            named = (names, *named[: NAMED_ANCESTORS - 1])
            kinds = kinds | {k for k, words in GROUPS.items() if not words.isdisjoint(names)}
        self.tags, self.kinds, self.named = tags, kinds, named

    def block(self) -> Node:
        """The nearest block element, or the element itself at the top."""
        node = self
        while node.parent and node.tag not in BLOCKS:
            node = node.parent
        return node


@dataclass
class Block:
    node: Node
    text: str
    linked: int


class _Reader:
    def __init__(self, page: str):
        self.page, self.out, self.held = page, [], []
        self.stack: list[Node] = [Node(None, "", ())]
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.linked = self.anchors = self.hidden = 0
        self.none_left: set[str] = set()

    def last(self, tag: str) -> int:
        """Place of the innermost open element of a tag, or -1."""
        at = self.where.get(tag)
        return at[-1] if at else -1

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.where.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(Node(self.stack[-1], tag, names))
        self.anchors += tag == "a"
        self.hidden += tag in NO_TEXT

    def pop_to(self, i: int) -> None:
        while len(self.stack) > i:
            tag = self.stack.pop().tag
            self.where[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            self.anchors -= tag == "a"
            self.hidden -= tag in NO_TEXT

    def no_block_above(self, i: int) -> bool:
        return not self.blocks or self.blocks[-1] <= i

    def flush(self) -> None:
        if self.held:
            text = " ".join(unescape("".join(self.held)).split())
            if text:
                self.out.append(Block(self.stack[-1], text, self.linked))
            self.held.clear()
        self.linked = 0

    def leave_head(self, tag: str) -> None:
        """Its end tag may be left out. What stands in an open title is the title's, but for a body."""
        i = self.last("head")
        if i >= 0 and (tag == "body" or self.last("title") < i):
            self.pop_to(i)

    def text(self, a: int, b: int) -> None:
        if b <= a:
            return
        if self.hidden and self.stack[-1].tag == "head" and self.page[a:b].strip():
            self.leave_head("")
        if not self.hidden:
            self.held.append(self.page[a:b])
            if self.anchors:
                self.linked += b - a

    def tag_end(self, start: int) -> int:
        """Behind the > that ends a tag; one inside a quoted value doesn't, unless the quotes never close. -1 if there is none."""
        page = self.page
        first = page.find(">", start)
        if first < 0:
            return -1
        at = start
        for _ in range(_MOST_QUOTES):
            m = _STOP.search(page, at)
            if not m:
                break
            if m[0] == ">":
                return m.end()
            at = m.end()
            if page[max(start, at - 64) : m.start()].rstrip()[-1:] != "=":  # a quote that opens no value
                continue
            close = -1 if m[0] in self.none_left else page.find(m[0], at)
            if close < 0:
                self.none_left.add(m[0])
                break
            at = close + 1
        return first + 1

    def read(self) -> list[Block]:
        page, at, look = self.page, 0, 0
        while (lt := page.find("<", look)) >= 0:
            m = None
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                end = end + 3 if end >= 0 else len(page)
            elif page[lt + 1 : lt + 2] in ("!", "?"):
                end = page.find(">", lt) + 1
            elif m := _TAG.match(page, lt):
                end = self.tag_end(m.end())
            else:
                look = lt + 1
                continue
            if end <= 0:  # no > is left, so neither is a tag
                break
            self.text(at, lt)
            at = look = end
            if m:
                at = look = self.element(m[2].lower(), m[1], page[m.end() : end - 1], end)
        self.text(at, len(page))
        self.flush()
        return self.out

    def element(self, tag: str, closing: str, attrs: str, at: int) -> int:
        """Take a tag in; where to read on."""
        if self.hidden and not closing and tag not in IN_HEAD:
            self.leave_head(tag)
        if tag in RAW:
            if not closing and not attrs.endswith("/"):
                end = _END_OF_RAW[tag].search(self.page, at)
                return end.end() if end else len(self.page)
            return at
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.held.append(" ")
            return at
        block = tag in BLOCKS
        if closing:
            if block:
                self.flush()
            i = self.last(tag)
            if i >= 0 and (block or self.no_block_above(i)):
                self.pop_to(i)
            return at
        if block:
            self.flush()
            if (i := self.last("svg")) >= 0:  # a drawing that was not closed
                self.pop_to(i)
            if tag in CLOSES:
                shut, bound = CLOSES[tag]
                i = max(map(self.last, shut))
                if i > max(map(self.last, bound)):
                    self.pop_to(i)
            if tag in CLOSES_P:
                i = self.last("p")
                if i >= 0 and self.no_block_above(i):
                    self.pop_to(i)
        if attrs.endswith("/") and not block and attrs[-2:-1] in ("", " ", "\n", '"', "'"):  # not a value that ends so
            return at
        names = ()
        if "=" in attrs:
            names = tuple(dict.fromkeys(w.lower() for g in _NAMES.findall(attrs) for w in _PARTS.findall("".join(g))))[:NAME_WORDS]
        self.push(tag, names)
        return at


def leaf_blocks(page: str) -> list[Block]:
    """Runs of text between block elements, with the open elements around them. White space is one space, references are decoded. Linear in the page."""
    return _Reader(page).read()


#: Words of class and id names, by what they mark. Training pages also use names of other lists and none.
GROUPS = {kind: frozenset(w for name in getattr(html_pages, kind) for w in name.split("-")) - {"main", "site", "box", "list", "body", "page", "slot", "top", "bottom", "side", "text", "entry", "banner", "author", "buttons", "form", "contact", "reader", "post"} for kind in ("MENU", "HEADER", "FOOTER", "SIDEBAR", "NOTICE", "ADVERT", "FORM", "COMMENTS", "SHARE", "ARTICLE")}


def context(node: Node) -> tuple:
    """What the features of a node follow from, to remember them by."""
    return (node.tag, node.tags, node.kinds, node.named, node.nearest, min(node.depth, 8))


def context_features(key: tuple) -> list[str]:
    """Of the elements around a block: tags, groups of known names, and the words and letter groups of any names."""
    tag, tags, kinds, named, nearest, depth = key
    out = {f"in:{t}" for t in tags} | {f"named:{k}" for k in kinds}
    for i, names in enumerate(named):
        for w in names:
            out.add(f"name:{w}")
            if i < 2:
                out.add(f"near:{w}")
            out.update(f"part:{w[j : j + 4]}" for j in range(min(len(w), 16) - 3))
    return [*sorted(out), f"tag:{tag}", f"nearest:{nearest}", f"depth:{depth}"]


_MARKS = frozenset(["article", "main"])
_SENTENCE = re.compile(r"[.!?…。]")


def _share(part: int, whole: int) -> int:
    return 0 if not part else 1 if part * 10 < whole else 2 if part * 3 < whole else 3 if part * 3 < 2 * whole else 4


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Of each block's text, its neighbours', and how much of the page's prose lies in the elements around it."""
    n = len(blocks)
    words, links, prose, kinds = [], [], [], []
    for b in blocks:
        w, share = b.text.count(" ") + 1, b.linked / max(1, len(b.text))
        ends = b.text[-1] in ".!?…。”\"»:)"
        words.append(w)
        links.append(0 if share < 0.05 else 1 if share < 0.6 else 2)
        prose.append(w if w >= 12 and share < 0.3 and (ends or len(_SENTENCE.findall(b.text)) > 1) else 0)
        heading = b.node.block().tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        kinds.append("prose" if prose[-1] else "linked" if links[-1] == 2 else "heading" if heading else "sentence" if ends and w >= 4 else "short" if w < 6 else "text")
    held: dict[Node, int] = {}
    around = []
    for b, p in zip(blocks, prose, strict=True):
        node, up = b.node.block(), []
        for _ in range(2):
            if node.parent is None:
                break
            node = node.parent.block()
            if node.tag in ("body", "html", ""):
                break
            up.append(node)
            held[node] = held.get(node, 0) + p
        around.append(up)
    total = sum(prose)
    best1 = max((held[u[0]] for u in around if u), default=0)
    far, since = [9] * n, 9
    for order in (range(n), range(n - 1, -1, -1)):
        since = 9
        for i in order:
            since = 0 if prose[i] else since + 1
            far[i] = min(far[i], since)
    marked = [not _MARKS.isdisjoint(b.node.tags) or "ARTICLE" in b.node.kinds for b in blocks]
    # pages that mark their article are another matter than those in which only the prose tells
    m = "m" if any(marked) else "u"
    out = []
    for i, b in enumerate(blocks):
        up = around[i]
        own = [f"marked:{m}:{marked[i]}", f"marked:{m}:{marked[i]}:{kinds[i]}", f"{m}words:{min(words[i].bit_length(), 7)}", f"linked:{links[i]}", f"{m}kind:{kinds[i]}", f"{m}ends:{b.text[-1] in '.!?…'}", f"sign:{b.text[:1] in '©®™'}", f"place:{4 * i // n}", f"{m}far:{min(far[i], 4)}", f"{m}page:{min(total.bit_length(), 9)}", "bias"]
        own.append(f"{m}before:{kinds[i - 1] if i else ''}")
        own.append(f"{m}after:{kinds[i + 1] if i + 1 < n else ''}")
        own.append(f"{m}turn:{kinds[i]}:{kinds[i + 1] if i + 1 < n else ''}")
        for level, node in enumerate(up):
            own.append(f"{m}share{level}:{_share(held[node], total)}")
            own.append(f"{m}share{level}:{kinds[i]}:{_share(held[node], total)}")
        if up:
            own += [f"up:{up[0].tag}:{len(up[0].named) > len(up[0].parent.named) if up[0].parent else False}", f"up:{up[0].tag}:{b.node.block().tag}:{marked[i]}"]
            own.append(f"{m}best:{held[up[0]] == best1 and best1 > 0}:{kinds[i]}")
            own.append(f"{m}within:{max(held[x] for x in up[:2]) == best1 > 0}")
        out.append(own)
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block of a page."""
    known: dict[tuple, list[str]] = {}
    out = []
    for b, own in zip(blocks, block_features(blocks), strict=True):
        key = context(b.node)
        if key not in known:
            known[key] = context_features(key)
        out.append([*known[key], *own])
    return out


@dataclass(frozen=True)
class Field:
    """weight of each feature for the label article, none for the other; step is 2 x 2, and first is for a page's first block."""

    weight: dict[str, float]
    step: np.ndarray
    first: np.ndarray

    def scores(self, blocks: list[Block], known: dict[tuple, float]) -> list[float]:
        """Of the label article for each block; known holds the sums of contexts from page to page."""
        get, out = self.weight.get, []
        for b, own in zip(blocks, block_features(blocks), strict=True):
            key = context(b.node)
            around = known.get(key)
            if around is None:
                if len(known) > 20_000:
                    known.clear()
                around = known[key] = sum(get(f, 0.0) for f in context_features(key))
            out.append(around + sum([get(f, 0.0) for f in own]))
        return out

    def viterbi(self, scores: list[float]) -> list[int]:
        if not scores:
            return []
        (a, b), (c, d) = self.step.tolist()
        s0, s1 = float(self.first[0]), scores[0] + float(self.first[1])
        back = []
        for u in scores[1:]:
            x0, y0, x1, y1 = s0 + a, s1 + c, s0 + b, s1 + d
            back.append((int(y0 > x0), int(y1 > x1)))
            s0, s1 = max(x0, y0), max(x1, y1) + u
        label = int(s1 > s0)
        path = [label]
        for arrows in reversed(back):
            label = arrows[label]
            path.append(label)
        return path[::-1]


def _marginals(u: np.ndarray, lengths: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward in logs for many pages at once (pages x blocks, padded): probability of the label article per block, of steps (summed) and of first labels."""
    pages, most = u.shape
    fore, aft = np.zeros((pages, most, 2)), np.zeros((pages, most, 2))
    scores = np.stack((np.zeros_like(u), u), axis=2)
    fore[:, 0] = scores[:, 0] + first
    for i in range(1, most):
        fore[:, i] = scores[:, i] + np.logaddexp(fore[:, i - 1, :1] + step[0], fore[:, i - 1, 1:] + step[1])
    for i in range(most - 2, -1, -1):
        v = scores[:, i + 1] + aft[:, i + 1]
        go = np.logaddexp(step[:, 0] + v[:, :1], step[:, 1] + v[:, 1:])
        aft[:, i] = np.where((i + 1 < lengths)[:, None], go, 0.0)
    z = np.logaddexp(*fore[np.arange(pages), lengths - 1].T)
    inside = np.arange(most)[None, :] < lengths[:, None]
    p = np.where(inside[:, :, None], np.exp(fore + aft - z[:, None, None]), 0.0)
    log = fore[:, :-1, :, None] + step + (scores + aft)[:, 1:, None, :] - z[:, None, None, None]
    pairs = np.where(inside[:, 1:, None, None], np.exp(np.minimum(log, 0.0)), 0.0).sum(axis=(0, 1))
    return p[:, :, 1], pairs, p[:, 0].sum(axis=0)


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 90, rate: float = 0.15, decay: float = 7e-4, least_pages: int = 4) -> Field:
    """Adam on the mean log likelihood with an L2 penalty; the same pages give the same field. Features of fewer pages than least_pages don't count."""
    pages = [(b, y) for b, y in pages if b]
    seen = Counter(f for blocks, _ in pages for f in {f for b in blocks for f in b})
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least_pages))}
    coded = [[index[f] for f in b if f in index] for blocks, _ in pages for b in blocks]
    counts = np.fromiter(map(len, coded), np.int64, len(coded))
    flat, block = np.fromiter(chain.from_iterable(coded), np.int64), np.repeat(np.arange(len(coded)), counts)
    lengths = np.array([len(b) for b, _ in pages])
    inside = np.arange(lengths.max())[None, :] < lengths[:, None]
    y = np.zeros(inside.shape)
    y[inside] = list(chain.from_iterable(labels for _, labels in pages))
    both = np.stack((1 - y, y), axis=2) * inside[:, :, None]
    y_pairs, y_first = np.einsum("pti,ptj->ij", both[:, :-1], both[:, 1:]), both[:, 0].sum(axis=0)
    size = len(index) + 6
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    u = np.zeros(inside.shape)
    for t in range(1, rounds + 1):
        weight, step, first = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        u[inside] = np.bincount(block, weights=weight[flat], minlength=len(coded))
        p, pairs, p_first = _marginals(u, lengths, step, first)
        g_weight = np.bincount(flat, weights=(y - p)[inside][block], minlength=len(index))
        grad = np.concatenate((g_weight, (y_pairs - pairs).ravel(), y_first - p_first)) / len(pages) - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Field(dict(zip(index, theta[:-6].tolist(), strict=True)), theta[-6:-2].reshape(2, 2), theta[-2:])


def labelled(page: str, marks: list[tuple[str, int]]) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a page; each block takes the label of the next marked text that it equals."""
    blocks, at, labels = leaf_blocks(page), 0, []
    for b in blocks:
        while at < len(marks) and " ".join(marks[at][0].split()) != b.text:
            at += 1
        if at == len(marks):
            raise ValueError(f"a block without a mark: {b.text[:60]!r}")
        labels.append(marks[at][1])
        at += 1
    return features(blocks), labels


@lru_cache(maxsize=2)
def default_field(pages: int = TRAINING_PAGES) -> Field:
    """Two thirds of the training pages name their parts as many sites do, one third has plain containers."""
    return train([labelled(*p) for p in (*html_pages.labelled_pages(pages * 2 // 3), *html_pages.bare_pages(pages - pages * 2 // 3))])


def main_text(page: str | None, field: Field, known: dict | None = None) -> str:
    blocks = leaf_blocks(page) if page else []
    labels = field.viterbi(field.scores(blocks, {} if known is None else known))
    return "\n".join(b.text for b, keep in zip(blocks, labels, strict=True) if keep)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row; text is the article's blocks joined by line ends.

    Null html counts as empty, and pages without article blocks have an empty text. page_id and url may be null and
    are only passed on; repeated rows give repeated rows, an empty table none; pages of any length are read whole;
    other columns are not read.
    """
    field = field or default_field()

    def run(batches):
        known: dict[tuple, float] = {}
        for batch in small_batches(batches, 2):
            texts = [main_text(h, field, known) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, rows.drop("html").schema.add("text", "string").add("n_chars", "long"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
