"""Main content of web pages.

Method: tree-structured graphical model. Nodes are the structural elements of a page, each
main content or not; unary potentials come from a logistic model over words, links and
place, parent-child potentials from how often labels of parents and children go together;
sum-product messages upward and downward give each node's marginal. Training pages are
those whose own markup names their main part and their chrome; each is seen twice, as it
is and with all names of elements taken away, so that pages that name nothing are judged
by what they hold.

A block is an element h1-h6, p, li, td, th, pre, dt or dd; blocks are numbered by their
start tags from 0, outside comments, scripts and styles. A block that holds another block
or no visible text never comes out.

Defined results: pages of null, empty or blank html give no block; cut-off and badly closed
pages are read as far as they go, open elements end where their parent ends; pages that
are delivered twice come out twice; without a single labelled page nothing comes out. An
empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import kernel

#: Labelled pages to train on, at most (the bound of what comes to the driver), and the characters of all of them together, at most.
TRAIN_PAGES, TRAIN_TOTAL = 1500, 30_000_000
#: Size of the table of hashed features, and pages processed at once.
BITS, STEP = 18, 128
#: A text whose neighbouring words together say chrome by this logarithm is chrome in training, whatever holds it.
WORDED = -8.0

BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "pre", "dt", "dd")
HOLDERS = ("div", "section", "article", "main", "aside", "nav", "header", "footer", "ul", "ol", "dl", "table", "tr", "body", "form", "blockquote", "figure", "tbody", "thead", "details")
NAMES = {t: i + 1 for i, t in enumerate((*BLOCKS, *HOLDERS))}
KINDS = len(NAMES) + 1  # 0 is the page
#: What an element without its name counts as.
PLAIN = np.arange(KINDS)
for _t in ("section", "article", "main", "aside", "nav", "header", "footer"):
    PLAIN[NAMES[_t]] = NAMES["div"]

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9]*)\b([^>]*)>|<[!?][^>]*>|<[^>]*\Z", re.S | re.I)
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LINKS = frozenset(("a", "button"))
#: A start tag ends an open element of these kinds, unless one of the others comes first.
_P_ENDERS = frozenset((*BLOCKS, *HOLDERS)) - {"tbody", "thead"}
_ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
}
_P_STOPS = frozenset(("td", "th", "div", "section", "article", "main", "aside", "li", "table", "body"))

#: What names a page's main part, and what names chrome, in labelled pages: conventions of the web.
_MAIN_NAMES = re.compile(r"^(main|main-?content|main-col-body|content|article|awsdocs-container|post-body)$", re.I)
_CHROME_NAMES = re.compile(r"nav|menu|foot|side-?bar|bread-?crumb|feedback|share|promo|cookie|consent|newsletter|related|legal|banner|dialog|advert|topbar|toc$|^path$|^rail$|^box$|^col-[1-4]$|^bc$|^bottom$", re.I)
_CHROME_TAGS = frozenset(("nav", "footer", "aside", "header"))


class Forest:
    """The elements of some pages. A parent has a lower number than its children; page p is node ``roots[p]``."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.kind: list[int] = []
        self.attr: list[str] = []
        self.block: list[int] = []
        self.holds: list[bool] = []
        self.depth: list[int] = []
        self.roots: list[int] = []
        self.texts: list[str] = []
        self.text_node: list[int] = []
        self.text_link: list[bool] = []

    def _add(self, parent: int, kind: int, attr: str, block: int, depth: int) -> int:
        self.parent.append(parent)
        self.kind.append(kind)
        self.attr.append(attr)
        self.block.append(block)
        self.holds.append(False)
        self.depth.append(depth)
        return len(self.parent) - 1

    def scan(self, page: str | None) -> None:
        root = self._add(-1, 0, "", -1, 0)
        self.roots.append(root)
        if not page:
            return
        stack: list[tuple[str, int]] = [("", root)]
        texts, text_node, text_link = self.texts, self.text_node, self.text_link
        at, number, link, opened = 0, 0, False, dict.fromkeys(NAMES, 0)
        for m in _TOKEN.finditer(page):
            begin = m.start()
            if begin > at:
                text = page[at:begin]
                if not text.isspace():
                    texts.append(entities.unescape(text) if "&" in text else text)
                    text_node.append(stack[-1][1])
                    text_link.append(link)
            at = m.end()
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in _LINKS:
                link = not m[2]
                continue
            kind = NAMES.get(tag)
            if kind is None:
                continue
            if m[2]:
                if opened[tag]:
                    self._end(stack, opened, (tag,), ())
                    link = False
                continue
            if tag in _P_ENDERS and opened["p"]:
                self._end(stack, opened, ("p",), _P_STOPS)
            rule = _ENDS.get(tag)
            if rule and any(opened[t] for t in rule[0]):
                self._end(stack, opened, *rule)
            raw = m[4]
            attr = ""
            if "=" in raw and len(raw) > 4:
                attr = " ".join(a or b or c for a, b, c in _ATTR.findall(raw))
            top = stack[-1][1]
            if kind <= len(BLOCKS):
                for _, above in reversed(stack):
                    if self.holds[above]:  # then all above it do, too
                        break
                    self.holds[above] = True
                node = self._add(top, kind, attr, number, len(stack))
                number += 1
            else:
                node = self._add(top, kind, attr, -1, len(stack))
            stack.append((tag, node))
            opened[tag] += 1
        rest = page[at:]
        if rest and not rest.isspace():
            texts.append(entities.unescape(rest))
            text_node.append(stack[-1][1])
            text_link.append(link)

    @staticmethod
    def _end(stack: list[tuple[str, int]], opened: dict[str, int], ended, stops) -> None:
        """Closes the innermost open element of these kinds and all in it, unless one of the others comes first."""
        for i in range(len(stack) - 1, 0, -1):
            name = stack[i][0]
            if name in ended:
                for tag, _ in stack[i:]:
                    opened[tag] -= 1
                del stack[i:]
                return
            if name in stops:
                return


def _bucket(x: np.ndarray, edges: tuple[float, ...]) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, "right")


class Features:
    """Arrays of a forest, and its hashed features as pairs (node, slot)."""

    def __init__(self, f: Forest, named: bool) -> None:
        self.parent = np.array(f.parent, np.int64)
        self.kind = np.array(f.kind, np.int64)
        self.plain = self.kind if named else PLAIN[self.kind]
        self.depth = np.array(f.depth, np.int64)
        self.block = np.array(f.block, np.int64)
        self.leaf = (self.block >= 0) & ~np.array(f.holds, bool)
        n = len(self.parent)
        self.page = np.searchsorted(np.array(f.roots), np.arange(n), "right") - 1
        by_depth = np.argsort(self.depth, kind="stable")
        self.levels = np.split(by_depth, np.cumsum(np.bincount(self.depth, minlength=1)))[1:-1]
        owner, link = np.array(f.text_node, np.int64), np.array(f.text_link, bool)
        w = kernel.words(f.texts)
        word_node = owner[w.doc] if len(w.doc) else np.empty(0, np.int64)
        word_link = link[w.doc] if len(w.doc) else np.empty(0, bool)
        self.words = np.bincount(word_node, minlength=n)
        linked = np.bincount(word_node, weights=word_link, minlength=n)
        solid = np.array([len(t) for t in f.texts], np.int64)
        self.chars = np.bincount(owner, weights=solid, minlength=n) if len(owner) else np.zeros(n)
        ended = np.array([t.rstrip()[-1:] in ".!?。" for t in f.texts], bool)
        ends = np.zeros(n, np.int64)
        ends[owner] = ended.astype(np.int64)  # the last text counts
        total, total_link = self.words.astype(float), linked.copy()
        for level in reversed(self.levels):
            np.add.at(total, self.parent[level], total[level])
            np.add.at(total_link, self.parent[level], total_link[level])
        children = np.bincount(self.parent[1:][self.parent[1:] >= 0], minlength=n) if n > 1 else np.zeros(n, np.int64)
        up = np.maximum(self.parent, 0)
        share = _bucket(np.where(self.words > 0, linked / np.maximum(self.words, 1), -1), (0, 0.01, 0.34, 0.8))
        share_all = _bucket(np.where(total > 0, total_link / np.maximum(total, 1), -1), (0, 0.01, 0.1, 0.34, 0.8))
        size = _bucket(self.words, (1, 2, 3, 4, 6, 9, 13, 20, 40))
        size_all = _bucket(total, (1, 4, 10, 25, 60, 150, 400))
        first = np.array(f.roots)[self.page]
        last = np.append(np.array(f.roots)[1:], n)[self.page]
        place = ((np.arange(n) - first) * 6 // np.maximum(last - first, 1)).astype(np.int64)
        own = self.plain
        singles = [own, own * 8 + share, own * 16 + size, own * KINDS + own[up], share_all * 16 + size_all, own * 8 + place, share_all[up] * 256 + size_all[up] * 16 + _bucket(children[up], (2, 4, 8, 16)), own * 2 + ends, own * 64 + share * 10 + size, own[up] * 512 + share_all[up] * 64 + own]
        nodes = [np.arange(n)] * len(singles)
        slots = [self._slot(s.astype(np.uint64) + np.uint64((k + 1) << 32)) for k, s in enumerate(singles)]
        # the part of the features that are pairs of neighbouring words
        self.pairs = slice(0, 0)
        if len(w.hash):
            nodes.append(word_node)
            slots.append(self._slot(w.hash + np.uint64(3)))
            follow = np.flatnonzero(word_node[1:] == word_node[:-1])
            at = sum(map(len, nodes))
            self.pairs = slice(at, at + len(follow))
            nodes.append(word_node[follow])
            slots.append(self._slot(w.hash[follow] * np.uint64(0x9FB21C651E98DF25) + w.hash[follow + 1]))
            begin = np.flatnonzero(np.concatenate([[True], word_node[1:] != word_node[:-1]]))
            nodes.append(word_node[begin])
            slots.append(self._slot(w.hash[begin] + np.uint64(77)))
        if named:
            named_at = [i for i, a in enumerate(f.attr) if a]
            if named_at:
                nodes.append(np.array(named_at, np.int64))
                slots.append(self._attr_slots([f.attr[i] for i in named_at]))
        self.nodes, self.slots = np.concatenate(nodes), np.concatenate(slots)

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        return (kernel.mix(x) >> np.uint64(64 - BITS)).astype(np.int64)

    @classmethod
    def _attr_slots(cls, attrs: list[str]) -> np.ndarray:
        text, bounds = kernel.join([a.lower() for a in attrs])
        return cls._slot(kernel.span_hashes(kernel.codepoints(text), bounds[:-1], bounds[1:] - 1) + np.uint64(5))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.nodes, weights=weights[self.slots], minlength=len(self.parent))


def marginals(f: Features, score: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Chance of each node to be main content, by sum-product on its page's tree.

    pair[parent kind, child kind, parent state, child state] are logarithms of potentials.
    """
    n = len(score)
    own = np.stack([np.zeros(n), score], 1)
    inside = own.copy()
    message = np.zeros((n, 2))  # from a node to its parent, by the parent's state
    psi = pair[f.plain[np.maximum(f.parent, 0)], f.plain]
    for level in reversed(f.levels):
        x = inside[level][:, None, :] + psi[level]
        message[level] = np.logaddexp(x[:, :, 0], x[:, :, 1])
        np.add.at(inside, f.parent[level], message[level])
    belief = inside.copy()
    for level in f.levels:
        up = f.parent[level]
        above = belief[up] - message[level]
        x = above[:, :, None] + psi[level]
        belief[level] = inside[level] + np.logaddexp(x[:, 0, :], x[:, 1, :])
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))


def page_labels(f: Forest) -> tuple[np.ndarray, np.ndarray]:
    """For each node whether the markup says main content, and for each page whether it says so at all.

    A main part without heading and with hardly a sentence is a stub (a redirect, a sign-in
    page): nothing on its page is content.
    """
    n, tags = len(f.parent), [None] * KINDS
    for t, i in NAMES.items():
        tags[i] = t
    main, chrome = np.zeros(n, bool), np.zeros(n, bool)
    chars, heads = np.zeros(n), np.zeros(n, bool)
    np.add.at(chars, np.array(f.text_node, np.int64), [len(t) for t in f.texts])
    for i in range(n):
        p, tag, names = f.parent[i], tags[f.kind[i]], f.attr[i].split()
        if p >= 0:
            main[i], chrome[i] = main[p], chrome[p]
        if tag in ("main", "article") or tag in ("div", "section") and any(map(_MAIN_NAMES.match, names)):
            main[i] = True
        elif tag in _CHROME_TAGS or any(map(_CHROME_NAMES.search, names)):
            chrome[i] = True
        heads[i] = tag in ("h1", "h2")
    good = main & ~chrome
    page = np.searchsorted(np.array(f.roots), np.arange(n), "right") - 1
    told = np.bincount(page, weights=main, minlength=len(f.roots)) > 0
    text = np.bincount(page, weights=chars * good, minlength=len(f.roots))
    head = np.bincount(page, weights=heads & good, minlength=len(f.roots)) > 0
    good &= (head | (text > 200))[page]
    leaf = (np.array(f.block) >= 0) & ~np.array(f.holds, bool)
    content, whole = np.where(leaf, chars * good, 0), np.where(leaf, chars, 0)
    for i in range(n - 1, 0, -1):
        if f.parent[i] >= 0:
            content[f.parent[i]] += content[i]
            whole[f.parent[i]] += whole[i]
    return np.where(leaf, good, content > 0.5 * whole), told


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray

    @classmethod
    def fit(cls, pages: list[str], rounds: int = 12, seed: int = 3) -> Model:
        size = 1 << BITS
        sets, edges, pairs = [], [], []
        for at in range(0, len(pages), STEP):
            f = Forest()
            for p in pages[at : at + STEP]:
                f.scan(p)
            label, told = page_labels(f)
            for named in (True, False):
                x = Features(f, named)
                use = told[x.page] & ((x.chars > 0) | (x.block < 0)) & (x.parent >= 0)
                sets.append((x.nodes, x.slots, label.astype(float), use))
                pairs.append(x.pairs)
                child = np.flatnonzero(use)
                edges.append((child, x.parent[child], x.plain[x.parent[child]] * KINDS + x.plain[child]))
        seen = np.zeros(size)
        for nodes, slots, _, use in sets:
            seen += np.bincount(slots[use[nodes]], minlength=size)
        rare = seen < 4  # features of a few nodes would learn them by heart
        weights = cls._logistic(sets, rare, rounds, seed)
        # markup that forgets to name a box inside the main part: what looks like chrome to the model that learned
        # from all pages, or is worded as chrome nearly always is, is relabelled, and the model learned again
        yes, no = np.zeros(size), np.zeros(size)
        for (nodes, slots, label, use), at in zip(sets, pairs):
            mine = slots[at][use[nodes[at]]]
            told = label[nodes[at]][use[nodes[at]]]
            yes += np.bincount(mine, weights=told, minlength=size)
            no += np.bincount(mine, weights=1 - told, minlength=size)
        wording = np.log((yes + 0.5) / (no + 0.5))
        for _ in range(2):
            for k, (nodes, slots, label, use) in enumerate(sets):
                z = np.bincount(nodes, weights=weights[slots], minlength=len(label))
                worded = np.bincount(nodes[pairs[k]], weights=wording[slots[pairs[k]]], minlength=len(label))
                sets[k] = (nodes, slots, np.where((label > 0) & ((z < 0) | (worded < WORDED)), 0.0, label), use)
            weights = cls._logistic(sets, rare, rounds, seed)
        # what a parent's label tells beyond the child's own score, by pseudo-likelihood: for each pair of kinds
        # logit(child) = score + shift + pull * (1 or -1 by the parent's label), with a normal prior on both
        score, label, parent, group = (np.concatenate(x) for x in zip(*((np.bincount(n, weights=weights[s], minlength=len(y))[c], y[c], 2 * y[p] - 1, g) for (n, s, y, _), (c, p, g) in zip(sets, edges))))
        shift, pull = np.zeros(KINDS * KINDS), np.zeros(KINDS * KINDS)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(score + shift[group] + pull[group] * parent, -30, 30)))
            heat = np.bincount(group, weights=p * (1 - p), minlength=KINDS * KINDS) + 2.0
            shift += 0.5 * (np.bincount(group, weights=label - p, minlength=KINDS * KINDS) - 2.0 * shift) / heat
            pull += 0.5 * (np.bincount(group, weights=(label - p) * parent, minlength=KINDS * KINDS) - 2.0 * pull) / heat
        pair = np.zeros((KINDS * KINDS, 2, 2))
        for above in (0, 1):
            for below in (0, 1):
                pair[:, above, below] = below * shift + np.where(above == below, 0.5, -0.5) * pull
        pair = pair.reshape(KINDS, KINDS, 2, 2)
        return cls(weights.astype(np.float32), pair.astype(np.float32))

    @staticmethod
    def _logistic(sets: list, rare: np.ndarray, rounds: int, seed: int) -> np.ndarray:
        """Logistic regression over the hashed features, by AdaGrad over blocks of pages."""
        # only features that are not rare have a weight: the steps work on these alone
        kept = np.flatnonzero(~rare)
        place = np.full(len(rare), len(kept), np.int64)
        place[kept] = np.arange(len(kept))
        sets = [(nodes, place[slots], label, use) for nodes, slots, label, use in sets]
        weights, square, order = np.zeros(len(kept) + 1), np.full(len(kept) + 1, 1e-2), np.random.default_rng(seed)
        for _ in range(rounds):
            for k in order.permutation(len(sets)):
                nodes, slots, label, use = sets[k]
                z = np.bincount(nodes, weights=weights[slots], minlength=len(label))
                error = np.where(use, label - 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0)
                g = np.bincount(slots, weights=error[nodes], minlength=len(weights)) - 0.02 * weights
                g[-1] = 0
                square += g * g
                weights += 0.5 * g / np.sqrt(square)
        out = np.zeros(len(rare))
        out[kept] = weights[:-1]
        return out


def training_pages(df: DataFrame, html_col: str, limit: int = TRAIN_PAGES, chars: int = TRAIN_TOTAL) -> list[str]:
    """Whole pages whose markup names a main part: at most ``limit``, those of the least hashes of their html.

    Of these, a page that would bring them over ``chars`` characters in all is left out; a single page may be longer.
    """
    marked = df.select(F.col(html_col).alias("html")).where(F.col("html").rlike(r"(?i)<main\b|<article\b|(?:id|class|role)=[\"']?main"))
    hashed = marked.select("html", F.xxhash64("html").alias("h"), F.length("html").alias("chars"))
    n = hashed.count()
    if n > 2 * limit:  # a share that holds the limit with room to spare, so that no task sends more than it must
        hashed = hashed.where(F.pmod("h", F.lit(1 << 20)) <= int((1 << 20) * 1.5 * limit / n))
    keys, total, chosen = hashed.select("h", "chars").distinct().orderBy("h", "chars").limit(limit).collect(), 0, []
    for h, size in keys:
        if total + size <= chars:
            total += size
            chosen.append(h)
    if keys and not chosen:
        chosen = [min(keys, key=lambda r: (r.chars, r.h)).h]
    return [r.html for r in hashed.where(F.col("h").isin(chosen)).select("h", "html").distinct().orderBy("h", "html").collect()]


def main_blocks(df: DataFrame, id_col: str = "crawl_id", html_col: str = "html", train_pages: int = TRAIN_PAGES, least: float = 0.5) -> DataFrame:
    """(id, block_no, tag, text, probability): the blocks of each page's main content. Narrow but for the choice of training pages."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, block_no int, tag string, text string, probability double"
    pages = training_pages(df, html_col, train_pages)
    if not pages:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    shared = df.sparkSession.sparkContext.broadcast(Model.fit(pages))  # a table of fixed size, 1 MB
    tags = {i: t for t, i in NAMES.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, pair = shared.value.weights.astype(np.float64), shared.value.pair.astype(np.float64)
        for batch in batches:
            pages = batch.column(1).to_pylist()
            for at in range(0, len(pages), STEP):
                f = Forest()
                for p in pages[at : at + STEP]:
                    f.scan(p)
                if not f.texts:
                    continue
                x = Features(f, True)
                chance = marginals(x, x.scores(weights), pair)
                found = np.flatnonzero(x.leaf & (x.chars > 0) & (chance >= least))
                owner = np.array(f.text_node)
                begin, end = np.searchsorted(owner, found), np.searchsorted(owner, found, "right")
                # a leaf block's texts follow each other: no other element is open while it is
                text = [" ".join("".join(f.texts[a:b]).split()) for a, b in zip(begin.tolist(), end.tolist())]
                solid = [i for i, t in enumerate(text) if t]
                found = found[solid]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at + x.page[found])), pa.array(x.block[found], pa.int32()), pa.array([tags[k] for k in x.kind[found].tolist()], pa.string()), pa.array([text[i] for i in solid], pa.string()), pa.array(chance[found])],
                    names=["id", "block_no", "tag", "text", "probability"],
                )

    picked = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where(F.length("html") > 0)
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
