"""Main text of web pages by gradient-boosted trees over DOM-node features.

A page becomes a tree of block elements and of the runs of text that stand between them, each
with the statistics of its subtree, its place among its siblings and the tokens of its
attributes. Trees boosted on a bounded sample of pages give every node the chance that main text
lies in it; the most likely labelling in which no text is kept below a node that is dropped
decides. Where that drops a page that holds prose, the odds of all nodes are raised together until
something stays.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 240
TREES = 20
DEPTH = 5
PAGE_BATCH = 128

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style template noscript iframe svg textarea title".split())
BLOCK = frozenset(
    "html head body div p ul ol li dl dt dd table thead tbody tfoot tr td th section article main nav header footer aside "
    "form fieldset figure figcaption blockquote pre h1 h2 h3 h4 h5 h6 address details summary dialog menu center select button hgroup".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("nav header footer aside form fieldset button select menu dialog head".split())
#: Elements that an opening element of the same row ends.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
SCOPE = frozenset("ul ol dl table div section article main body nav aside header footer form menu".split())
# fixed values: attribute words that page authors use for what surrounds, or holds, the text
AROUND = frozenset(
    "nav navbar navigation menu header masthead banner footer foot sidebar side aside ad ads advert advertisement adbox sponsor sponsored promo "
    "cookie consent notice alert popup modal newsletter subscribe signup login form search comment comments reply replies disqus respond "
    "share sharing social related recommended more breadcrumb breadcrumbs pagination pager tags widget toolbar copyright legal skip hidden".split()
)
WITHIN = frozenset("article content post entry body story main text page blog prose document".split())

# fixed values: words that speak of the site or to the reader
BOILER = frozenset(
    "copyright rights reserved inc cookie cookies privacy terms policy imprint contact home about login subscribe newsletter share tweet "
    "facebook twitter email follow print comments reply advertisement sponsored".split()
)
#: Elements whose text is one leaf: no block can stand in them.
LEAF = HEADINGS | {"p", "pre"}
#: Open elements beyond which a page nests no deeper, as in browsers.
MAX_DEPTH = 512
#: Characters of a tag that are read with regard to quotes; in a longer one the first > ends it.
QUOTED_CHARS = 4096
TEXT = "#text"

_OPENS = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTE = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STOP = re.compile(r"[.!?;:]")
_WORD = re.compile(r"[A-Za-z]+")
#: Longer blocks are prose, whatever they speak of.
BOILER_CHARS = 200


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    start: int
    tokens: frozenset = frozenset()
    children: list = field(default_factory=list)
    chars: int = 0
    linked: int = 0
    stops: int = 0
    words: int = 0
    blocks: int = 0
    fields: int = 0
    boiler: int = 0
    end: int = 0


@dataclass(slots=True)
class Page:
    nodes: list
    #: (node, text) of every run of inline text, in page order
    blocks: list


def read(source: str | None) -> Page:
    """Block elements and text runs in page order, parents first, and the text blocks with their nodes.

    The time taken grows with the page's length, whatever its markup. Unclosed and misnested tags are taken as browsers do in the common cases: a block
    ends an open paragraph, rows end rows, an end tag without its start is ignored.
    """
    source = source or ""
    nodes, blocks = [Node("#page", -1, 0, 0)], []
    stack: list[str] = ["#page"]
    open_: Counter[str] = Counter()
    owners = [0]  # per stack entry the block node it belongs to
    held: list[str] = []
    linked = seen = 0

    def flush() -> None:
        nonlocal linked, seen
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                own = owners[-1]
                if nodes[own].tag not in LEAF:
                    nodes[own].children.append(len(nodes))
                    nodes.append(Node(TEXT, own, nodes[own].depth + 1, seen, end=seen + len(text)))
                    own = len(nodes) - 1
                node = nodes[own]
                node.chars += len(text)
                node.linked += min(linked, len(text))
                node.stops += len(_STOP.findall(text))
                node.words += text.count(" ") + 1
                node.blocks += 1
                node.boiler += sum(w.lower() in BOILER for w in _WORD.findall(text)) if len(text) < BOILER_CHARS else 0
                blocks.append((own, text))
                seen += len(text)
            held.clear()
        linked = 0

    def pop(to: int) -> None:
        if any(t in BLOCK for t in stack[to:]):
            flush()
        for owner in set(owners[to:]) - {owners[to - 1]}:
            nodes[owner].end = seen
        open_.subtract(stack[to:])
        del stack[to:], owners[to:]

    def within(names: tuple) -> int:
        """Index of the nearest open element of these names, not beyond a scope; 0 if none."""
        if not any(open_[n] for n in names):
            return 0
        for at in range(len(stack) - 1, 0, -1):
            if stack[at] in names:
                return at
            if stack[at] in SCOPE and stack[at] not in names:
                return 0
        return 0

    at = 0
    while at < len(source):
        m = _OPENS.search(source, at)
        end = len(source)
        if m and source.startswith("<!--", m.start()):
            end = source.find("-->", m.end()) + 3
            end = end if end > 2 else len(source)
        elif m:
            end = source.find(">", m.end()) + 1
            if not end:
                # no tag ends any more: the rest is text, up to a comment
                comment = source.find("<!--", at)
                m, rest = None, source[at : comment if comment >= 0 else len(source)]
                source = source[:at] + rest
                end = len(source)
            elif '"' in (inner := source[m.end() : end]) or "'" in inner:
                quoted = _REST.match(source, m.end(), m.end() + QUOTED_CHARS)
                end = quoted.end() if quoted else end
        text = source[at : m.start() if m else len(source)]
        if text:
            held.append(text)
            if "a" in stack[-3:]:
                linked += len(text)
        if not m:
            break
        inner, at = source[m.end() : end], end
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_[tag]:
                pop(len(stack) - 1 - stack[::-1].index(tag))
            continue
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}", re.IGNORECASE).search(source, at)
            at = close.start() if close else len(source)
            continue
        if tag in VOID:
            held.append(" ")
            if tag == "input":
                nodes[owners[-1]].fields += 1
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            if tag in ENDS:
                if to := within(ENDS[tag]):
                    pop(to)
            elif tag not in ("td", "th") and (to := within(("p", *HEADINGS) if tag in HEADINGS else ("p",))):
                pop(to)
            flush()
            if len(stack) >= MAX_DEPTH:
                continue
            values = "".join(" " + (a or b or c) for a, b, c in _ATTRIBUTE.findall(inner))
            parent = owners[-1]
            tokens = frozenset(t.lower() for t in _TOKEN.findall(values)) if values else frozenset()
            nodes[parent].children.append(len(nodes))
            owners.append(len(nodes))
            nodes.append(Node(tag, parent, nodes[parent].depth + 1, seen, tokens, fields=int(tag in ("button", "select"))))
        elif len(stack) >= MAX_DEPTH:
            continue
        else:
            owners.append(owners[-1])
        stack.append(tag)
        open_[tag] += 1
    flush()
    pop(1)
    nodes[0].end = seen
    for node in reversed(nodes[1:]):
        up = nodes[node.parent]
        for name in ("chars", "linked", "stops", "words", "blocks", "fields", "boiler"):
            setattr(up, name, getattr(up, name) + getattr(node, name))
    return Page(nodes, blocks)


FEATURES = (
    "depth", "log_chars", "log_words", "link_share", "stops_per_word", "chars_per_block", "log_blocks", "log_fields", "page_share", "starts", "ends",
    "siblings", "place", "parent_share", "heading", "paragraph", "item", "furniture", "article", "around", "within", "above_around", "above_within", "near_text", "run", "boiler_share",
)


def features(page: Page) -> np.ndarray:
    """One row of FEATURES per node."""
    nodes, total = page.nodes, max(1, page.nodes[0].chars)
    rows, above = [], [(0, 0)] * len(nodes)
    place = [(1, 0.0)] * len(nodes)
    # per node the longest child, and the longest of the others
    longest = [(0, 0, -1)] * len(nodes)
    for at, node in enumerate(nodes):
        for i, child in enumerate(node.children):
            place[child] = (len(node.children), i / max(1, len(node.children) - 1))
            chars, (first, second, which) = nodes[child].chars, longest[at]
            longest[at] = (chars, first, child) if chars > first else (first, max(second, chars), which)
    for i, n in enumerate(nodes):
        around, within = len(n.tokens & AROUND), len(n.tokens & WITHIN)
        up = above[n.parent] if i else (0, 0)
        furniture, article = int(n.tag in FURNITURE), int(n.tag in ("article", "main"))
        above[i] = (up[0] + furniture + around, up[1] + article + within)
        parent = nodes[n.parent] if i else n
        siblings, where = place[i]
        first, second, which = longest[n.parent] if i else (0, 0, -1)
        near = second if which == i else first
        rows.append(
            (
                n.depth, math.log1p(n.chars), math.log1p(n.words), n.linked / max(1, n.chars), n.stops / max(1, n.words), n.chars / max(1, n.blocks),
                math.log1p(n.blocks), math.log1p(n.fields), n.chars / total, n.start / total, n.end / total, min(siblings, 50), where,
                n.chars / max(1, parent.chars), 7 - int(n.tag[1]) if n.tag in HEADINGS else 0, int(n.tag in ("p", "blockquote", "pre")), int(n.tag in ("li", "td", "dd", "dt")),
                furniture, article, around, within, up[0], up[1], math.log1p(near), int(n.tag == TEXT), n.boiler / max(1, n.words),
            )
        )
    return np.array(rows, dtype=np.float64)


def decode(page: Page, chance: np.ndarray) -> list[str]:
    """The text blocks under the most likely labelling in which a kept node's ancestors are all kept.

    If that keeps nothing though text stands outside everything that is named as
    furniture, a bias is added to all odds, doubled until some of that text stays.
    """
    nodes = page.nodes
    chance = np.clip(chance, 1e-4, 1 - 1e-4)
    odds = np.log(chance) - np.log1p(-chance)
    around = [False] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        around[i] = around[n.parent] or n.tag in FURNITURE or bool(n.tokens & AROUND and not n.tokens & WITHIN)
    prose = {node for node, _ in page.blocks if not around[node] and 2 * nodes[node].linked < nodes[node].chars}
    bias = 0.0
    while True:
        # what a subtree gains if it is kept; children stand behind their parents
        gain = (odds + bias).tolist()
        for i in range(len(nodes) - 1, 0, -1):
            gain[nodes[i].parent] += max(gain[i], 0.0)
        kept = [True] * len(nodes)
        for i in range(1, len(nodes)):
            kept[i] = kept[nodes[i].parent] and gain[i] > 0
        if bias > 32 or not prose or any(kept[node] for node in prose):
            break
        bias = 2 * bias or 0.5
    return [text for node, text in page.blocks if kept[node] and (not bias or node in prose)]


def boosted(model: GBTClassificationModel) -> list[tuple[float, list]]:
    """The trees as (weight, nested tests), read from the model's public description."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        lines = [line.strip() for line in tree.toDebugString.split("\n")[1:] if line.strip()]

        def build(at: int, lines: list[str] = lines) -> tuple[list, int]:
            if lines[at].startswith("Predict"):
                return [float(lines[at].split(":")[1])], at + 1
            number, limit = re.search(r"feature (\d+) <= ([-\d.eE]+)", lines[at]).groups()
            low, at = build(at + 1)
            high, at = build(at + 1)
            return [int(number), float(limit), low, high], at

        out.append((weight, build(0)[0]))
    return out


def chances(trees: list[tuple[float, list]], x: np.ndarray) -> np.ndarray:
    def value(node: list, rows: np.ndarray, out: np.ndarray) -> None:
        if len(node) == 1:
            out[rows] = node[0]
        elif len(rows):
            low = x[rows, node[0]] <= node[1]
            value(node[2], rows[low], out)
            value(node[3], rows[~low], out)

    score = np.zeros(len(x))
    for weight, tree in trees:
        part = np.zeros(len(x))
        value(tree, np.arange(len(x)), part)
        score += weight * part
    return 1 / (1 + np.exp(-2 * score))


def _labels(page: Page, main: set[int]) -> np.ndarray:
    """1 for nodes with main text in them; ``main`` holds the nodes that have some of their own."""
    out = np.zeros(len(page.nodes))
    for i in range(len(page.nodes) - 1, -1, -1):
        if i in main or any(out[c] for c in page.nodes[i].children):
            out[i] = 1
    return out


def marked(page: Page) -> np.ndarray | None:
    """Labels of a page that marks its article itself: text under article or main, less what furniture or attributes take out."""
    inside, out = [False] * len(page.nodes), [False] * len(page.nodes)
    for i, n in enumerate(page.nodes[1:], 1):
        inside[i] = inside[n.parent] or n.tag in ("article", "main")
        out[i] = out[n.parent] or n.tag in FURNITURE or bool(n.tokens & AROUND and n.tag not in ("article", "main", "body"))
    if not any(inside):
        return None
    return _labels(page, {node for node, _ in page.blocks if inside[node] and not out[node]})


#: A private character that labels main text in practice layouts.
MARK = "\ue000"


def practice(blocks: list[str], draw: random.Random) -> str:
    """A page that sets text blocks in one of many layouts; every block of main text begins with MARK.

    A third of the layouts are bare: plain elements without names, or text straight in the body.
    """
    bare = draw.random() < 0.35
    words = " ".join(blocks).split() or ["text"]

    def some(low: int, high: int) -> str:
        at = draw.randrange(len(words))
        return html.escape(" ".join(words[at : at + draw.randint(low, high)]) or words[0])

    def named(tag: str, names: list[str], body: str) -> str:
        form = 1.0 if bare else draw.random()
        name = draw.choice(names) + draw.choice(["", "-box", "_1", "-wrap", " clearfix"])
        attribute = f' class="{name}"' if form < 0.55 else f' id="{name}"' if form < 0.8 else ""
        return f"<{tag}{attribute}>{body}</{tag}>"

    def links(n: int) -> str:
        if bare and draw.random() < 0.6:
            return draw.choice([" | ", " ", " &middot; "]).join(f'<a href="/y">{some(1, 2)}</a>' for _ in range(n))
        rows = "".join(f'<li><a href="/x">{some(1, 3)}</a></li>' for _ in range(n))
        return f"<ul>{rows}</ul>" if draw.random() < 0.7 else "".join(f'<a href="/y">{some(1, 3)}</a> ' for _ in range(n))

    def prose(n: int) -> str:
        return "".join(f"<p>{some(4, 25)}</p>" for _ in range(n)) if draw.random() < 0.6 else some(3, 25)

    def side(semantic: str, names: list[str], body: str) -> str:
        if bare:
            return draw.choice([f"<div>{body}</div>", f"<p>{body}</p>" if "<" not in body and draw.random() < 0.3 else f"<div>{body}</div>", body + draw.choice(["<hr>", "<br>", ""]), f"<table><tr><td>{body}</td></tr></table>"])
        return named(draw.choice([semantic, "div", "section"]), names, body) if draw.random() < 0.85 else f"<{semantic}>{body}</{semantic}>"

    parts = {
        "menu": lambda: side("nav", ["menu", "nav", "navbar", "navigation"], links(draw.randint(3, 9))),
        "header": lambda: side("header", ["header", "masthead", "banner", "top-header"], some(1, 3 if bare else 8) + (links(3) if draw.random() < 0.4 else "")),
        "footer": lambda: side("footer", ["footer", "foot", "copyright", "legal"], draw.choice(["&copy; ", "Copyright 2024 ", "All rights reserved. ", "Contact: "]) + some(1, 4 if bare else 12) + (links(3) if draw.random() < 0.4 else "")),
        "side": lambda: side("aside", ["sidebar", "side", "widget", "related"], f"<h3>{some(1, 4)}</h3>" + (links(4) if draw.random() < 0.5 else prose(draw.randint(1, 3)))),
        "ad": lambda: side("div", ["ad", "ads", "advert", "sponsored", "promo"], prose(1)),
        "notice": lambda: side("div", ["cookie", "notice", "consent", "alert", "newsletter"], prose(1) + "<button>OK</button>" * draw.randint(0, 1)),
        "form": lambda: f"<form>{some(1, 6)}<input name=q><button>{some(1, 2)}</button></form>",
        "comments": lambda: side("section", ["comments", "comment", "replies", "respond"], f"<h3>{some(1, 3)}</h3>" + "".join(named(draw.choice(["div", "li", "article"]), ["comment", "reply"], f"<p>{some(3, 40)}</p>") for _ in range(draw.randint(1, 5)))),
        "share": lambda: side("div", ["share", "social", "tags", "breadcrumb", "related"], links(draw.randint(2, 5)) if draw.random() < 0.6 else draw.choice(["Share this ", "Follow us ", "Share "]) + draw.choice(["Tweet", '<a href="/t">Tweet</a>', "on Facebook"])),
    }
    kinds = list(parts)
    body = []
    titled = draw.random() < (0.65 if bare else 0.85)
    if titled and draw.random() < 0.6:
        blocks = [" ".join(blocks[0].split()[: draw.randint(1, 6)]), *blocks[1:]]
    for i, text in enumerate(blocks):
        tag = "h1" if titled and not i else draw.choice(["p"] * 14 + ["h2", "blockquote", "li", "pre", "div"])
        safe = MARK + html.escape(text)
        if tag == "p" and draw.random() < 0.15:
            safe = f'<a href="/z">{safe[:31]}</a>{safe[31:]}' if "&" not in safe[:41] else f"<b>{safe}</b>"
        block = f"<{tag}>{safe}</{tag}>"
        body.append(f"<ul>{block}</ul>" if tag == "li" else block)
        if draw.random() < 0.06:
            body.append(parts[draw.choice(["ad", "share", "notice", "form", "side"])]())
    if draw.random() < 0.3:
        body.append(parts[draw.choice(["comments", "share"])]())
    if bare and draw.random() < 0.3:
        # text straight in its container, lines broken by hand
        body = [draw.choice(["<br><br>", "<hr>"]).join(MARK + html.escape(text) for text in blocks)]
    if bare:
        story = "".join(body)
        story = draw.choice([story, f"<div>{story}</div>", f"<table><tr><td>{links(3)}</td><td>{story}</td></tr></table>", f"<div><div>{story}</div></div>"])
        before, after = ("".join(parts[draw.choice(["menu", "menu", "header", "share", "footer"])]() for _ in range(draw.randint(0, 2))) for _ in range(2))
        return f"<html><body>{before}{story}{after}</body></html>"
    outer = draw.choice(["article", "main", "div", "div", "section", "td"])
    story = named(outer, ["article", "content", "post", "entry", "story", "main", "box", "c12"], "".join(body))
    for _ in range(draw.randint(0, 2)):
        story = named("div", ["wrap", "container", "page", "row", "content"], story)
    before = "".join(parts[draw.choice(kinds[:7])]() for _ in range(draw.randint(0, 4)))
    after = "".join(parts[draw.choice(kinds)]() for _ in range(draw.randint(0, 4)))
    return f"<html><body>{before}{story}{after}</body></html>"


def examples(source: str | None, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Node features and labels from one page: as it is, where it marks its article, and its text in three practice layouts."""
    page, draw = read(source), random.Random(seed)
    xs, ys = [], []
    labels = marked(page)
    if labels is not None:
        xs.append(features(page))
        ys.append(labels)
    texts = [text for node, text in page.blocks if labels is None or labels[node]][:40]
    for _ in range(3 if texts else 0):
        twin = read(practice(texts[: draw.randint(1, len(texts))], draw))
        main = {node for node, text in twin.blocks if MARK in text}
        xs.append(features(twin))
        ys.append(_labels(twin, main))
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros((0, len(FEATURES))), np.zeros(0))


def train(pages: DataFrame, source: str = "html", page_id: str = "page_id", train_pages: int = TRAIN_PAGES) -> list[tuple[float, list]]:
    """Boosts trees on the nodes of at most ``train_pages`` pages, those of smallest id hash; the one bound of the sample.

    Labels come from pages that mark their article, and from their texts in layouts
    made here. Without a page to learn from there are no trees, and every node is as
    likely as not.
    """
    drawn = pages.select(F.xxhash64(page_id).alias("draw"), F.col(source).alias("source"))
    keys = drawn.select("draw").orderBy("draw").limit(train_pages)
    last = keys.agg(F.max("draw")).first()[0]
    sample = drawn.filter(F.col("draw") <= (last if last is not None else 0)).orderBy("draw").limit(train_pages)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for draw, text in zip(batch["draw"], batch["source"], strict=True):
                x, y = examples(text, int(draw))
                yield pd.DataFrame({"x": list(x), "label": y})

    nodes = sample.mapInPandas(rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    nodes = nodes.cache()
    try:
        if nodes.select("label").distinct().count() < 2:
            return []
        return boosted(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5, maxBins=32).fit(nodes))
    finally:
        nodes.unpersist()


def main_text(pages: DataFrame, trees: list[tuple[float, list]], source: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` with the main text behind them as ``text`` (or in that column's place).

    Blocks stand in page order, one per line, character references decoded and white
    space within a block as one space. A null or empty page has the empty text.
    """

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[str] = []
            for at in range(0, len(batch), PAGE_BATCH):
                read_pages = [read(s) for s in batch.iloc[at : at + PAGE_BATCH]]
                rows = [features(p) for p in read_pages]
                every = chances(trees, np.concatenate(rows))
                ends = np.cumsum([len(r) for r in rows])
                out += ["\n".join(decode(p, every[e - len(r) : e])) for p, r, e in zip(read_pages, rows, ends, strict=True)]
            yield pd.Series(out, dtype=object)

    return pages.withColumn("text", extract(F.col(source)))
