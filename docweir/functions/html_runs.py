"""HTML -> title, content blocks and robots directives of one page.

Elements are numbered in document order and carry the number of their last
descendant; text runs carry the element they stand in and the block they belong
to. Content choice and noise removal are interval tests over the two lists.
Blocks are rendered as Markdown by :mod:`docweir.operators.extract`.
"""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from itertools import groupby

VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "kbd": "`", "samp": "`", "del": "~~", "s": "~~"}
# Tags that only style text, taken out of code listings.
STYLING_TAGS = ("font", "span", "b", "i", "u", "em", "strong", "mark", "small", "s", "del", "ins")
STYLING = re.compile(rf"</?(?:{'|'.join(STYLING_TAGS)})(?:\s[^>]*)?>", re.I)
CODE_CLASS = re.compile(r"(?:^|\s)(?:language-|lang-|highlight-)(\S+)", re.I)

TAB_HOLDER = re.compile(r"(?:^|\s)(?:tabbed-labels|nav-tabs)(?:\s|$)")
TAB_LABEL = re.compile(r"(?:^|\s)sphinx-tabs-tab(?:\s|$)")
TAB_PANEL = re.compile(r"(?:^|\s)(?:tabbed-block|sphinx-tabs-panel|tab-pane)(?:\s|$)")


class Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.runs: list[dict] = []
        self.open: list[int] = []
        self.tabs: list[dict] = []  # label lists of the tab groups around the current place

    def _near(self, names) -> int | None:
        return next((e for e in reversed(self.open) if self.elements[e]["tag"] in names), None)

    def _add(self, eid: int, block: int, kind: str, text: str, raw: str) -> None:
        self.runs.append({"eid": eid, "block": block, "kind": kind, "text": text, "raw": raw})

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        eid = len(self.elements)
        self.elements.append(
            {
                "tag": tag, "cls": a.get("class", ""), "id": a.get("id", ""), "role": a.get("role", ""),
                "style": a.get("style", ""), "name": a.get("name", a.get("property", "")),
                "content": a.get("content", ""), "href": a.get("href", a.get("src", "")),
                "rel": a.get("rel", ""), "alt": a.get("alt", ""), "last": eid,
            }
        )
        if tag in VOID:
            self._void(eid, tag)
            return
        self.open.append(eid)
        self._open_tabs(eid, tag)

    def _void(self, eid: int, tag: str) -> None:
        block = self._near(BLOCKS)
        if tag == "br":
            self._add(eid, block or 0, self._kind(block), "\n", "\n")
        elif tag == "hr":
            self._add(eid, eid, "p", "---", "")
        elif tag == "img":
            e = self.elements[eid]
            self._add(eid, block or 0, self._kind(block), f"![{e['alt']}]({e['href']})", "")

    def _open_tabs(self, eid: int, tag: str) -> None:
        e = self.elements[eid]
        if TAB_HOLDER.search(e["cls"]) or e["role"] == "tablist":
            owner = self.open[-2] if len(self.open) > 1 else eid
            self.tabs.append({"owner": owner, "holder": eid, "labels": [], "next": 0})
        elif "sphinx-tabs" in e["cls"].split():
            self.tabs.append({"owner": eid, "holder": None, "labels": [], "next": 0})
        elif self.tabs and (TAB_PANEL.search(e["cls"]) or e["role"] == "tabpanel"):
            group = self.tabs[-1]
            names, i = group["labels"], group["next"]
            group["next"] += 1
            label = names[i] if i < len(names) else f"Tab {i + 1}"
            self._add(eid, eid, "p", f"**{label}**", label)

    def _label(self, eid: int) -> bool:
        """True when a closed element names a tab; its text then moves into the group's labels."""
        if not self.tabs:
            return False
        e, group = self.elements[eid], self.tabs[-1]
        held = group["holder"] in self.open
        if TAB_LABEL.search(e["cls"]) or (held and (e["tag"] in ("label", "a") or e["role"] == "tab")):
            mine = [r for r in self.runs if eid <= r["eid"] <= e["last"]]
            group["labels"].append(" ".join("".join(r["raw"] for r in mine).split()))
            self.runs = [r for r in self.runs if not eid <= r["eid"] <= e["last"]]
            return True
        return False

    def handle_endtag(self, tag):
        if tag not in [self.elements[e]["tag"] for e in self.open]:
            return
        while self.open:
            eid = self.open.pop()
            self.elements[eid]["last"] = len(self.elements) - 1
            self._label(eid)
            while self.tabs and self.tabs[-1]["owner"] == eid:
                self.tabs.pop()
            if self.elements[eid]["tag"] == tag:
                return

    def _kind(self, block: int | None) -> str:
        """Rendering kind of a block: its heading level, list depth and marker, code language."""
        if block is None:
            return "p"
        tag = self.elements[block]["tag"]
        if self._near(("pre",)) is not None:
            pre, code = self._near(("pre",)), self._near(("code",))
            classes = " ".join(self.elements[e]["cls"] for e in (code, pre) if e is not None)
            found = CODE_CLASS.search(classes)
            return "pre:" + (found.group(1).lower() if found else "")
        if re.fullmatch("h[1-6]", tag):
            return tag
        if tag in ("td", "th"):
            return f"cell:{self._near(('tr',))}"
        if tag == "dt":
            return "dt"
        item = self._near(("li",))
        if item is not None:
            lists = [self.elements[e]["tag"] for e in self.open if self.elements[e]["tag"] in ("ul", "ol")]
            return f"li:{max(len(lists), 1)}:{lists[-1] if lists else 'ul'}"
        return "quote" if self._near(("blockquote",)) is not None else "p"

    def handle_data(self, data):
        if not self.open:
            return
        block = self._near(BLOCKS)
        item = self._near(("li", "td", "th", "dt"))
        pre = self._near(("pre",))
        kind = self._kind(block)
        home = next((x for x in (pre, item, block) if x is not None), 0)
        if kind.startswith("pre"):
            self._add(self.open[-1], home, kind, data, data)
            return
        raw = re.sub(r"\s+", " ", data)
        text = raw
        if raw.strip():
            lead, tail = raw[: len(raw) - len(raw.lstrip())], raw[len(raw.rstrip()) :]
            core = raw.strip()
            around = [self.elements[e] for e in reversed(self.open)]
            # unclosed tags nest; each mark is set once
            for mark in dict.fromkeys(MARKS[e["tag"]] for e in around if e["tag"] in MARKS):
                core = f"{mark}{core}{mark}"
            link = next((e["href"] for e in around if e["tag"] == "a" and e["href"]), None)
            if link:
                core = f"[{core}]({link})"
            text = lead + core + tail
        self._add(self.open[-1], home, kind, text, raw)


def clean_code(text: str) -> str:
    """Plain code: entities resolved twice, styling tags cut, blank lines folded."""
    for _ in range(2):
        text = STYLING.sub("", html.unescape(text))
    return re.sub(r"\n{2,}", "\n", text).strip("\n")


# Where the content sits (first hit wins) and what is never content.
CONTENT_CLASSES = (
    "docs-content", "documentation", "doc-content", "markdown-body", "md-content", "rst-content", "content",
    "post-content", "entry-content", "page-content",
)
NOISE_TAGS = frozenset((
    "nav", "header", "footer", "aside", "script", "style", "noscript", "button",
))
NOISE_WORDS = (
    "sidebar", "navigation", "breadcrumb", "breadcrumbs", "toc", "table-of-contents", "tableofcontents",
    "edit-on-github", "edit-page", "pagination", "prev-next", "page-nav", "footer", "header", "nav", "menu",
    "search", "ads", "banner", "cookie", "linenos", "linenodiv", "clipboard", "copy",
)
NOISE_NAMES = re.compile("|".join(NOISE_WORDS))
HIDDEN = re.compile("display:none|visibility:hidden")


def _plain(runs: list[dict]) -> str:
    return " ".join("".join(r["raw"] for r in runs).split())


def _inside(runs: list[dict], e: dict) -> list[dict]:
    return [r for r in runs if e["eid"] <= r["eid"] <= e["last"]]


def _is_noise(e: dict) -> bool:
    return bool(
        e["tag"] in NOISE_TAGS
        or NOISE_NAMES.search(f"{e['cls']} {e['id']}".lower())
        or HIDDEN.search(e["style"].replace(" ", ""))
    )


def _content(elements: list[dict], runs: list[dict], css_class: str | None) -> dict | None:
    """The first element a selector hits, else the div with most text."""

    def first(test):
        return next((e for e in elements if test(e)), None)

    if css_class:
        return first(lambda e: css_class in e["cls"].split())
    hit = (
        first(lambda e: e["tag"] == "article")
        or first(lambda e: e["role"] == "main")
        or first(lambda e: e["tag"] == "main")
    )
    for name in () if hit else CONTENT_CLASSES:
        hit = first(lambda e: name in e["cls"].split())
        if hit:
            break
    if hit:
        return hit
    sized = [(len(_plain(_inside(runs, e))), -e["eid"], e) for e in elements if e["tag"] == "div"]
    best = max(sized, key=lambda s: s[:2], default=(0, 0, None))
    return best[2] if best[0] else None


def _title(elements: list[dict], runs: list[dict]) -> str:
    """First h1 without its anchor links, else the page title, else the social title."""
    h1 = next((e for e in elements if e["tag"] == "h1"), None)
    if h1:
        anchors = [e for e in elements if e["tag"] == "a" and "headerlink" in e["cls"].split()]
        return _plain([r for r in _inside(runs, h1) if not any(_inside([r], a) for a in anchors)])
    page = next((e for e in elements if e["tag"] == "title"), None)
    if page:
        return _plain(_inside(runs, page))
    social = (e["content"] for e in elements if e["tag"] == "meta" and e["name"] == "og:title" and e["content"])
    return next(social, "").strip()


def _blocks(elements: list[dict], runs: list[dict], main: dict) -> list[dict]:
    """Content runs without noise, joined block by block."""
    dropped: set[int] = set()
    for e in elements[main["eid"] + 1 : main["last"] + 1]:
        if e["eid"] not in dropped and _is_noise(e):
            dropped.update(range(e["eid"], e["last"] + 1))
    kept = [r for r in _inside(runs, main) if r["eid"] not in dropped]
    out = []
    for (_, kind), group in groupby(kept, key=lambda r: (r["block"], r["kind"])):
        text = "".join(r["text"] for r in group)
        text = clean_code(text) if kind.startswith("pre") else text.strip(" ")
        if text:
            out.append({"kind": kind, "text": text})
    return _with_tables(out)


def _with_tables(blocks: list[dict]) -> list[dict]:
    """Fold runs of table cells into one block per table, its first row as the head."""
    out = []
    for is_cell, run in groupby(blocks, key=lambda b: b["kind"].startswith("cell:")):
        if not is_cell:
            out.extend(run)
            continue
        rows = [[c["text"] for c in row] for _, row in groupby(run, key=lambda b: b["kind"])]
        rows.insert(1, ["---"] * len(rows[0]))
        out.append({"kind": "table", "text": "\n".join("| " + " | ".join(r) + " |" for r in rows)})
    return out


def read(source: str, css_class: str | None = None, bot: str = "") -> tuple[str, list[dict], list[str]]:
    """``(title, blocks, directives)`` of a page."""
    reader = Reader()
    reader.feed(source or "")
    reader.close()
    elements, runs = reader.elements, reader.runs
    for eid in reader.open:
        elements[eid]["last"] = len(elements) - 1
    for eid, e in enumerate(elements):
        e["eid"] = eid
    main = _content(elements, runs, css_class)
    directives = [
        d.strip().lower()
        for e in elements
        if e["tag"] == "meta" and e["name"].lower() in ("robots", bot) and e["content"]
        for d in e["content"].split(",")
    ]
    blocks = _blocks(elements, runs, main) if main else []
    return _title(elements, runs), blocks, list(dict.fromkeys(directives))
