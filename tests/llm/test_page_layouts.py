"""Main text of layouts without names, and hostile markup."""

import gc
import time

import pytest

from docweir.llm import dom_trees

LINES = [f"Long sentence number {i} tells, with care, what happened to the people of the town that day." for i in range(6)]
STORY = "".join(f"<p>{x}</p>" for x in LINES)
PLAIN = "\n".join(LINES)
LAYOUTS = {
    "paragraphs in the body": (f"<html><body>{STORY}</body></html>", PLAIN),
    "one element": (f"<html><body><div>{LINES[0]}</div></body></html>", LINES[0]),
    "open element with a title": (f"<div><h1>Title of it</h1>{STORY}", "Title of it\n" + PLAIN),
    "three plain elements": (f'<body><div><a href="/">Home</a> <a href="/a">About</a> <a href="/b">News</a></div><div>{STORY}</div><div>Copyright 2024 Example Inc</div></body>', PLAIN),
    "table": (f'<body><table><tr><td><a href="/">Home</a><br><a href="/a">About</a></td><td><h1>Title of it</h1>{STORY}</td></tr></table></body>', "Title of it\n" + PLAIN),
    "runs beside the content": (f'<body><a href="/">Home</a> | <a href="/a">About</a><div class=content>{STORY}</div>Copyright 2024 Example Inc</body>', PLAIN),
    "a run inside the content": (f'<body><div class=content><h1>Title of it</h1>{STORY}Share this <a href="/t">Tweet</a></div></body>', "Title of it\n" + PLAIN),
    "lines broken by hand": (f"<body>{'<br><br>'.join(LINES)}</body>", " ".join(LINES)),
    "text in the body": (f"<body>{LINES[0]}</body>", LINES[0]),
}
HOSTILE = {
    "tags without end": lambda n: "<a " * (4 * n),
    "deep inline": lambda n: "<b>" * n + "<p>x</p>" * n,
    "open quotes": lambda n: '<a "' * (3 * n),
    "crossed quotes": lambda n: "<a '\">" * (2 * n),
    "deep items": lambda n: "<ul><li><b>" * n,
    "comments": lambda n: "<!--" * (3 * n),
    "deep table": lambda n: "<p><table>" + "<b>" * n + "<p>x</p>" * n,
}


@pytest.fixture(scope="module")
def trees(spark, sf):
    return dom_trees.train(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet"))


def text_of(trees, source):
    page = dom_trees.read(source)
    return "\n".join(dom_trees.decode(page, dom_trees.chances(trees, dom_trees.features(page))))


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(trees, name):
    source, want = LAYOUTS[name]
    assert text_of(trees, source) == want


def test_menus_alone_stay_dropped(trees):
    assert text_of(trees, '<body><nav><a href="/">Home</a> <a href="/a">About</a></nav><footer>Copyright 2024</footer></body>') == ""


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_markup_takes_time_in_proportion(name):
    """Reading a page four times as long takes about four times as long, not sixteen."""
    took = []
    gc.disable()
    try:
        for n in (20_000, 80_000):
            source = HOSTILE[name](n)
            began = time.process_time()
            dom_trees.features(dom_trees.read(source))
            took.append(time.process_time() - began)
    finally:
        gc.enable()
    assert took[1] < 0.3 or took[1] < 9 * took[0]
