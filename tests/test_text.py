import json
import tracemalloc

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweir.functions import html_runs, markdown, text, windows
from docweir.functions.front_matter import split_front_matter
from docweir.functions.stem import stem
from docweir.functions.windows import estimate_tokens, pack_parents, scan_blocks, split_windows
from docweir.operators import chunking, extract


def test_windows_of_texts_that_fit():
    assert split_windows(" \n\t", 50, 5) == []
    assert split_windows("\n a few words, \n", 50, 5) == ["a few words,"]
    assert split_windows("z" * 50, 50, 5) == ["z" * 50]


@pytest.mark.parametrize(
    "body,want",
    [
        ("one two. three four five", ["one two.", "three four", "five"]),
        ("ab\n\ncd ef gh ij", ["ab", "cd ef gh ij", "j"]),
        ("q" * 23, ["q" * 12, "q" * 12, "q"]),
    ],
)
def test_windows_end_behind_the_best_separator(body, want):
    assert split_windows(body, 12, 1) == want


@given(st.text("ab .\n", max_size=200), st.integers(4, 30), st.integers(0, 10))
def test_windows_cover_the_text_in_order(body, width, overlap):
    pieces = split_windows(body, width, overlap)
    assert all(p and p == p.strip() and len(p) <= width and p in body for p in pieces)
    assert sum(map(len, "".join(pieces).split())) >= sum(map(len, body.split()))


def test_windows_keep_no_list_of_separators():
    body = "a b. c\n" * 100_000
    tracemalloc.start()
    try:
        n = sum(1 for _ in windows._window_spans(body, 1280, 160))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n > 500 and peak < 100_000


def test_front_matter():
    meta, body = split_front_matter("---\nweight: 7\ntags: [a, b]\n---\n\nFirst line")
    assert json.loads(meta) == {"weight": 7, "tags": ["a", "b"]} and body == "First line"
    for other in ("---\n- [open\n: :\n---\nrest", "---\nnever closed", "no fence at all"):
        assert split_front_matter(other) == ("{}", other)
    assert json.loads(split_front_matter('+++\ndraft = true\n+++\nrest')[0]) == {"draft": True}


def test_scan_blocks():
    md = "# A\ntext\nmore\n\n```py\n# no\n\n````\n~~~\n```\n| a | b |\n| 1 | 2 |\n- x\n\n- y\n  z\n\nend"
    assert list(scan_blocks(md)) == [
        ("h1", "A"), ("paragraph", "text\nmore"), ("code", "```py\n# no\n```"), ("code", "~~~\n```\n| a | b |\n| 1 | 2 |\n- x\n\n- y\n  z\n\nend\n~~~"),
    ]
    assert list(scan_blocks("| a | b |\n| 1 | 2 |\n- x\n\n- y\n  z\n\nend")) == [
        ("table", "| a | b |\n| 1 | 2 |"), ("list", "- x\n- y\n  z"), ("paragraph", "end"),
    ]
    assert list(scan_blocks("````\n```\n````\nx")) == [("code", "````\n```\n````"), ("paragraph", "x")]


def test_pack_parents_follow_headers():
    md = "# A\n\np1\n\n## B\n\np2\n\np3\n\n# C\n\n## D"
    assert list(pack_parents(scan_blocks(md), 1024)) == [("# A\n\np1", "A"), ("# A\n\n## B\n\np2\n\np3", "A > B")]
    long = "\n\n".join("w " * 40 for _ in range(5))
    parents = list(pack_parents(scan_blocks(long), 110))
    assert len(parents) == 3 and all(estimate_tokens(p) <= 110 for p, _ in parents)


def test_chunk_rows(spark):
    docs = spark.createDataFrame(
        [("1", "u", "test.txt", "text/plain", "english", "three word sentence"), ("2", "u", "m.md", "text/markdown", "english", "# T\n\nbody"),
         ("3", "u", "e.md", "text/markdown", "english", "# only")],
        "document_id string, user_id string, filename string, content_type string, language string, raw_text string",
    )
    parsed = chunking.parse_documents(docs)
    rows = {r.document_id: r for r in chunking.child_rows(parsed).collect()}
    assert rows["1"].content == "[Document: test.txt]\n\nthree word sentence" and rows["1"].word_count == 5
    assert rows["2"].content == "[Document: m.md]\n[Context: T]\n\n# T\n\nbody"
    assert [r.document_id for r in chunking.without_chunks(parsed).collect()] == ["3"]


def test_documents_are_parsed_once(spark):
    schema = "document_id string, user_id string, filename string, content_type string, language string, raw_text string"
    docs = spark.createDataFrame([(str(i), "u", "f", f"text/{t}", "en", "# T\n\nbody") for i, t in enumerate(("plain", "markdown"))], schema)
    for kind, n in (("text/plain", 1), ("text/markdown", 1)):
        parsed = chunking.parse_documents(docs.withColumn("content_type", F.lit(kind)))
        for rows in (chunking.parent_rows(parsed), chunking.child_rows(parsed), chunking.without_chunks(parsed), parsed.where("error IS NULL")):
            plan = rows._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("ArrowEvalPython") <= n, plan
    assert chunking.parent_rows(chunking.parse_documents(docs)).count() == 2


@pytest.mark.parametrize(
    "word,want",
    [("running", "run"), ("runners", "runner"), ("flies", "fli"), ("caresses", "caress"), ("hopping", "hop"), ("hoped", "hope"),
     ("relational", "relat"), ("conditional", "condit"), ("happy", "happi"), ("skies", "sky"), ("generously", "generous"), ("ties", "tie"), ("gas", "gas")],
)
def test_stem(word, want):
    assert stem(word) == want


def test_titles_and_jsx(spark):
    def md(x, fn):
        return spark.createDataFrame([(x,)], ["t"]).select(fn(F.col("t")).alias("x")).first().x

    assert md('---\ntitle: "A b"\n---\n# H', markdown.title) == "A b"
    assert md("+++\ntitle = 'T'\n+++\n", markdown.title) == "T"
    assert md("text\n # Head ", markdown.title) == "Head"
    assert md("---\nx: 1\n---\nbody", markdown.strip_front_matter) == "body"
    source = "import A from 'a'\n\n<Card x=\"1\">\nHello <B/>there\n</Card>\n{/* a\nb */}\n```js\nimport keep\n<Keep/>\n```\nexport const x = 1\nend"
    assert md(source, markdown.strip_jsx) == "Hello there\n\n```js\nimport keep\n<Keep/>\n```\nend"
    assert md("word " * 30, text.title).endswith("...") and len(md("a" * 60, text.title)) == 53


def test_extraction(spark):
    html = """<html><head><title>T &amp; x</title><meta name="robots" content="noindex, NoFollow"></head><body><nav>skip</nav>
    <main><h1>Head <a class="headerlink" href="#h">#</a></h1><p>Some <b>bold</b> and <a href="/x">link</a>.</p>
    <div class="tabbed-set"><div class="tabbed-labels"><label>Py</label><label>JS</label></div><div class="tabbed-content">
    <div class="tabbed-block"><pre><code class="language-python">a = 1\n\n\n&lt;span&gt;b</code></pre></div><div class="tabbed-block"><p>js</p></div></div></div>
    <ul><li>one<ul><li>inner</li></ul></li></ul><dl><dt>Term</dt><dd>Def</dd></dl><div class="my-sidebar">noise</div>
    <p style="display: none">hidden</p><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table></main></body></html>"""
    pages = spark.createDataFrame([(1, html), (2, "<div>a</div><div>longer text</div>"), (3, "<p>no container</p>")], "id int, html string")
    got = {r.id: r for r in extract.extract_pages(pages).collect()}
    assert got[1].title == "Head" and got[1].directives == ["noindex", "nofollow"]
    assert got[1].content == (
        "# Head\n\nSome **bold** and [link](/x).\n\n**Py**\n\n```python\na = 1\nb\n```\n\n**JS**\n\njs\n\n* one\n  * inner\n\n"
        "**Term**\n\nDef\n\n| A | B |\n| --- | --- |\n| 1 | 2 |"
    )
    assert got[2].content == "longer text" and got[3].content == ""
    assert html_runs.read("<meta property='og:title' content=' O '>")[0] == "O"


def test_words_of_chunks_are_counted_with_their_windows(spark):
    texts = ["", None, " \n", "one", "a\x0bb\x85c\x1cd e \xa0f\ng  h\ti", "# Head\n\nword, " + "été x. " * 900, "w" * 3000]
    rows = [(f"{kind}{i}", "u", None if i == 3 else f"a name {i}.txt", kind, "en", t) for i, t in enumerate(texts) for kind in ("text/plain", "text/markdown")]
    parsed = chunking.parse_documents(spark.createDataFrame(rows, "document_id string, user_id string, filename string, content_type string, language string, raw_text string"))
    chunks = chunking.child_rows(parsed).select("document_id", "word_count", text.word_count(F.col("content")).alias("want")).collect()
    assert len(chunks) > 20 and all(r.word_count == r.want for r in chunks)
    # they come from the chunker, so no text is read for them again
    whole = parsed.selectExpr("explode(parents) as p").selectExpr("size(p.children) as n", "size(p.words) as m").collect()
    assert whole and all(r.n == r.m for r in whole)
