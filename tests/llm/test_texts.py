"""Personal data, licenses, language and page text against brute force, held-out rows and known layouts."""

import hashlib
import random
import re

import brute
import pytest
from pyspark.sql import functions as F

from docweir.llm import diagonals, disclosure, dom_trees, hyperdim


@pytest.mark.parametrize("name", ["edges", "documents", "empty"])
def test_base_spans(request, name):
    docs = request.getfixturevalue(name)
    got = disclosure.find(docs).collect()
    want = sorted((str(r.doc_id), hashlib.sha256(",".join(brute.personal(r.text)).encode()).hexdigest()) for r in docs.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith(disclosure.CUE)]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
        assert len(base) == r.n_email + r.n_ip + r.n_card + r.n_phone


def test_patterns_as_written():
    draw = random.Random(5)
    parts = ["a@b.c", "@", ".", "x", "%", "-", "_", "+", "1", "255", "256", "1.2.3.4", "..", " ", "4111111111111111", "4111 1111-1111 1111", "+1 (234) 555-0000", "+", "é", "0000012", "a.b", "@b-c.de"]
    for _ in range(6000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 9)))
        got = [f"{disclosure.KINDS[k]}:{s}:{e}" for s, k, e in disclosure.base_spans(text)]
        assert got == brute.personal(text), repr(text)


def test_long_runs_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "@" * 300_000, "a@" * 100_000, "1." * 150_000, "+" * 300_000, "+1" * 100_000):
        disclosure.base_spans(text)


def test_telling_terms_are_found_and_cleaned(spark):
    rows = [(i, f"write to zibeline box{i} m{i}@mail.example.com today") for i in range(30)] + [(100 + i, "write to me today") for i in range(90)]
    rows += [(200, "the zibeline again"), (202, "a zibeline"), (203, "some zibeline"), (201, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in disclosure.find(docs).collect()}
    assert got[200] == "cue:4:12" and "cue:9:17" in got[0] and "cue" not in got[105] and got[201] == ""
    clean = {r.doc_id: r.text for r in disclosure.sanitised(docs).collect()}
    assert clean[200] == "the [cue] again" and clean[0] == "write to [cue] 0 [email] today" and clean[105] == "write to me today" and clean[201] is None


@pytest.mark.parametrize("name", ["edges", "documents", "empty"])
def test_license_base(request, name):
    docs = request.getfixturevalue(name)
    got = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in diagonals.scan(docs).collect())
    want = sorted((str(r.doc_id), *(str(v) if i in (2, 3) else v for i, v in enumerate(brute.license_base(r.text)))) for r in docs.select("doc_id", "text").collect())
    assert got == want


def test_license_passages(spark):
    passage = diagonals.PASSAGES[0][0].split()
    bent = passage[:6] + ["indeed"] + passage[6:]
    rows = [
        (1, "x " + " ".join(passage).upper()), (2, " ".join(bent)), (3, " ".join(passage[:9])), (4, "GNU-General (public) LICENSE mit, license! mit license"),
        (5, "gnu general license public cc  by"), (6, "gnu general public " * 3 + "license"),
    ]
    got = {r.doc_id: r for r in diagonals.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[1].n_base == 0 and got[1].score == 1.0 and got[1].base_labels == ""
    assert got[2].labels == "mit" and 0.8 <= got[2].score < 1.0 and got[3].labels == ""
    assert (got[4].n_base, got[4].first_word, got[4].last_word, got[4].base_labels) == (3, 0, 6, "gpl,mit")
    assert (got[5].n_base, got[5].base_labels) == (1, "cc-by") and (got[6].n_base, got[6].first_word) == (1, 6)


def test_language_on_held_out_rows(documents, edges, empty):
    model = hyperdim.prototypes(documents)
    rows = hyperdim.identify(documents.withColumn("held_out", hyperdim.held_out(F.col("doc_id"))), model).filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    guesses = {r.doc_id: r.lang_pred for r in hyperdim.identify(edges, model).collect()}
    assert guesses[1] == guesses[2] == guesses[4] == guesses[14] == "und" and guesses[11] in model[0]
    assert hyperdim.identify(empty, model).collect() == []
    assert {r.lang_pred for r in hyperdim.identify(documents, hyperdim.prototypes(empty)).collect()} == {"und"}


def test_labels_of_the_held_out_fold_teach_nothing(documents):
    wrong = documents.withColumn("lang", F.when(hyperdim.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert "xx" not in hyperdim.prototypes(wrong)[0]


def test_main_text(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    trees = dom_trees.train(pages)
    rows = dom_trees.main_text(pages, trees).collect()
    assert len(rows) == pages.count() and all(r.text == brute.article(r.html) for r in rows)

    def text_of(source):
        page = dom_trees.read(source)
        return "\n".join(dom_trees.decode(page, dom_trees.chances(trees, dom_trees.features(page))))

    story = "".join(f"<p>Long sentence number {i} tells, with care, what happened to the people of the town that day.</p>" for i in range(6))
    layout = (
        '<html><body><header class="masthead">Site name <a href="/">Home</a></header><div id="menu"><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></div>'
        '<div class="cookie-notice">We use cookies. <button>OK</button></div><div class="content"><h1>A headline &amp; more</h1>{}<div class="ad">Buy this now</div></div>'
        '<div class="sidebar"><h3>Recent</h3><ul><li><a href="/c">Three</a></li></ul></div><section id="comments"><h3>Comments</h3><div class="comment"><p>I liked it very much, thanks!</p></div></section>'
        "<form>Search <input name=q></form><footer>&copy; 2024 Example</footer></body></html>"
    )
    want = "\n".join(["A headline & more", *(re.sub("<[^>]*>", "", p) for p in story.split("</p>")[:-1])])
    assert text_of(layout.format(story)) == want
    for broken in (None, "", "<p", "<div><div>", "plain words", "<p>a<p>b</div></span>", "<script>x", "<!-- x", '<a href="x>y', "<b>" * 3000 + "t"):
        assert isinstance(text_of(broken), str)
    assert text_of(None) == text_of("") == text_of("<script>var a='<p>t</p>'") == ""


def test_pages_at_the_edges(spark, sf):
    trees = dom_trees.train(spark.read.parquet(f"{sf}/pages.parquet"))
    pages = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "<p>" + "word " * 200_000, "x")], "page_id long, url string, html string, text string")
    assert len(dom_trees.main_text(pages, trees).collect()) == 3
    assert dom_trees.main_text(pages.limit(0), dom_trees.train(pages.limit(0))).collect() == []


def test_reading_of_loose_markup():
    page = dom_trees.read("<ul><li>a<li><b>b &lt;x&gt;</ul><p>c<br>d<p>e <i>f</i>\n g<table><tr><td>1<td>2<tr><td>3</table>")
    assert [t for _, t in page.blocks] == ["a", "b <x>", "c d", "e f g", "1", "2", "3"]
