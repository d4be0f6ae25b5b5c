from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from docweir.functions import paths, urls
from docweir.operators import urlset


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_normalize(spark):
    cases = {
        "HTTPS://Example.com/Docs/": "https://example.com/Docs",
        "https://example.com": "https://example.com/",
        "https://example.com/a;p=1?q#f": "https://example.com/a",
        "https://example.com/a;x/b;y": "https://example.com/a;x/b",
        "https://example.com//": "https://example.com/",
    }
    rows = spark.createDataFrame(list(cases.items()), ["u", "want"])
    for r in rows.select("want", urls.normalize(F.col("u")).alias("got")).collect():
        assert r.got == r.want


def test_resolve_agrees_with_urljoin(spark):
    bases = ["https://a.org/docs/guide/", "https://a.org/docs/guide/page.html?x=1", "https://a.org"]
    hrefs = [
        "/x", "x", "./x", "../x", "../../x/./y", "../../../../x", "?q=1", "#frag", "//b.org/z", "https://c.org/",
        "mailto:me@x.org", "x/y.html#top", "", "..", ".", "a/../b/", "/a/./b/../c",
    ]
    pairs = [(b, h, urljoin(b, h)) for b in bases for h in hrefs]
    rows = spark.createDataFrame(pairs, ["b", "h", "want"])
    wrong = [
        (r.b, r.h, r.want, r.got)
        for r in rows.select("*", urls.resolve(F.col("b"), F.col("h")).alias("got")).collect()
        if r.got != r.want
    ]
    assert not wrong


def test_ancestors_prefix_and_assets(spark):
    u = F.lit("https://example.com/docs/en/home")
    assert one(spark, urls.ancestors(u)) == [
        "https://example.com/docs/en/home", "https://example.com/docs/en", "https://example.com/docs", "https://example.com",
    ]
    assert one(spark, urls.scope_prefix(F.lit("https://e.com/docs/index.html"))) == "https://e.com/docs"
    assert one(spark, urls.scope_prefix(F.lit("https://e.com/v1.2/"))) == "https://e.com/v1.2"
    assert one(spark, urls.is_asset(F.lit("https://e.com/a.PDF?x"))) is True
    assert one(spark, urls.is_asset(F.lit("mailto:a@b.c"))) is True
    assert one(spark, urls.is_asset(F.lit("https://e.com/a.pdf/b"))) is False


@pytest.mark.parametrize(
    "segment,want",
    [("v1.2.3", [1, 2, 3]), ("3.4", [3, 4]), ("v9", [9]), ("latest", [9999]), ("version-2.0", [2, 0]), ("v6.x", [6]), ("guide", None)],
)
def test_parse_version(spark, segment, want):
    assert one(spark, paths.parse_version(F.lit(segment))) == want


def _set(spark, items):
    return spark.createDataFrame([("s", i, u) for i, u in enumerate(items)], "site_id string, pos bigint, url string")


def _site(spark, base):
    return spark.createDataFrame([("s", base)], ["site_id", "base_url"])


def test_version_dedupe_keeps_newest_and_current(spark):
    base = "https://e.com/docs/"
    for tails, want in (
        (["current/quick", "v3.4/quick", "v3.3/quick"], ["current/quick"]),
        (["v1.0/d", "v2.0/d", "v1.5/d"], ["v2.0/d"]),
        (["v1.9/d", "v1.10/d", "plain"], ["plain", "v1.10/d"]),
    ):
        got = urlset.newest_version(_set(spark, [base + t for t in tails]))
        rows = got.orderBy("is_versioned", "group_pos", "pos").collect()
        assert [r.url for r in rows] == [base + t for t in want]


def test_language_filter(spark):
    base = "https://e.com"
    items = [f"{base}/docs/{t}" for t in ("config", "guide", "de", "de/config", "fr", "fr/guide")]
    kept = urlset.one_language(_set(spark, items), _site(spark, f"{base}/docs"))
    assert sorted(r.url for r in kept.collect()) == sorted(items[:2])
    few = [f"{base}/docs/config", f"{base}/docs/go"]
    assert urlset.one_language(_set(spark, few), _site(spark, f"{base}/docs")).count() == 2
    under = [f"{base}/en/6.0/a", f"{base}/en/6.0/b", f"{base}/fr/6.0/contents"]
    kept = urlset.one_language(_set(spark, under), _site(spark, f"{base}/en/6.0/"))
    assert sorted(r.url for r in kept.collect()) == under[:2]


def test_hot_site_and_copies_do_not_change_results(spark):
    hot = [("hot", i, f"https://h.com/p/{i % 7}/") for i in range(3000)]
    cold = [(f"c{i}", i, f"https://c{i}.com/p") for i in range(50)]
    rows = spark.createDataFrame(hot + cold, "site_id string, pos bigint, url string").repartition(8)
    first = {(r.site_id, r.url): r.pos for r in urlset.first_seen(rows).collect()}
    assert len(first) == 57
    assert all(first[("hot", f"https://h.com/p/{i}")] == i for i in range(7))
    capped = urlset.cap_pages(rows.withColumnRenamed("pos", "p"), 5, ("p",)).where("site_id = 'hot'").collect()
    assert sorted(r.p for r in capped) == [0, 1, 2, 3, 4]


def test_large_caps_rank_slices_first(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("c"), (F.col("id") % 70).cast("string"))).otherwise("hot").alias("site_id"),
        F.col("id").alias("pos"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"),
    )
    got = urlset.cap_pages(rows, 1500, ("pos",)).where("site_id = 'hot'").orderBy("rank").collect()
    want = [i for i in range(5000) if i % 10][:1500]
    assert [r.pos for r in got] == want and [r.rank for r in got] == list(range(1, 1501))
