import pytest
from pyspark.sql import functions as F

from docweir.operators import robots, site_index, sitemap


def decide(spark, body, *paths, bot="docweirbot"):
    files = spark.createDataFrame([("s", body)], ["site_id", "body"])
    rows = spark.createDataFrame([("s", f"https://e.com{p}") for p in paths], ["site_id", "url"])
    out = robots.decide(rows, robots.site_rules(files, bot))
    return {r.url[13:]: (r.robots_ok, r.ai_input) for r in out.collect()}


def test_longest_rule_wins(spark):
    got = decide(spark, "User-agent: *\nDisallow: /docs/\nAllow: /docs/public/", "/docs/private", "/docs/public/page", "/x")
    assert [got[p][0] for p in ("/docs/private", "/docs/public/page", "/x")] == [False, True, True]


def test_wildcard_anchor_and_escapes(spark):
    got = decide(spark, "User-agent: *\nDisallow: /*.json$\nDisallow: /%7Euser", "/data.json", "/data.json/extra", "/~user/x", "/a(b)")
    assert [got[p][0] for p in ("/data.json", "/data.json/extra", "/~user/x", "/a(b)")] == [False, True, False, True]


def test_allow_wins_ties(spark):
    assert decide(spark, "User-agent: *\nDisallow: /a\nAllow: /a", "/a")["/a"][0] is True


def test_own_group_beats_wildcard_and_groups_merge(spark):
    body = "User-agent: *\nDisallow: /\n\nUser-agent: DocweirBot\nDisallow: /secret/\nUser-agent: x\nDisallow: /\nUser-agent: docweirbot\nDisallow: /more/"
    got = decide(spark, body, "/public/", "/secret/page", "/more/x")
    assert [got[p][0] for p in ("/public/", "/secret/page", "/more/x")] == [True, False, False]


def test_crawl_delay_does_not_close_an_agent_list(spark):
    body = "User-agent: a\nCrawl-delay: 3\nUser-agent: docweirbot\nDisallow: /x"
    files = spark.createDataFrame([("s", body)], ["site_id", "body"])
    row = robots.site_rules(files).first()
    assert row.crawl_delay == 3.0 and [r.rule for r in row.rules] == ["/x"]


def test_content_signals(spark):
    body = "User-agent: *\nContent-Signal: search=yes, ai-input=yes\nContent-Signal: /blog/ ai-input=no\nContent-Signal: /only"
    got = decide(spark, body, "/blog/post", "/docs")
    assert got["/blog/post"][1] is False and got["/docs"][1] is True
    assert decide(spark, "", "/x")["/x"] == (True, None)


def test_filter_counts(spark):
    body = "User-agent: *\nDisallow: /blocked/\nContent-Signal: /noinput/ ai-input=no"
    files = spark.createDataFrame([("s", body)], ["site_id", "body"])
    rows = spark.createDataFrame([("s", f"https://e.com{p}") for p in ("/ok", "/blocked/a", "/noinput/b")], ["site_id", "url"])
    row = robots.drop_counts(robots.decide(rows, robots.site_rules(files))).first()
    assert (row.allowed, row.dropped_robots, row.dropped_signal) == (1, 1, 1)


@pytest.mark.parametrize(
    "value,want",
    [("noindex, nofollow", {"noindex", "nofollow"}), ("otherbot: noindex, nofollow", set()),
     ("none, docweirbot: nofollow, noarchive", {"none", "nofollow", "noarchive"}), ("", set())],
)
def test_header_directives(spark, value, want):
    row = spark.range(1).select(robots.header_directives(F.lit(value)).alias("d")).first()
    assert set(row.d) == want


def test_meta_nofollow(spark):
    html = '<META content="noindex, NoFollow" name="Robots">'
    assert spark.range(1).select(robots.nofollow(F.lit(""), F.lit(html)).alias("x")).first().x is True


def test_sitemap_forms(spark):
    bodies = [
        ("a", '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://e.com/p1</loc></url></urlset>'),
        ("b", "# note\nhttps://e.com/1\n\n https://e.com/2 "),
        ("c", "<urlset><url><loc>broken"),
        ("d", '<sm:sitemapindex xmlns:sm="x"><sm:sitemap><sm:loc> https://e.com/s.xml </sm:loc></sm:sitemap></sm:sitemapindex>'),
        ("e", "   "),
    ]
    rows = {r.url: r for r in sitemap.parse(spark.createDataFrame(bodies, ["url", "body"])).collect()}
    assert [(e.loc, e.lastmod) for e in rows["a"].entries] == [("https://e.com/p1", None)]
    assert [e.loc for e in rows["b"].entries] == ["https://e.com/1", "https://e.com/2"]
    assert rows["c"].entries == [] and rows["c"].subs == [] and rows["e"].entries == []
    assert [e.loc for e in rows["d"].subs] == ["https://e.com/s.xml"]


def test_index_file_parts(spark):
    body = "# Name\n\n> first\n> second\n\nprose\n> late\n## Guides\n- [A](/a): about a\n- [B](https://b.org/b)\n## Optional\n- [C](c.md)"
    files = spark.createDataFrame([(1, "https://e.com/x/llms.txt", body)], ["file_id", "url", "body"])
    row = files.select(site_index.title(F.col("body")).alias("t"), site_index.summary(F.col("body")).alias("s"), site_index.is_full(F.col("body")).alias("f")).first()
    assert (row.t, row.s, row.f) == ("Name", "first second", False)
    links = site_index.links(files).orderBy("pos").collect()
    assert [(x.url, x.section, x.optional, x.description) for x in links] == [
        ("https://e.com/a", "Guides", False, "about a"), ("https://b.org/b", "Guides", False, None),
        ("https://e.com/x/c.md", "Optional", True, None),
    ]
