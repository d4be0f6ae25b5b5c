"""The source cascade asks each source only for sites that earlier ones left without pages."""

import pytest
from pyspark.sql import functions as F

from docweir.operators import crawl, repo


def rows(df):
    return sorted((r.site_id, r.url, r.source_method) for r in df.collect())


def test_sources_fall_through(spark):
    sites = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "site_id string")
    asked = {}

    def source(name, pages):
        table = spark.createDataFrame(pages, "site_id string, url string")

        def pages_of(left):
            asked[name] = sorted(r.site_id for r in left.collect())
            return table

        return name, pages_of

    sources = [source("github", [("a", "1"), ("a", "2")]), source("llms_full", [("a", "3"), ("b", "4")]), source("llms_txt", []), source("sitemap_crawl", [("b", "5"), ("c", "6"), ("x", "7")])]
    got = crawl.cascade(sites, sources)
    assert rows(got) == [("a", "1", "github"), ("a", "2", "github"), ("b", "4", "llms_full"), ("c", "6", "sitemap_crawl")]
    assert asked == {"github": ["a", "b", "c", "d"], "llms_full": ["b", "c", "d"], "llms_txt": ["c", "d"], "sitemap_crawl": ["c", "d"]}
    asked.clear()
    got = crawl.cascade(sites, sources, skip=("llms_full",))
    assert ("b", "5", "sitemap_crawl") in rows(got) and "llms_full" not in asked
    with pytest.raises(ValueError, match="skipped"):
        crawl.cascade(sites, sources, skip=("github", "llms_full", "llms_txt", "sitemap_crawl"))


def test_license_lets_a_site_fall_through(spark):
    metas = spark.createDataFrame([("a", "MIT"), ("b", "Proprietary"), ("c", None)], "repo string, spdx_id string")
    pages = spark.createDataFrame([(s, "README.md") for s in "abc"], "site_id string, url string")

    def github(fair_use):
        return lambda left: pages.join(repo.license_gate(metas, fair_use=fair_use).where("may_fetch").select(F.col("repo").alias("site_id")), "site_id", "left_semi")

    sites = pages.select("site_id")
    rest = ("link_crawl", lambda left: left.withColumn("url", F.lit("/")))
    assert rows(crawl.cascade(sites, [("github", github(False)), rest])) == [("a", "README.md", "github"), ("b", "/", "link_crawl"), ("c", "/", "link_crawl")]
    assert {r[2] for r in rows(crawl.cascade(sites, [("github", github(True)), rest]))} == {"github"}
