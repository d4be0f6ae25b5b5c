"""The whole URL plan of a crawl: which pages of each site to fetch, in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docweir import params
from docweir.operators import robots, urlset


def candidates(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Dedupe, scope, version and language filters, in that order."""
    rows = urlset.first_seen(rows)
    rows = urlset.within_scope(rows, sites)
    rows = urlset.same_version(rows, sites)
    rows = urlset.one_language(rows, sites)
    return urlset.newest_version(rows)


def plan_urls(
    rows: DataFrame, sites: DataFrame, rules: DataFrame, max_pages: int = params.MAX_PAGES
) -> DataFrame:
    """``(site_id, pos, url)`` -> the ranked URLs each site's crawl fetches."""
    decided = robots.decide(candidates(rows, sites), rules)
    return urlset.cap_pages(robots.keep_allowed(decided), max_pages).select("site_id", "rank", "url")
