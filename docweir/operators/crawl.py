"""Link crawl, source choice and consolidation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir import params
from docweir.functions import urls
from docweir.functions.text import ellipsis, strip
from docweir.operators import robots, urlset
from docweir.session import cut_lineage

# Link relations that are not followed, and sources from best to last.
NOFOLLOW_RELS = ("nofollow", "ugc", "sponsored")
SOURCE_PRIORITY = ("github", "llms_full", "llms_txt", "sitemap_crawl", "link_crawl")


def page_links(pages: DataFrame) -> DataFrame:
    """Outgoing links of pages ``(page_id, url, html)``, resolved, assets left out."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)(<a\s[^>]*>)"), F.lit(1))
    rows = pages.select("page_id", "url", F.posexplode(tags).alias("pos", "tag"))

    def attribute(name: str) -> Column:
        pattern = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
        return F.concat(*[F.regexp_extract("tag", pattern, i) for i in (1, 2, 3)])

    href = strip(attribute("href"))
    rels = F.split(F.lower(attribute("rel")), r"\s+")
    return (
        rows.where(F.col("tag").rlike(r"(?is)\shref\s*="))
        .withColumn("href", href)
        .where(~F.startswith("href", F.lit("#")))
        .where(~F.arrays_overlap(rels, F.array(*[F.lit(r) for r in NOFOLLOW_RELS])))
        .select("page_id", "pos", urls.resolve(urls.link_base(F.col("url")), F.col("href")).alias("link"))
        .where(~urls.is_asset(F.col("link")))
    )


def crawl_links(
    sites: DataFrame,
    edges: DataFrame,
    pages: DataFrame,
    rules: DataFrame,
    max_depth: int = params.MAX_DEPTH,
    max_pages: int = params.MAX_PAGES,
    drops: list[DataFrame] | None = None,
) -> DataFrame:
    """Bounded breadth-first crawl of every site at once.

    ``edges`` is ``(site_id, src, dst, link_pos)`` over normalised addresses and
    ``pages`` ``(site_id, url, has_content, nofollow)`` the fetched snapshots.
    Each level joins its frontier with the edges, keeps addresses in scope that
    were not seen before, and filters them by version and language as one set
    per site. Addresses count as seen when found, filtered or not. Levels are
    written out between rounds. ``order_key`` replays the visiting order. A list given as ``drops``
    gets the ledger rows of each level.
    """
    prefix = sites.select("site_id", "base_url", urls.scope_prefix(F.col("base_url")).alias("_prefix"))
    rules = cut_lineage(rules)  # read again on every level
    frontier = sites.select(
        "site_id", urls.normalize(F.col("base_url")).alias("url"),
        F.array(F.lit(0).cast("bigint")).alias("order_key"),
    )
    seen = frontier.select("site_id", "url")
    visited = None
    for depth in range(max_depth):
        decided = robots.decide(frontier, rules)
        if drops is not None:
            drops.append(cut_lineage(robots.ledger("link_crawl", decided)))
        level = (
            robots.keep_allowed(decided)
            .join(pages, ["site_id", "url"])
            .withColumn("depth", F.lit(depth))
        )
        level = cut_lineage(level)
        visited = level if visited is None else visited.unionByName(level)
        if depth + 1 == max_depth:
            break
        found = (
            level.where(~F.col("nofollow"))
            .select("site_id", F.col("url").alias("src"), "order_key")
            .join(edges, ["site_id", "src"])
            .groupBy("site_id", F.col("dst").alias("url"))
            .agg(F.min(F.array_append("order_key", F.col("link_pos").cast("bigint"))).alias("order_key"))
            .join(prefix, "site_id")
            .where(urls.in_scope(F.col("url"), F.col("_prefix")))
            .select("site_id", "url", "order_key")
            .join(seen, ["site_id", "url"], "left_anti")
        )
        found = cut_lineage(found)
        seen = seen.unionByName(found.select("site_id", "url"))
        rows = urlset.same_version(found, sites)
        rows = urlset.one_language(rows, sites)
        frontier = _newest(rows)
    counted = visited.where(F.col("has_content")).select("site_id", "url", "depth", "order_key")
    return urlset.cap_pages(counted, max_pages, ("depth", "order_key"))


def _newest(rows: DataFrame) -> DataFrame:
    """Version dedupe with the crawl's order key in the place of plain positions."""
    ranked = urlset.newest_version(
        rows.withColumnRenamed("order_key", "pos"), first_rank=lambda c: F.transform(c, lambda x: -x)
    )
    head = F.when(F.col("is_versioned"), F.array(F.lit(1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    return ranked.select(
        "site_id", "url",
        F.concat(head, F.coalesce("group_pos", F.array().cast("array<bigint>")), F.array(F.lit(-1).cast("bigint")), F.col("pos")).alias("order_key"),
    )


def cascade(sites: DataFrame, sources: list[tuple[str, Callable[[DataFrame], DataFrame]]], skip: tuple[str, ...] = ()) -> DataFrame:
    """Pages of each site's first source that yields any, with ``source_method`` naming it.

    ``sources`` are pairs of a name and a function from the sites that are still without pages
    to their pages ``(site_id, ...)``. A source is computed for those sites alone: what it
    finds is stored before the next one starts, so later and costlier sources (sitemaps, link crawls)
    run over what earlier ones have left. Names in ``skip`` are passed over. A source that
    may not be used for a site, as by its license, simply yields none of its pages.
    """
    left, out = cut_lineage(sites), None
    for name, pages_of in sources:
        if name in skip:
            continue
        found = cut_lineage(pages_of(left).join(left.select("site_id"), "site_id", "left_semi").withColumn("source_method", F.lit(name)))
        out = found if out is None else out.unionByName(found)
        left = cut_lineage(left.join(found.select("site_id").distinct(), "site_id", "left_anti"))
    if out is None:
        raise ValueError("every source is skipped")
    return out


def page_block(title: Column, url: Column, content: Column) -> Column:
    return F.concat(
        F.lit("# "), F.coalesce(title, F.lit("Untitled Section")), F.lit("\n*Source: ["), url,
        F.lit("]("), url, F.lit(")*\n\n"), strip(content),
    )


def document_name(target: Column) -> Column:
    return ellipsis(F.concat(F.lit("Docs: "), F.coalesce(target, F.lit("Documentation Set"))), 255)


def consolidate(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """Crawled pages ``(site_id, rank, url, title, content)`` -> one document per site.

    A crawl is capped at ``max_pages`` before it comes here, which bounds the
    group. Sites without a single page with content fail.
    """
    good = pages.where(F.col("content").rlike(r"\S"))
    rows = good.select(
        "site_id",
        F.struct(
            F.col("rank"),
            page_block(F.col("title"), F.col("url"), F.col("content")).alias("block"),
            F.struct(F.coalesce("title", F.lit("Untitled Section")).alias("title"), "url").alias("page"),
        ).alias("r"),
    )
    merged = rows.groupBy("site_id").agg(F.sort_array(F.collect_list("r")).alias("_r"))
    return targets.join(merged, "site_id", "left").select(
        "site_id",
        document_name(F.col("target")).alias("filename"),
        F.array_join(F.transform("_r", lambda r: r["block"]), "\n\n---\n\n").alias("raw_text"),
        F.coalesce(F.size("_r"), F.lit(0)).alias("pages_count"),
        F.to_json(F.transform("_r", lambda r: r["page"])).alias("pages"),
        F.when(F.col("_r").isNull(), "failed").otherwise("completed").alias("status"),
        F.when(F.col("_r").isNull(), "No valid page content retrieved from microservice.").alias("error_message"),
    )
