"""Page snapshots: which fetched bodies count as pages, and which variant of a page wins.

A snapshot row is ``(site_id, url, variant, status, content_type, body)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir.functions import markdown, urls
from docweir.functions.text import strip


def _markdown_page(rows: DataFrame) -> DataFrame:
    body = strip(F.col("body"))
    return rows.select(
        "site_id",
        "url",
        markdown.title(body).alias("title"),
        markdown.strip_front_matter(body).alias("content"),
    )


def negotiated_pages(snapshots: DataFrame) -> DataFrame:
    """Bodies served as Markdown on request."""
    return _markdown_page(
        snapshots.where(
            (F.col("variant") == "negotiated")
            & (F.col("status") == 200)
            & F.contains("content_type", F.lit("text/markdown"))
            & F.col("body").rlike(r"\S")
        )
    )


def markdown_url(url: Column) -> Column:
    return F.when(urls.has_md_ending(url), url).otherwise(
        F.concat(F.regexp_replace(url, "/+$", ""), F.lit(".md"))
    )


def sibling_pages(snapshots: DataFrame) -> DataFrame:
    """Bodies of the ``.md`` siblings that are text and not an HTML error page."""
    served = F.contains("content_type", F.lit("text/markdown")) | F.contains(
        "content_type", F.lit("text/plain")
    )
    return _markdown_page(
        snapshots.where(
            (F.col("variant") == "md")
            & (F.col("status") == 200)
            & served
            & F.col("body").rlike(r"\S")
            & ~F.col("body").rlike(r"^\s*<!")
        )
    )


def html_snapshots(snapshots: DataFrame) -> DataFrame:
    """Rows worth an HTML extraction; what extracts to nothing is dropped after it."""
    return snapshots.where(
        (F.col("variant") == "html")
        & (F.col("status") == 200)
        & F.contains("content_type", F.lit("text/html"))
    )


def one_per_url(pages: DataFrame) -> DataFrame:
    """A single page per address when it was fetched more than once."""
    return pages.groupBy("site_id", "url").agg(F.max(F.struct("title", "content")).alias("_p")).select(
        "site_id", "url", "_p.title", "_p.content"
    )


def fetch_pages(plan: DataFrame, snapshots: DataFrame, html_pages: DataFrame) -> DataFrame:
    """Resolve each planned URL to the page variant the site's probe calls for.

    ``plan`` is ``(site_id, rank, url)`` and ``html_pages`` is ``(site_id, url,
    title, content)`` extracted from the HTML snapshots. The probe is the first
    URL that is not the root; the variant that answers it is the site's
    preference, and pages without that variant fall through to HTML.
    """
    url = F.col("url")
    neg = one_per_url(negotiated_pages(snapshots)).withColumnsRenamed({"title": "_nt", "content": "_nc"})
    sib = one_per_url(sibling_pages(snapshots)).withColumnsRenamed({"url": "_md_url", "title": "_mt", "content": "_mc"})
    htm = one_per_url(html_pages.where(F.col("content") != "")).withColumnsRenamed({"title": "_ht", "content": "_hc"})
    rows = (
        plan.withColumn("_md_url", markdown_url(url))
        .join(neg, ["site_id", "url"], "left")
        .join(sib, ["site_id", "_md_url"], "left")
        .join(htm, ["site_id", "url"], "left")
    )
    is_md, is_root = urls.has_md_ending(url), urls.is_root(url)
    has_neg, has_sib = F.col("_nc").isNotNull(), F.col("_mc").isNotNull()
    probe_method = (
        F.when(~is_md & has_neg, "content_negotiation")
        .when(~is_root & has_sib, "md_url")
        .otherwise("html")
    )
    preference = rows.groupBy("site_id").agg(
        F.min_by(
            F.struct(F.col("rank").alias("probe_rank"), probe_method.alias("preferred")),
            F.struct(is_root, F.col("rank")),
        ).alias("_p")
    ).select("site_id", "_p.*")
    pref = F.col("preferred")
    method = (
        F.when(F.col("rank") == F.col("probe_rank"), probe_method)
        .when(is_md, F.when(has_sib, "md_url").otherwise("html"))
        .when((pref == "content_negotiation") & has_neg, "content_negotiation")
        .when(pref.isin("content_negotiation", "md_url") & ~is_root & has_sib, "md_url")
        .otherwise("html")
    )

    def pick(n: str, m: str, h: str) -> Column:
        return (
            F.when(F.col("method") == "content_negotiation", F.col(n))
            .when(F.col("method") == "md_url", F.col(m))
            .otherwise(F.col(h))
        )

    return (
        rows.join(preference, "site_id")
        .withColumn("method", method)
        .select(
            "site_id",
            # the probe page comes first, the others keep the plan's order
            F.when(F.col("rank") == F.col("probe_rank"), 0).otherwise(F.col("rank")).alias("rank"),
            "url",
            "preferred",
            "method",
            pick("_nt", "_mt", "_ht").alias("title"),
            pick("_nc", "_mc", "_hc").alias("content"),
        )
        .where(F.col("content").isNotNull())
    )
