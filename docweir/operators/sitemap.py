"""Sitemaps: parse, scope and version filters, bounded expansion, source choice.

``files`` is ``(url, body)``: one row per fetched sitemap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir import params
from docweir.functions import paths, urls
from docweir.functions.text import strip
from docweir.session import cut_lineage

_ENTRY = "array<struct<loc:string,lastmod:string>>"
_XML = f"url {_ENTRY}, sitemap {_ENTRY}"


def parse(files: DataFrame) -> DataFrame:
    """Add ``entries`` and ``subs`` to sitemap files; malformed bodies give none of either.

    XML may carry any namespace prefix; other bodies are one address per line.
    """
    body = strip(F.col("body"))
    bare = F.regexp_replace(body, r"(</?)[A-Za-z0-9_.-]+:", "$1")
    xml = F.from_xml(bare, _XML)

    def cleaned(entries: Column) -> Column:
        present = F.filter(entries, lambda e: e["loc"].isNotNull() & e["loc"].rlike(r"\S"))
        trimmed = F.transform(
            present, lambda e: F.struct(strip(e["loc"]).alias("loc"), strip(e["lastmod"]).alias("lastmod"))
        )
        return F.coalesce(trimmed, F.array().cast(_ENTRY))

    lines = F.filter(
        F.transform(F.split(body, "\r\n|\r|\n"), strip),
        lambda u: (u != "") & ~F.startswith(u, F.lit("#")),
    )
    plain = F.transform(
        lines, lambda u: F.struct(u.alias("loc"), F.lit(None).cast("string").alias("lastmod"))
    )
    is_xml = F.startswith(body, F.lit("<"))
    # a list holds pages or other sitemaps, never both
    root = F.regexp_extract(bare, r"(?s)^(?:<\?.*?\?>|<!--.*?-->|\s)*<([A-Za-z]+)", 1)
    is_urlset, is_index_file = root == "urlset", root == "sitemapindex"
    return files.withColumn("_x", F.when(is_xml, xml)).select(
        *files.columns,
        F.when(is_xml & is_urlset, cleaned(F.col("_x.url"))).when(is_xml, F.array().cast(_ENTRY))
        .otherwise(plain).alias("entries"),
        F.when(is_xml & is_index_file, cleaned(F.col("_x.sitemap"))).otherwise(F.array().cast(_ENTRY)).alias("subs"),
    )


def is_index(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("is_index", F.size("subs") > 0)


def could_hold(sitemap_url: Column, prefix: Column) -> Column:
    """True when the sitemap lies in scope, or the scope lies below the sitemap's folder."""
    return urls.in_scope(sitemap_url, prefix) | urls.in_scope(prefix, urls.scope_prefix(sitemap_url))


def language_fits(sitemap_url: Column, base_url: Column) -> Column:
    """Language codes in the sitemap's name must agree with the base address's own code."""
    base = paths.first_language(urls.segments(urls.path(base_url)))
    stem = F.regexp_replace(urls.path(sitemap_url), r"\.[^.]*$", "")
    parts = F.filter(F.split(stem, "[/_-]"), lambda s: s != "")
    own = paths.first_language(parts)
    return (
        base.isNull()
        | own.isNull()
        | (own == base)
        | F.startswith(base, F.concat(own, F.lit("-")))
        | F.startswith(own, F.concat(base, F.lit("-")))
    )


def newest_subs(subs: DataFrame, keys: list[str]) -> DataFrame:
    """Of the sub-sitemaps of one product keep one: a latest folder, else the newest version.

    ``subs`` rows are ``keys + (pos, loc)``. Entries without a version segment all
    stay. A group is the versions listed by one sitemap file.
    """
    segs = urls.segments(urls.path(F.col("loc")))
    keyed = subs.withColumn("_segs", segs).withColumn("_at", paths.version_index(F.col("_segs")))
    keyed = keyed.withColumn(
        "_product", F.array_join(F.slice("_segs", F.lit(1), (F.col("_at") - 1).cast("int")), "/")
    )
    latest = F.lit(False)
    for word in paths.LATEST_WORDS:
        latest = latest | F.contains(F.col("loc"), F.lit(f"/{word}/"))
    zero = F.array(F.lit(0).cast("bigint"))
    newest = F.array_max(
        F.transform(F.col("_segs"), lambda s: F.coalesce(paths.parse_version(s), zero))
    )
    # versions only win when they beat zero; until then the first entry stands
    newest = F.when(newest > zero, newest).otherwise(zero)
    plain = keyed.where(F.col("_at").isNull()).select(*subs.columns)
    best = (
        keyed.where(F.col("_at").isNotNull())
        .groupBy(*keys, "_product")
        .agg(
            F.max_by(
                F.struct("pos", "loc"),
                F.struct(latest, F.when(latest, zero).otherwise(newest), -F.col("pos")),
            ).alias("_best")
        )
        .select(*keys, "_best.pos", "_best.loc")
    )
    return plain.unionByName(best.select(*subs.columns))


def expand(roots: DataFrame, files: DataFrame, sites: DataFrame, max_depth: int = params.MAX_DEPTH) -> DataFrame:
    """Follow sitemap indexes down to page addresses.

    ``roots`` is ``(site_id, source_rank, root_pos, url)``. The result adds
    ``order_key``, the positions on the way down, which sorts the addresses the
    way a depth-first reading lists them. Sitemaps that are missing yield nothing.
    """
    parsed = cut_lineage(parse(files.select("url", "body")))  # parsed once, read on every level
    frontier = roots.select(
        "site_id", "source_rank", F.array(F.col("root_pos").cast("bigint")).alias("order_key"), "url"
    ).join(sites.select("site_id", "base_url"), "site_id")
    prefix = urls.scope_prefix(F.col("base_url"))
    pages = None
    for depth in range(max_depth):
        opened = frontier.join(parsed, "url")
        found = opened.select(
            "site_id",
            "source_rank",
            "order_key",
            "base_url",
            F.posexplode(F.when(F.size("subs") == 0, F.col("entries")).otherwise(F.array().cast(_ENTRY))).alias("pos", "e"),
        ).select(
            "site_id",
            "source_rank",
            F.array_append("order_key", F.col("pos").cast("bigint")).alias("order_key"),
            F.col("e.loc").alias("url"),
            F.col("e.lastmod").alias("lastmod"),
            "base_url",
        )
        kept = found.where(urls.in_scope(F.col("url"), prefix)).drop("base_url")
        pages = kept if pages is None else pages.unionByName(kept)
        if depth + 1 == max_depth:
            break
        keys = ["site_id", "source_rank", "order_key", "base_url"]
        subs = opened.select(*keys, F.posexplode("subs").alias("pos", "s")).select(
            *keys, F.col("pos").cast("bigint").alias("pos"), F.col("s.loc").alias("loc")
        )
        subs = subs.where(
            could_hold(F.col("loc"), prefix) & language_fits(F.col("loc"), F.col("base_url"))
        )
        frontier = newest_subs(subs, keys).select(
            "site_id",
            "source_rank",
            F.array_append("order_key", F.col("pos")).alias("order_key"),
            F.col("loc").alias("url"),
            "base_url",
        )
    return pages


def collect(sites: DataFrame, declared: DataFrame, files: DataFrame, max_depth: int = params.MAX_DEPTH) -> DataFrame:
    """Page addresses of each site: from declared sitemaps, else from the nearest folder's own.

    ``declared`` is ``(site_id, root_pos, url)`` from robots files. Declared
    sitemaps rank 0; the base address's folders follow, deepest first, and only
    the first source with any address counts.
    """
    guesses = sites.select("site_id", F.posexplode(urls.ancestors(F.col("base_url"))).alias("i", "folder")).select(
        "site_id",
        (F.col("i") + 1).alias("source_rank"),
        F.lit(0).cast("bigint").alias("root_pos"),
        F.concat(F.regexp_replace("folder", "/+$", ""), F.lit("/sitemap.xml")).alias("url"),
    )
    roots = declared.select("site_id", F.lit(0).alias("source_rank"), "root_pos", "url").unionByName(guesses)
    pages = expand(roots, files, sites, max_depth)
    best = pages.groupBy("site_id").agg(F.min("source_rank").alias("source_rank"))
    return pages.join(best, ["site_id", "source_rank"])
