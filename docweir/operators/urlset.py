"""Operators over sets of URLs: dedupe, scope, language, version, cap.

Rows are ``(site_id, pos, url)``; ``sites`` is ``(site_id, base_url)``. A site
may hold a third of all rows, so no operator sorts or collects a whole site:
duplicates, languages and versions are folded by partial aggregates, and the
page cap is a ranked window whose group limit runs before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweir import params
from docweir.functions import paths, urls
from docweir.operators.blocks import first_rows


def first_seen(rows: DataFrame) -> DataFrame:
    """One row per normalised URL and site, at its earliest position."""
    return (
        rows.select("site_id", "pos", urls.normalize(F.col("url")).alias("url"))
        .groupBy("site_id", "url")
        .agg(F.min("pos").alias("pos"))
        .select("site_id", "pos", "url")
    )


def within_scope(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Keep the URLs below the site's base address."""
    prefixes = sites.select("site_id", urls.scope_prefix(F.col("base_url")).alias("_prefix"))
    return (
        rows.join(prefixes, "site_id")
        .where(urls.in_scope(F.col("url"), F.col("_prefix")))
        .drop("_prefix")
    )


def same_version(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """When the base address names a version, keep URLs of that version or of none."""
    base = sites.select(
        "site_id",
        paths.version_segment(urls.segments(urls.path(F.col("base_url")))).alias("_base"),
    )
    own = paths.version_segment(urls.segments(urls.path(F.col("url"))))
    return (
        rows.join(base, "site_id")
        .where(F.col("_base").isNull() | own.isNull() | (own == F.col("_base")))
        .drop("_base")
    )


def one_language(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Sites seen in two or more languages keep English, or else what has no language."""
    tagged = rows.join(sites.select("site_id", "base_url"), "site_id").withColumn(
        "_lang", paths.url_language(F.col("url"), F.col("base_url"))
    )
    codes = tagged.groupBy("site_id", "_lang").agg(F.lit(1).alias("_one"))
    english = [
        F.max(F.when(F.col("_lang") == code, F.lit(code))) for code in paths.ENGLISH
    ]
    choice = codes.groupBy("site_id").agg(
        F.count("_lang").alias("_codes"), F.coalesce(*english).alias("_pick")
    )
    return (
        tagged.join(choice, "site_id")
        .where((F.col("_codes") < 2) | F.col("_lang").eqNullSafe(F.col("_pick")))
        .select(*rows.columns)
    )


def newest_version(rows: DataFrame, first_rank=lambda c: -c) -> DataFrame:
    """Keep, of pages that differ only in their version segment, the newest version.

    Adds ``is_versioned`` and ``group_pos``: unversioned pages come first, then the
    version groups by first appearance. ``pos`` may be of any ordered type;
    ``first_rank`` turns it into a key that grows towards the front.
    """
    pos_type = rows.schema["pos"].dataType
    segs = urls.segments(urls.path(F.col("url")))
    parted = rows.withColumn("_segs", segs).withColumn("_at", paths.version_index(F.col("_segs")))
    keyed = parted.select(
        *rows.columns,
        F.array_join(F.slice("_segs", F.lit(1), (F.col("_at") - 1).cast("int")), "/").alias("_head"),
        F.when(
            F.col("_at").isNotNull(),
            F.array_join(F.slice("_segs", (F.col("_at") + 1).cast("int"), F.size("_segs") + 1), "/"),
        ).alias("_tail"),
        F.try_element_at("_segs", F.col("_at").cast("int")).alias("_ver"),
    )
    plain = keyed.where(F.col("_ver").isNull()).select(
        *rows.columns, F.lit(False).alias("is_versioned"), F.lit(None).cast(pos_type).alias("group_pos")
    )
    versioned = keyed.where(F.col("_ver").isNotNull())
    group = ["site_id", "_head", "_tail"]
    per_segment = versioned.groupBy(*group, "_ver").agg(F.min("pos").alias("_first"))
    best = per_segment.groupBy(*group).agg(
        F.max_by(
            "_ver", F.struct(paths.parse_version(F.col("_ver")), first_rank(F.col("_first")))
        ).alias("_ver"),
        F.min("_first").alias("group_pos"),
    )
    kept = versioned.join(best, [*group, "_ver"]).select(
        *rows.columns, F.lit(True).alias("is_versioned"), "group_pos"
    )
    return plain.unionByName(kept)


def cap_pages(rows: DataFrame, max_pages: int = params.MAX_PAGES, order=("is_versioned", "group_pos", "pos")) -> DataFrame:
    """The first ``max_pages`` rows of every site, numbered by ``rank``."""
    return first_rows(rows, "site_id", [F.col(c) for c in order], max_pages, "rank", order[-1])


def probe_url(rows: DataFrame, order: str = "rank") -> DataFrame:
    """The page that decides a site's fetch method: its first URL that is not the root."""
    return rows.groupBy("site_id").agg(
        F.min_by("url", F.struct(urls.is_root(F.col("url")), F.col(order))).alias("probe_url")
    )
