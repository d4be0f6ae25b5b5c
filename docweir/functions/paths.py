"""Version and language segments of URL paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweir.functions import urls

# Fixed values.
LATEST_WORDS = ("current", "latest", "next", "stable", "main")
ENGLISH = ("en", "en-us", "en-gb")
VERSION_PATTERN = r"^v?[0-9]+(\.[0-9]+)*(\.x)?$"
LANGUAGE_PATTERN = r"^[a-z]{2}(-[a-z]{2,3})?$"
LATEST_RANK = 9999


def is_version(seg: Column) -> Column:
    return seg.isin(*LATEST_WORDS) | seg.rlike(VERSION_PATTERN)


def is_language(seg: Column) -> Column:
    return seg.rlike(LANGUAGE_PATTERN)


def version_index(segs: Column) -> Column:
    """1-based index of the first version-like segment, null when there is none."""
    return F.nullif(
        F.array_position(F.transform(segs, is_version), F.lit(True)), F.lit(0).cast("bigint")
    )


def version_segment(segs: Column) -> Column:
    return F.try_element_at(F.filter(segs, is_version), F.lit(1))


def parse_version(seg: Column) -> Column:
    """Segment -> array of numbers that compares like a version; null when it is none."""
    bare = F.regexp_replace(seg, "^version-", "")
    digits = F.regexp_extract(bare, r"^v?([0-9]+(?:\.[0-9]+)*)(?:\.x)?$", 1)
    return F.when(
        seg.isin(*LATEST_WORDS), F.array(F.lit(LATEST_RANK).cast("bigint"))
    ).when(digits != "", F.transform(F.split(digits, r"\."), lambda p: p.try_cast("bigint")))


def first_language(segs: Column) -> Column:
    return F.try_element_at(F.filter(segs, is_language), F.lit(1))


def base_folder(base_url: Column) -> Column:
    return F.concat(F.regexp_replace(urls.path(base_url), "/+$", ""), F.lit("/"))


def url_language(url: Column, base_url: Column) -> Column:
    """Language of a URL below a base address, falling back to the base's own language."""
    p, base = urls.path(url), base_folder(base_url)
    under = F.startswith(p, base)
    rest = F.when(under, F.substring(p, F.length(base) + 1, F.length(p))).otherwise(p)
    own = first_language(urls.segments(rest))
    inherited = F.when(under, first_language(urls.segments(urls.path(base_url))))
    return F.coalesce(own, inherited)
