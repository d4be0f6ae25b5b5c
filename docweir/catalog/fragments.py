"""DuckDB fragments the oracles share."""

from __future__ import annotations


def path(u: str) -> str:
    return (
        f"regexp_replace(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"
    )


def origin(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([A-Za-z]+://[^/?#]*)', 1))"


def norm(u: str) -> str:
    p = f"rtrim({path(u)}, '/')"
    return f"({origin(u)} || CASE WHEN {p} = '' THEN '/' ELSE {p} END)"


def segs(p: str) -> str:
    return f"list_filter(string_split({p}, '/'), lambda s: s <> '')"


VERSION = "regexp_matches({s}, '^(current|latest|next|stable|main|v?[0-9]+([.][0-9]+)*([.]x)?)$')"


def is_version(s: str) -> str:
    return VERSION.format(s=s)


def version_seg(p: str) -> str:
    return f"list_filter({segs(p)}, lambda v: {is_version('v')})[1]"


def version_key(s: str) -> str:
    digits = f"regexp_extract({s}, '^v?([0-9]+(?:[.][0-9]+)*)', 1)"
    return (
        f"(CASE WHEN {s} IN ('current','latest','next','stable','main') THEN [9999::BIGINT] "
        f"ELSE list_transform(string_split({digits}, '.'), lambda d: TRY_CAST(d AS BIGINT)) END)"
    )


def lang_seg(p: str) -> str:
    return f"list_filter({segs(p)}, lambda v: regexp_matches(v, '^[a-z][a-z](-[a-z][a-z][a-z]?)?$'))[1]"


def prefix(u: str) -> str:
    p = f"rtrim({path(u)}, '/')"
    return (
        f"({origin(u)} || rtrim(CASE WHEN regexp_matches({p}, '/[^/]*[.][a-zA-Z]{{1,5}}$') "
        f"THEN regexp_extract({p}, '^(.*)/[^/]*$', 1) ELSE {p} END, '/'))"
    )


def in_scope(u: str, pre: str) -> str:
    return f"({u} = {pre} OR starts_with({u}, {pre} || '/'))"


def url_lang(u: str, base: str) -> str:
    folder = f"(rtrim({path(base)}, '/') || '/')"
    under = f"starts_with({path(u)}, {folder})"
    rest = f"CASE WHEN {under} THEN substr({path(u)}, length({folder}) + 1) ELSE {path(u)} END"
    return f"coalesce({lang_seg('(' + rest + ')')}, CASE WHEN {under} THEN {lang_seg(path(base))} END)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\S+'))"


def tokens(x: str) -> str:
    return f"CAST(floor({words(x)} * 1.33::DOUBLE) AS BIGINT)"
