"""URL expressions. Everything here is a Column built from JVM-side string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings and schemes that never lead to a documentation page.
ASSET_ENDINGS = (
    "pdf", "zip", "tar", "gz", "rar", "7z", "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "css", "js", "woff",
    "woff2", "ttf", "eot", "mp3", "mp4", "avi", "mov", "wmv", "xml", "json", "yaml", "yml", "toml", "exe", "dmg",
    "deb", "rpm",
)
IGNORED_SCHEMES = ("mailto", "javascript", "tel", "ftp", "data")

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _NETLOC, 1))


def path(url: Column) -> Column:
    """Path without query, fragment and the ``;params`` of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _PATH, 1), ";[^/]*$", "")


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), domain(url))


def _trim_slashes(p: Column) -> Column:
    return F.regexp_replace(p, "/+$", "")


def normalize(url: Column) -> Column:
    """Lower-case scheme and host, no params, query or fragment, no trailing slash but at the root."""
    trimmed = _trim_slashes(path(url))
    sch, net = scheme(url), domain(url)
    return F.concat(
        F.when(sch == "", F.lit("")).otherwise(F.concat(sch, F.lit(":"))),
        F.when(net == "", F.lit("")).otherwise(F.concat(F.lit("//"), net)),
        F.when(trimmed == "", F.lit("/")).otherwise(trimmed),
    )


def same_domain(a: Column, b: Column) -> Column:
    return domain(a) == domain(b)


def is_asset(url: Column) -> Column:
    endings = r"\.(?:" + "|".join(ASSET_ENDINGS) + ")$"
    return scheme(url).isin(*IGNORED_SCHEMES) | F.lower(path(url)).rlike(endings)


def is_absolute(url: Column) -> Column:
    return F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))


def is_root(url: Column) -> Column:
    return _trim_slashes(path(url)) == ""


def has_md_ending(url: Column) -> Column:
    return F.endswith(_trim_slashes(url), F.lit(".md"))


def strip_git(name: Column) -> Column:
    return F.regexp_replace(name, r"\.git$", "")


def segments(p: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(p, "/"), lambda s: s != "")


def ancestors(url: Column) -> Column:
    """The URL's directory chain, deepest first, ending in the origin.

    The cut points are the slashes of the trimmed path, read off its raw split
    so that doubled slashes stay visible in the results.
    """
    parts = F.split(_trim_slashes(path(url)), "/")
    steps = F.sequence(F.size(parts), F.lit(1), F.lit(-1))
    joined = F.transform(
        steps, lambda n: F.concat(origin(url), F.array_join(F.slice(parts, F.lit(1), n), "/"))
    )
    return joined


def scope_prefix(url: Column) -> Column:
    """Directory of the URL: a last segment that looks like a file name is dropped."""
    trimmed = _trim_slashes(path(url))
    folder = _trim_slashes(F.regexp_replace(trimmed, r"/[^/]*\.[a-zA-Z]{1,5}$", ""))
    return F.concat(origin(url), folder)


def in_scope(url: Column, prefix: Column) -> Column:
    return (url == prefix) | F.startswith(url, F.concat(prefix, F.lit("/")))


def link_base(url: Column) -> Column:
    """Base for relative links: directory-like addresses get a closing slash."""
    last = F.regexp_extract(url, "([^/]*)$", 1)
    return F.when(
        F.endswith(url, F.lit("/")) | last.rlike(r"\.[a-zA-Z]{2,4}$"), url
    ).otherwise(F.concat(url, F.lit("/")))


def _dot_free(p: Column) -> Column:
    """Remove ``.`` and ``..`` segments by folding the segments left to right."""
    parts = F.split(p, "/")
    n = F.size(parts)
    folded = F.aggregate(
        F.transform(parts, lambda s, i: F.struct(s.alias("s"), (i == n - 1).alias("last"))),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(
            seg["s"] == "..",
            F.concat(
                F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc),
                F.when(seg["last"], F.array(F.lit(""))).otherwise(F.array().cast("array<string>")),
            ),
        )
        .when(
            seg["s"] == ".",
            F.when(seg["last"], F.array_append(acc, F.lit(""))).otherwise(acc),
        )
        .otherwise(F.array_append(acc, seg["s"])),
    )
    return F.array_join(folded, "/")


def resolve(base: Column, href: Column) -> Column:
    """RFC 3986 reference resolution as one expression."""
    b_scheme, b_net = scheme(base), F.regexp_extract(base, _NETLOC, 1)
    root = F.concat(b_scheme, F.lit("://"), b_net)
    b_path = F.regexp_extract(base, _PATH, 1)
    b_dir = F.regexp_replace(b_path, "[^/]*$", "")
    b_dir = F.when(b_dir == "", F.lit("/")).otherwise(b_dir)
    h_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    h_rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    b_no_fragment = F.regexp_extract(base, r"^([^#]*)", 1)
    b_no_query = F.regexp_extract(base, r"^([^?#]*)", 1)

    def cleaned(p: Column) -> Column:
        return F.when(p.rlike(r"(^|/)\.\.?(/|$)"), _dot_free(p)).otherwise(p)

    return (
        F.when(href == "", base)
        .when(href.rlike(_SCHEME), href)
        .when(F.startswith(href, F.lit("//")), F.concat(b_scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("#")), F.concat(b_no_fragment, href))
        .when(F.startswith(href, F.lit("?")), F.concat(b_no_query, href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, cleaned(h_path), h_rest))
        .otherwise(F.concat(root, cleaned(F.concat(b_dir, h_path)), h_rest))
    )


def repo_address(url: Column) -> Column:
    """Repository address -> struct(owner, repo, branch, subpath); null when it is none."""
    host = r"(?:https?://)?github\.com/"
    owner = F.regexp_extract(url, host + r"([^/\s]+)/[^/\s?#]+", 1)
    repo = strip_git(F.regexp_extract(url, host + r"[^/\s]+/([^/\s?#]+)", 1))
    tree = host + r"[^/\s]+/[^/\s?#]+/tree/([^/\s?#]+)(?:/([^\s?#]+))?"
    branch = F.regexp_extract(url, tree, 1)
    subpath = _trim_slashes(F.regexp_extract(url, tree, 2))
    return F.when(
        owner != "",
        F.struct(
            owner.alias("owner"),
            repo.alias("repo"),
            F.nullif(branch, F.lit("")).alias("branch"),
            F.nullif(subpath, F.lit("")).alias("subpath"),
        ),
    )
