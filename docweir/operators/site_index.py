"""Site index files: Markdown lists of links, or a whole documentation in one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir import params
from docweir.functions import urls
from docweir.functions.text import strip
from docweir.operators import robots

LINK = r"^-\s*\[([^\]]+)\]\(([^)]+)\)(?:\s*:\s*(.+))?$"

# Names to probe in every folder, the full file first.
FILE_NAMES = (("llms-full.txt", True), ("llms.txt", False))


def _lines(body: Column) -> Column:
    return F.transform(F.split(body, "\r\n|\r|\n"), strip)


#: The line end in front of a level-two heading.
_BEFORE_HEADING = r"(?:\r\n|\r|\n)(?=[^\S\r\n]*## [^\S\r\n]*\S)"


def links(files: DataFrame) -> DataFrame:
    """Link lines of each file ``(file_id, url, body)`` with their section.

    A body is cut at its headings, so that each part knows its section, and only link lines
    leave their row: nothing is shuffled or sorted.
    """
    parts = files.select("file_id", F.col("url").alias("file_url"), F.transform(F.split("body", _BEFORE_HEADING), _lines).alias("_parts"))
    cut = parts.select("file_id", "file_url", F.transform("_parts", F.size).alias("_sizes"), F.posexplode("_parts").alias("_nth", "_part"))
    above = F.aggregate(F.slice("_sizes", F.lit(1), F.col("_nth")), F.lit(0), lambda n, size: n + size)
    first = F.get("_part", F.lit(0))
    hits = F.filter(F.transform("_part", lambda line, i: F.struct(i.alias("i"), line.alias("line"))), lambda x: x["line"].rlike(LINK))
    rows = cut.select(
        "file_id", "file_url", above.alias("_above"),
        F.when(F.startswith(first, F.lit("## ")), strip(F.substring(first, 4, 1 << 30))).alias("section"),
        F.explode(hits).alias("_hit"),
    )
    line = F.col("_hit.line")
    href = F.regexp_extract(line, LINK, 2)
    return rows.select(
        "file_id",
        (F.col("_above") + F.col("_hit.i")).alias("pos"),
        F.regexp_extract(line, LINK, 1).alias("title"),
        F.when(urls.is_absolute(href) | (F.col("file_url") == ""), href).otherwise(urls.resolve(F.col("file_url"), href)).alias("url"),
        F.nullif(F.regexp_extract(line, LINK, 3), F.lit("")).alias("description"),
        "section",
        F.coalesce(F.lower("section") == "optional", F.lit(False)).alias("optional"),
    )


def is_wanted() -> Column:
    """Links worth fetching: all but the optional ones."""
    return ~F.col("optional")


def wanted(found: DataFrame) -> DataFrame:
    return found.where(is_wanted())


def title(body: Column) -> Column:
    """First level-one heading."""
    hits = F.filter(_lines(body), lambda x: F.startswith(x, F.lit("# ")))
    return strip(F.substring(F.try_element_at(hits, F.lit(1)), 3, 1 << 30))


def summary(body: Column) -> Column:
    """The first run of quote lines after the title, joined by spaces; null without one.

    Lines before the run and headings inside it do not end it; anything else does.
    """
    lines = _lines(body)
    marked = F.transform(
        lines,
        lambda x: F.when(F.startswith(x, F.lit("# ")), "t").when(F.startswith(x, F.lit(">")), "q").otherwise("o"),
    )
    # after the title: the first quote line, and the first other line behind it
    codes = F.array_join(marked, "")
    start = F.length(F.regexp_extract(codes, "^([^t]*t[^q]*)", 1))
    run = F.length(F.regexp_extract(codes, "^[^t]*t[^q]*([qt]*)", 1))
    quoted = F.filter(
        F.slice(lines, start + 1, F.greatest(run, F.lit(0))), lambda x: F.startswith(x, F.lit(">"))
    )
    text = F.transform(quoted, lambda x: strip(F.regexp_replace(x, "^[> ]+", "")))
    return F.when(F.contains(codes, F.lit("t")) & (run > 0), F.array_join(text, " "))


def is_full(body: Column) -> Column:
    """Long files with few link lines hold the documentation itself."""
    lines = F.filter(_lines(body), lambda x: x != "")
    n = F.size(lines)
    hits = F.size(F.filter(lines, lambda x: x.rlike(LINK)))
    return (n >= params.INDEX_MIN_LINES) & (F.try_divide(hits, n) < params.INDEX_LINK_RATIO)


def has_links(body: Column) -> Column:
    return F.exists(_lines(body), lambda x: x.rlike(LINK))


def probe(sites: DataFrame, rules: DataFrame, files: DataFrame, skip_full: bool = False) -> tuple[DataFrame, DataFrame]:
    """Choose each site's index file and count the candidates its policy forbids.

    Candidates are both names in every folder from the base address up. The first
    one that robots rules and the content signal allow and that was served as
    non-empty text wins. Returns ``(chosen, drops)``; candidates dropped by the
    content signal count as robots drops.
    """
    names = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(full).alias("full")) for n, full in FILE_NAMES if not (full and skip_full)]
    )
    rows = (
        sites.select("site_id", F.posexplode(urls.ancestors(F.col("base_url"))).alias("depth", "folder"))
        .select("site_id", "depth", "folder", F.posexplode(names).alias("nth", "n"))
        .select(
            "site_id",
            (F.col("depth") * 2 + F.col("nth")).alias("rank"),
            F.concat(F.regexp_replace("folder", "/+$", ""), F.lit("/"), F.col("n.name")).alias("url"),
            F.col("n.full").alias("named_full"),
        )
    )
    decided = robots.decide(rows, rules)
    ok = F.col("robots_ok") & ~robots.is_dropped_by_signal()
    served = files.where(
        (F.col("status") == 200)
        & ~F.coalesce(F.contains("content_type", F.lit("text/html")), F.lit(False))
        & F.col("body").rlike(r"\S")
    ).select("url", "final_url", strip(F.col("body")).alias("body"))
    hits = decided.where(ok).join(served, "url")
    chosen = hits.groupBy("site_id").agg(
        F.min_by(F.struct("rank", "url", "final_url", "body", "named_full"), "rank").alias("_b")
    ).select("site_id", "_b.*")
    redirected = F.endswith(F.lower("final_url"), F.lit("llms.txt"))
    as_full = F.col("named_full") & ~redirected
    full = is_full(F.col("body"))
    chosen = chosen.withColumn("is_full", F.when(as_full, ~has_links(F.col("body")) | full).otherwise(full))
    # only candidates probed before the winner was found are counted
    drops = (
        decided.join(chosen.select("site_id", F.col("rank").alias("_won")), "site_id", "left")
        .where(~ok & (F.col("_won").isNull() | (F.col("rank") < F.col("_won"))))
        .groupBy("site_id")
        .agg(F.count(F.lit(1)).alias("dropped_robots"))
    )
    return chosen.drop("named_full", "rank"), drops
