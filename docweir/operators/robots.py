"""robots.txt, content signals and robots directives.

A file is one row and its parsed rules come back as one row per site, so a URL
meets its site's rules in a one-to-one join and is decided inside its own row:
no URL x rule rows are ever emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweir import params
from docweir.functions import urls
from docweir.functions.text import let

# Fixed values.
SIGNALS = ("search", "ai-input", "ai-train")
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"

RULES_TYPE = "array<struct<rule:string,allow:boolean,plain:boolean,pattern:string>>"
SIGNALS_TYPE = "array<struct<path:string,line:int,at:int,signal:string,value:boolean>>"


def normalize_path(p: Column) -> Column:
    """Decode percent escapes of unreserved characters and upper-case the others."""

    def piece(s: Column, i: Column) -> Column:
        escape = F.upper(F.substring(s, 1, 2))
        # an escape decodes only when its byte is one of the unreserved characters
        char = F.chr(F.conv(escape, 16, 10).cast("int"))
        rest = F.substring(s, F.lit(3), F.length(s))
        return (
            F.when(i == 0, s)
            .when(~s.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.lit("%"), s))
            .when(F.contains(F.lit(UNRESERVED), char) & (char != ""), F.concat(char, rest))
            .otherwise(F.concat(F.lit("%"), escape, rest))
        )

    decoded = F.array_join(F.transform(F.split(p, "%"), piece), "")
    return F.when(F.contains(p, F.lit("%")), decoded).otherwise(p)


def directives(files: DataFrame) -> DataFrame:
    """robots files ``(site_id, body)`` -> ``(site_id, pos, key, value)`` lines."""
    lines = files.select("site_id", F.posexplode(F.split("body", "\r\n|\r|\n")).alias("pos", "line"))
    bare = F.trim(F.regexp_replace("line", "#.*$", ""))
    pattern = r"^([A-Za-z-]+)\s*:\s*(.*)$"
    return (
        lines.withColumn("line", bare)
        .where(F.col("line").rlike(pattern))
        .select(
            "site_id",
            "pos",
            F.lower(F.regexp_extract("line", pattern, 1)).alias("key"),
            F.trim(F.regexp_extract("line", pattern, 2)).alias("value"),
        )
    )


def signal_pairs(value: Column) -> Column:
    """Content-Signal value -> array of (path, signal, value); empty when nothing is valid."""
    has_path = F.startswith(value, F.lit("/"))
    spaced = value.rlike(r"^\S+\s+\S")
    where = F.when(has_path, normalize_path(F.regexp_extract(value, r"^(\S+)", 1))).otherwise(F.lit("/"))
    pairs = F.when(has_path & spaced, F.regexp_extract(value, r"^\S+\s+(.*)$", 1)).when(
        ~has_path, value
    )
    parsed = F.transform(
        F.split(F.coalesce(pairs, F.lit("")), ","),
        lambda s: F.struct(
            where.alias("path"),
            F.lower(F.trim(F.regexp_extract(s, "^([^=]*)=", 1))).alias("signal"),
            F.lower(F.trim(F.regexp_extract(s, "^[^=]*=(.*)$", 1))).alias("flag"),
        ),
    )
    valid = F.filter(parsed, lambda s: s["signal"].isin(*SIGNALS) & s["flag"].isin("yes", "no"))
    return F.transform(
        valid,
        lambda s: F.struct(
            s["path"].alias("path"), s["signal"].alias("signal"), (s["flag"] == "yes").alias("value")
        ),
    )


def grouped_directives(lines: DataFrame) -> DataFrame:
    """Number the user-agent groups of each file.

    An agent line opens a group when the closest agent or rule line above it is a
    rule, or when there is none; crawl delays do not end a group's agent list.
    The windows run over the lines of one file, which is one input row.
    """
    is_agent = F.col("key") == "user-agent"
    is_rule = (F.col("key").isin("allow", "disallow") & (F.col("value") != "")) | (
        (F.col("key") == "content-signal") & (F.size(signal_pairs(F.col("value"))) > 0)
    )
    order = Window.partitionBy("site_id").orderBy("pos")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(is_agent, F.lit("agent")).when(is_rule, F.lit("rule"))
    return (
        lines.where(F.col("key") != "sitemap")
        .withColumn("_mark", mark)
        .withColumn("_prev", F.coalesce(F.last("_mark", ignorenulls=True).over(above), F.lit("rule")))
        .withColumn(
            "group_id", F.sum(F.when(is_agent & (F.col("_prev") == "rule"), 1).otherwise(0)).over(upto)
        )
        .where(F.col("group_id") > 0)
        .drop("_mark", "_prev")
    )


def site_rules(files: DataFrame, bot: str = params.BOT_NAME) -> DataFrame:
    """robots files -> one row per site with the rules that bind ``bot``.

    Columns: ``rules`` (path patterns with their verdict), ``signals``,
    ``crawl_delay`` and ``sitemaps`` in file order.
    """
    lines = directives(files)
    grouped = grouped_directives(lines)
    agent = F.lower(F.col("value"))
    matched = (
        grouped.where((F.col("key") == "user-agent") & agent.isin(bot.lower(), "*"))
        .groupBy("site_id", "group_id")
        .agg(F.min_by(agent, F.col("pos")).alias("agent"))
        .withColumn("_class", F.when(F.col("agent") == "*", 1).otherwise(0))
    )
    best = matched.groupBy("site_id").agg(F.min("_class").alias("_class"))
    binding = matched.join(best, ["site_id", "_class"]).select("site_id", "group_id")
    bound = grouped.join(binding, ["site_id", "group_id"])
    verdict = F.when(
        F.col("key").isin("allow", "disallow") & (F.col("value") != ""),
        F.struct(
            F.col("pos"), normalize_path(F.col("value")).alias("rule"),
            (F.col("key") == "allow").alias("allow"),
        ),
    )
    signal_list = F.when(
        F.col("key") == "content-signal",
        F.transform(
            signal_pairs(F.col("value")),
            lambda s, i: F.struct(
                F.col("pos"), i.alias("at"), s["path"].alias("path"),
                s["signal"].alias("signal"), s["value"].alias("value"),
            ),
        ),
    )
    delay = F.when(F.col("key") == "crawl-delay", F.expr("try_cast(value AS double)"))
    # the last valid delay of a group counts, and the first group that has one
    delays = (
        bound.withColumn("_delay", delay)
        .where(F.col("_delay").isNotNull())
        .groupBy("site_id", "group_id")
        .agg(F.max_by("_delay", "pos").alias("_delay"))
        .groupBy("site_id")
        .agg(F.min_by("_delay", "group_id").alias("crawl_delay"))
    )
    rules = bound.groupBy("site_id").agg(
        F.sort_array(F.collect_list(verdict)).alias("_rules"),
        F.sort_array(F.flatten(F.collect_list(signal_list))).alias("_signals"),
    )
    maps = (
        lines.where(F.col("key") == "sitemap")
        .groupBy("site_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("_maps"))
    )
    return (
        files.select("site_id")
        .join(rules, "site_id", "left")
        .join(delays, "site_id", "left")
        .join(maps, "site_id", "left")
        .select(
            "site_id",
            F.coalesce(
                F.transform(
                    "_rules",
                    lambda r: F.struct(
                        r["rule"].alias("rule"), r["allow"].alias("allow"),
                        is_plain(r["rule"]).alias("plain"), rule_pattern(r["rule"]).alias("pattern"),
                    ),
                ),
                F.array().cast(RULES_TYPE),
            ).alias("rules"),
            F.coalesce(
                F.transform(
                    "_signals",
                    lambda s: F.struct(
                        s["path"].alias("path"), s["pos"].alias("line"), s["at"].alias("at"),
                        s["signal"].alias("signal"), s["value"].alias("value"),
                    ),
                ),
                F.array().cast(SIGNALS_TYPE),
            ).alias("signals"),
            "crawl_delay",
            F.coalesce(F.transform("_maps", lambda m: m["value"]), F.array().cast("array<string>")).alias("sitemaps"),
        )
    )


def is_plain(rule: Column) -> Column:
    """Rules without wildcard and anchor are prefixes."""
    return ~F.contains(rule, F.lit("*")) & ~F.endswith(rule, F.lit("$"))


def rule_pattern(rule: Column) -> Column:
    """Rule with ``*`` wildcards and an optional closing ``$`` -> regular expression."""
    stem = F.regexp_replace(rule, r"\$$", "")
    escaped = F.regexp_replace(stem, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(
        F.lit("^"),
        F.replace(escaped, F.lit("*"), F.lit(".*")),
        F.when(F.endswith(rule, F.lit("$")), F.lit("$")).otherwise(F.lit("")),
    )


def allowed(p: Column, rules: Column) -> Column:
    """Verdict of the longest matching rule; allow wins ties; no match means allowed.

    Patterns were prepared with the rules; only wildcard rules run one.
    """

    def verdict(target: Column) -> Column:
        hits = F.filter(
            rules,
            lambda r: F.when(r["plain"], F.startswith(target, r["rule"])).otherwise(F.rlike(target, r["pattern"])),
        )
        return F.array_max(
            F.transform(hits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["allow"].alias("ok")))
        )["ok"]

    return F.coalesce(let(normalize_path(p), verdict), F.lit(True))


def signal(p: Column, signals: Column, name: str = "ai-input") -> Column:
    """Value of a content signal at a path: longest prefix, earliest rule; null when unset.

    Within one rule the last valid pair counts, hence the two-step order key.
    """

    def value(target: Column) -> Column:
        hits = F.filter(
            signals, lambda s: (s["signal"] == name) & F.startswith(target, s["path"])
        )
        return F.array_max(
            F.transform(
                hits,
                lambda s: F.struct(
                    F.length(s["path"]).alias("n"), (-s["line"]).alias("line"), s["at"].alias("at"), s["value"].alias("v")
                ),
            )
        )["v"]

    return let(normalize_path(p), value)


def decide(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``robots_ok`` and ``ai_input`` to URL rows; sites without a file allow all."""
    p = urls.path(F.col("url"))
    joined = rows.join(rules.select("site_id", "rules", "signals"), "site_id", "left")
    return (
        joined.withColumn(
            "robots_ok", F.coalesce(allowed(p, F.coalesce("rules", F.array().cast(RULES_TYPE))), F.lit(True))
        )
        .withColumn("ai_input", signal(p, F.coalesce("signals", F.array().cast(SIGNALS_TYPE))))
        .drop("rules", "signals")
    )


def is_dropped_by_signal() -> Column:
    return F.col("ai_input").eqNullSafe(F.lit(False))


def keep_allowed(decided: DataFrame) -> DataFrame:
    return decided.where(F.col("robots_ok") & ~is_dropped_by_signal()).drop("robots_ok", "ai_input")


def drop_counts(decided: DataFrame) -> DataFrame:
    """Per site: rows allowed, dropped by robots rules, dropped by the content signal."""
    return decided.groupBy("site_id").agg(
        F.count_if(F.col("robots_ok") & ~is_dropped_by_signal()).alias("allowed"),
        F.count_if(~F.col("robots_ok")).alias("dropped_robots"),
        F.count_if(F.col("robots_ok") & is_dropped_by_signal()).alias("dropped_signal"),
    )


def ledger(stage: str, decided: DataFrame) -> DataFrame:
    """Drops of one stage by reason: ``(site_id, stage, reason, n)``, no row without a drop."""
    reason = F.when(~F.col("robots_ok"), "robots").when(is_dropped_by_signal(), "signal")
    rows = decided.select("site_id", F.lit(stage).alias("stage"), reason.alias("reason")).where(F.col("reason").isNotNull())
    return rows.groupBy("site_id", "stage", "reason").agg(F.count(F.lit(1)).alias("n"))


def tag_ledger(stage: str, pages: DataFrame, found: Column, blocking: tuple[str, ...] = ()) -> DataFrame:
    """Fetched pages ``(site_id, ...)`` that robots headers or meta tags take out, as ledger rows."""
    hits = pages.where(F.coalesce(blocked(found, blocking), F.lit(False)))
    return hits.groupBy("site_id").agg(F.count(F.lit(1)).alias("n")).select("site_id", F.lit(stage).alias("stage"), F.lit("tags").alias("reason"), "n")


def effective_delay(requested: Column, crawl_delay: Column) -> Column:
    return F.greatest(requested, F.coalesce(crawl_delay, F.lit(0.0)))


def header_directives(value: Column, bot: str = params.BOT_NAME) -> Column:
    """X-Robots-Tag value -> the directives that bind ``bot``.

    ``name: directive`` moves the tokens after it into that bot's context.
    """
    tokens = F.filter(F.transform(F.split(value, ","), F.trim), lambda t: t != "")
    marked = F.transform(
        tokens,
        lambda t: F.struct(
            F.when(F.contains(t, F.lit(":")), F.lower(F.trim(F.substring_index(t, ":", 1)))).alias("ctx"),
            F.lower(F.trim(F.regexp_replace(t, "^[^:]*:", ""))).alias("word"),
        ),
    )
    folded = F.aggregate(
        marked,
        F.struct(F.lit(None).cast("string").alias("ctx"), F.array().cast("array<string>").alias("words")),
        lambda acc, t: F.struct(
            F.coalesce(t["ctx"], acc["ctx"]).alias("ctx"),
            F.when(
                (t["word"] != "")
                & F.coalesce(F.coalesce(t["ctx"], acc["ctx"]) == bot.lower(), F.lit(True)),
                F.array_append(acc["words"], t["word"]),
            ).otherwise(acc["words"]).alias("words"),
        ),
    )
    return F.array_distinct(folded["words"])


def meta_directives(html: Column, bot: str = params.BOT_NAME) -> Column:
    """Directives of ``<meta name=robots|bot>`` tags."""
    tags = F.regexp_extract_all(html, F.lit("(?i)(<meta\\b[^>]*>)"), F.lit(1))
    wanted = F.filter(
        tags,
        lambda t: F.lower(F.regexp_extract(t, "(?i)\\bname\\s*=\\s*[\"']?([^\"'>\\s]+)", 1)).isin(
            "robots", bot.lower()
        ),
    )
    contents = F.transform(
        wanted, lambda t: F.regexp_extract(t, "(?i)\\bcontent\\s*=\\s*[\"']([^\"']*)[\"']", 1)
    )
    return F.array_distinct(
        F.flatten(F.transform(contents, lambda c: F.transform(F.split(c, ","), lambda d: F.lower(F.trim(d)))))
    )


def nofollow(header: Column, html: Column, bot: str = params.BOT_NAME) -> Column:
    return F.coalesce(F.array_contains(header_directives(header, bot), "nofollow"), F.lit(False)) | F.coalesce(
        F.array_contains(meta_directives(html, bot), "nofollow"), F.lit(False)
    )


def blocked(found: Column, blocking: tuple[str, ...] = ()) -> Column:
    """True when a directive is in the blocking set, which is empty by default."""
    if not blocking:
        return F.lit(False)
    return F.arrays_overlap(found, F.array(*[F.lit(b) for b in blocking]))


def ethics_report(rules: DataFrame, decided: DataFrame, licenses: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """Per site: crawl delay, site-wide ai-input signal, license, rows dropped and why.

    ``more`` holds ledger rows of other stages, such as index file probing, the link crawl or page
    tags; each reason is summed over all of them.
    """
    root = rules.select(
        "site_id", "crawl_delay", signal(F.lit("/"), F.col("signals")).alias("ai_input")
    )
    drops = ledger("pages", decided)
    drops = drops if more is None else drops.unionByName(more)
    sums = [F.sum(F.when(F.col("reason") == r, F.col("n"))).alias(f"dropped_{r}") for r in ("robots", "signal", "tags")]
    report = root.join(drops.groupBy("site_id").agg(*sums), "site_id", "left").na.fill(0, ["dropped_robots", "dropped_signal", "dropped_tags"])
    if licenses is None:
        return report.withColumn("license", F.lit(None).cast("string"))
    return report.join(licenses.select("site_id", "license"), "site_id", "left")
