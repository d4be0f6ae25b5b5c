"""Registered queries: URLs, URL sets, robots policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweir import params
from docweir.catalog import fragments as q
from docweir.catalog.inputs import ctes, derived
from docweir.catalog.registry import query
from docweir.functions import paths, urls
from docweir.operators import robots, urlset
from docweir.plans import url_plan


@query(
    "url_normalize_dedupe",
    f"{ctes('page_urls')} SELECT site_id, min(pos) AS pos, {q.norm('url')} AS url FROM page_urls GROUP BY site_id, {q.norm('url')}",
)
def url_normalize_dedupe(spark, sf):
    return urlset.first_seen(derived(spark, sf, "page_urls"))


@query(
    "url_parts",
    f"""{ctes('page_urls', 'sites')}
    SELECT pos, {q.origin('url')} AS origin, regexp_extract({q.origin('url')}, '//(.*)$', 1) AS domain,
           {q.path('url')} AS path, rtrim({q.path('url')}, '/') = '' AS is_root,
           regexp_matches(url, '[.]md/*$') AS has_md, regexp_matches(url, '^https?://') AS is_absolute,
           {q.origin('url')} LIKE '%//' || p.site_id AS same_domain
      FROM page_urls p JOIN sites s ON p.site_id = s.site_id""",
)
def url_parts(spark, sf):
    u = F.col("url")
    rows = derived(spark, sf, "page_urls").join(derived(spark, sf, "sites"), "site_id")
    return rows.select(
        "pos",
        urls.origin(u).alias("origin"),
        urls.domain(u).alias("domain"),
        urls.path(u).alias("path"),
        urls.is_root(u).alias("is_root"),
        urls.has_md_ending(u).alias("has_md"),
        urls.is_absolute(u).alias("is_absolute"),
        urls.same_domain(u, F.col("base_url")).alias("same_domain"),
    )


@query(
    "url_scope_prefix",
    f"""{ctes('page_urls', 'sites')}
    SELECT pos, {q.prefix('url')} AS prefix, {q.in_scope(q.norm('url'), q.prefix('base_url'))} AS in_scope
      FROM page_urls p JOIN sites s ON p.site_id = s.site_id""",
)
def url_scope_prefix(spark, sf):
    rows = derived(spark, sf, "page_urls").join(derived(spark, sf, "sites"), "site_id")
    u = F.col("url")
    return rows.select(
        "pos",
        urls.scope_prefix(u).alias("prefix"),
        urls.in_scope(urls.normalize(u), urls.scope_prefix(F.col("base_url"))).alias("in_scope"),
    )


@query(
    "url_path_parents",
    f"""{ctes('page_urls')}, cut AS (
      SELECT pos, {q.origin('url')} AS origin, string_split(rtrim({q.path('url')}, '/'), '/') AS parts FROM page_urls)
    SELECT pos, CAST(len(parts) - n AS BIGINT) AS depth, origin || array_to_string(parts[1:n], '/') AS parent
      FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM cut) x""",
)
def url_path_parents(spark, sf):
    return derived(spark, sf, "page_urls").select(
        "pos", F.posexplode(urls.ancestors(F.col("url"))).alias("depth", "parent")
    ).withColumn("depth", F.col("depth").cast("bigint"))


_ASSET_INPUT = """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(url, '.html', '.PDF')
    WHEN page_id % 5 = 1 THEN 'mailto:info.' || substring(url, 9, 5) WHEN page_id % 5 = 2 THEN
    regexp_replace(url, '[?#/].*$', '/a.tar') || '.gz' WHEN page_id % 5 = 3 THEN url || '.svg'
    ELSE url END AS url FROM pages"""


@query(
    "url_asset_filter",
    f"""SELECT page_id, url FROM ({_ASSET_INPUT}) a
     WHERE NOT (regexp_matches(lower({q.path('url')}), '[.]({"|".join(urls.ASSET_ENDINGS)})$')
                OR regexp_matches(url, '^(mailto|javascript|tel|ftp|data):'))""",
)
def url_asset_filter(spark, sf):
    text = _ASSET_INPUT.replace("FROM pages", "FROM @pages")
    from docweir.catalog import inputs

    rows = inputs.run(spark, sf, text)
    return rows.where(~urls.is_asset(F.col("url")))


@query(
    "url_resolve",
    f"""SELECT page_id, href, {q.origin('url')} || href AS resolved
      FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS href FROM pages) h""",
)
def url_resolve(spark, sf):
    from docweir.catalog.inputs import table

    links = table(spark, sf, "pages").select(
        "page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("href")
    )
    return links.select("page_id", "href", urls.resolve(F.col("url"), F.col("href")).alias("resolved"))


_REPO_INPUT = """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://github.com/' WHEN page_id % 4 = 1
    THEN 'github.com/' ELSE 'http://github.com/' END || regexp_extract(url, '//([^/.]+)', 1) || '/' ||
    regexp_extract(url, '//[^/.]+[.]([^/.]+)', 1) || CASE WHEN page_id % 3 = 0 THEN '.git'
    WHEN page_id % 3 = 1 THEN '/tree/main' || regexp_extract(url, '//[^/]+([^?#]*)', 1) ELSE '?tab=readme' END AS url
    FROM pages"""


@query(
    "repo_address",
    f"""SELECT page_id, regexp_extract(url, 'github[.]com/([^/]+)/', 1) AS owner,
           regexp_replace(regexp_extract(url, 'github[.]com/[^/]+/([^/?#]+)', 1), '[.]git$', '') AS repo,
           nullif(regexp_extract(url, '/tree/([^/?#]+)', 1), '') AS branch,
           nullif(rtrim(regexp_extract(url, '/tree/[^/?#]+/([^?#]+)', 1), '/'), '') AS subpath
      FROM ({_REPO_INPUT}) r""",
)
def repo_address(spark, sf):
    from docweir.catalog import inputs

    rows = inputs.run(spark, sf, _REPO_INPUT.replace("FROM pages", "FROM @pages"))
    return rows.select("page_id", urls.repo_address(F.col("url")).alias("r")).select("page_id", "r.*")


_LANGS = f"""tagged AS (SELECT p.*, {q.url_lang('url', 'base_url')} AS lang
      FROM page_urls p JOIN sites s ON p.site_id = s.site_id),
    stats AS (SELECT site_id, count(DISTINCT lang) AS codes,
       coalesce(max(CASE WHEN lang = 'en' THEN 'en' END), max(CASE WHEN lang = 'en-us' THEN 'en-us' END),
                max(CASE WHEN lang = 'en-gb' THEN 'en-gb' END)) AS pick FROM tagged GROUP BY 1)"""


@query(
    "url_language_filter",
    f"""{ctes('page_urls', 'sites')}, {_LANGS}
    SELECT t.site_id, pos, url FROM tagged t JOIN stats s ON t.site_id = s.site_id
     WHERE codes < 2 OR lang IS NOT DISTINCT FROM pick""",
)
def url_language_filter(spark, sf):
    return urlset.one_language(derived(spark, sf, "page_urls"), derived(spark, sf, "sites"))


_VERSIONED = f"""parted AS (SELECT *, {q.segs(q.path('url'))} AS parts, {q.version_seg(q.path('url'))} AS ver FROM cand),
    keyed AS (SELECT *, list_position(parts, ver) AS vi FROM parted),
    vgrouped AS (SELECT *, array_to_string(parts[1:vi - 1], '/') AS head, array_to_string(parts[vi + 1:], '/') AS tail
                  FROM keyed WHERE ver IS NOT NULL),
    seg AS (SELECT site_id, head, tail, ver, min(pos) AS first FROM vgrouped GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id, head, tail
                 ORDER BY {q.version_key('ver')} DESC, first) AS rn,
                 min(first) OVER (PARTITION BY site_id, head, tail) AS group_pos FROM seg),
    newest AS (SELECT site_id, pos, url, false AS is_versioned, NULL::BIGINT AS group_pos FROM parted WHERE ver IS NULL
      UNION ALL SELECT g.site_id, pos, url, true, group_pos FROM vgrouped g JOIN ranked r
        ON g.site_id = r.site_id AND g.head = r.head AND g.tail = r.tail AND g.ver = r.ver WHERE rn = 1)"""


@query(
    "url_version_dedupe",
    f"""{ctes('version_urls')}, cand AS (SELECT site_id, min(pos) AS pos, {q.norm('url')} AS url FROM version_urls
        GROUP BY 1, 3), {_VERSIONED} SELECT * FROM newest""",
)
def url_version_dedupe(spark, sf):
    return urlset.newest_version(urlset.first_seen(derived(spark, sf, "version_urls")))


@query(
    "url_base_version",
    f"""{ctes('version_urls', 'version_sites')}
    SELECT v.site_id, pos, url FROM version_urls v JOIN version_sites s ON v.site_id = s.site_id
     WHERE {q.version_seg(q.path('base_url'))} IS NULL OR {q.version_seg(q.path('url'))} IS NULL
        OR {q.version_seg(q.path('url'))} = {q.version_seg(q.path('base_url'))}""",
)
def url_base_version(spark, sf):
    return urlset.same_version(derived(spark, sf, "version_urls"), derived(spark, sf, "version_sites"))


@query(
    "version_parse",
    f"""{ctes('version_urls')}
    SELECT pos, seg, CASE WHEN regexp_matches(seg, '^(current|latest|next|stable|main)$') THEN '9999'
           WHEN regexp_matches(seg, '^(version-)?v?[0-9]+([.][0-9]+)*([.]x)?$')
           THEN regexp_extract(seg, '([0-9]+(?:[.][0-9]+)*)', 1) END AS version
      FROM (SELECT pos, unnest({q.segs(q.path('url'))} || ['version-' || pos || '.2.x']) AS seg FROM version_urls) s""",
)
def version_parse(spark, sf):
    rows = derived(spark, sf, "version_urls")
    extra = F.array(F.concat(F.lit("version-"), F.col("pos").cast("string"), F.lit(".2.x")))
    segs = rows.select("pos", F.explode(F.concat(urls.segments(urls.path(F.col("url"))), extra)).alias("seg"))
    return segs.select(
        "pos", "seg", F.array_join(paths.parse_version(F.col("seg")).cast("array<string>"), ".").alias("version")
    )


# ---- robots -----------------------------------------------------------------------------------

_BOT = params.BOT_NAME
_PCT = """array_to_string(list_transform(string_split({p}, '%'), lambda s, i: CASE WHEN i = 1 THEN s
    WHEN NOT regexp_matches(s, '^[0-9A-Fa-f]{{2}}') THEN '%' || s
    WHEN regexp_matches(chr(('0x' || s[1:2])::INT), '^[A-Za-z0-9._~-]$') AND ('0x' || s[1:2])::INT < 128
    THEN chr(('0x' || s[1:2])::INT) || s[3:] ELSE '%' || upper(s[1:2]) || s[3:] END), '')"""


def _pct(p: str) -> str:
    return _PCT.format(p=p)


_ROBOTS = f"""raw AS (SELECT site_id, unnest(string_split(body, chr(10))) AS line,
        generate_subscripts(string_split(body, chr(10)), 1) - 1 AS pos FROM robots_txt),
    bare AS (SELECT site_id, pos, trim(regexp_replace(line, '#.*$', '')) AS line FROM raw),
    lines AS (SELECT site_id, pos, lower(regexp_extract(line, '^([A-Za-z-]+)\\s*:', 1)) AS key,
        trim(regexp_extract(line, '^[A-Za-z-]+\\s*:\\s*(.*)$', 1)) AS value FROM bare
        WHERE regexp_matches(line, '^[A-Za-z-]+\\s*:')),
    marked AS (SELECT *, key = 'user-agent' AS agent,
        (key IN ('allow', 'disallow') AND value <> '') OR (key = 'content-signal'
          AND regexp_matches(value, '(search|ai-input|ai-train)\\s*=\\s*(yes|no)')) AS rule
        FROM lines WHERE key <> 'sitemap'),
    events AS (SELECT *, lag(agent) OVER (PARTITION BY site_id ORDER BY pos) AS after_agent
        FROM marked WHERE agent OR rule),
    starts AS (SELECT site_id, pos FROM events WHERE agent AND after_agent IS DISTINCT FROM true),
    grouped AS (SELECT m.*, (SELECT count(*) FROM starts s WHERE s.site_id = m.site_id AND s.pos <= m.pos) AS gid
        FROM marked m),
    agents AS (SELECT site_id, gid, min_by(lower(value), pos) AS agent FROM grouped
        WHERE gid > 0 AND agent AND lower(value) IN ('{_BOT}', '*') GROUP BY 1, 2),
    binding AS (SELECT a.site_id, a.gid FROM agents a WHERE a.agent = '{_BOT}' OR NOT EXISTS
        (SELECT 1 FROM agents b WHERE b.site_id = a.site_id AND b.agent = '{_BOT}')),
    bound AS (SELECT g.* FROM grouped g JOIN binding b ON g.site_id = b.site_id AND g.gid = b.gid),
    rules AS (SELECT site_id, pos, {_pct('value')} AS rule, key = 'allow' AS allow FROM bound
        WHERE key IN ('allow', 'disallow') AND value <> ''),
    sig0 AS (SELECT site_id, pos, CASE WHEN value LIKE '/%' THEN regexp_extract(value, '^(\\S+)', 1) ELSE '/' END AS path,
        CASE WHEN value LIKE '/%' THEN regexp_extract(value, '^\\S+\\s+(.*)$', 1) ELSE value END AS pairs
        FROM bound WHERE key = 'content-signal'),
    sig1 AS (SELECT site_id, pos, path, trim(unnest(string_split(pairs, ','))) AS pair FROM sig0),
    signals AS (SELECT site_id, pos, path, split_part(pair, '=', 1) AS signal, split_part(pair, '=', 2) = 'yes' AS value
        FROM sig1 WHERE regexp_matches(pair, '^(search|ai-input|ai-train)=(yes|no)$')),
    delays AS (SELECT site_id, TRY_CAST(min_by(value, gid) AS DOUBLE) AS crawl_delay FROM bound WHERE key = 'crawl-delay' GROUP BY 1)"""


@query(
    "robots_rules",
    f"""{ctes('robots_txt')}, {_ROBOTS}
    SELECT r.site_id, coalesce((SELECT string_agg((CASE WHEN allow THEN '+' ELSE '-' END) || rule, ' ' ORDER BY allow DESC, pos)
              FROM rules x WHERE x.site_id = r.site_id), '') AS rules,
           coalesce((SELECT string_agg(path || ' ' || signal || ' ' || value::VARCHAR, '; ' ORDER BY pos, signal)
              FROM signals x WHERE x.site_id = r.site_id), '') AS signals,
           d.crawl_delay, regexp_extract(body, 'Sitemap: (.*)', 1) AS sitemaps
      FROM robots_txt r LEFT JOIN delays d ON d.site_id = r.site_id""",
)
def robots_rules(spark, sf):
    rules = robots.site_rules(derived(spark, sf, "robots_txt"))
    text = F.array_join(
        F.transform(
            F.concat(F.filter("rules", lambda r: r["allow"]), F.filter("rules", lambda r: ~r["allow"])),
            lambda r: F.concat(F.when(r["allow"], "+").otherwise("-"), r["rule"]),
        ),
        " ",
    )
    signals = F.array_join(
        F.transform(
            F.array_sort(F.transform("signals", lambda s: F.struct(s["line"], s["signal"], s["path"], s["value"]))),
            lambda s: F.concat_ws(" ", s["path"], s["signal"], s["value"].cast("string")),
        ),
        "; ",
    )
    return rules.select(
        "site_id", text.alias("rules"), signals.alias("signals"), "crawl_delay",
        F.array_join("sitemaps", " ").alias("sitemaps"),
    )


_RX = """('^' || replace(regexp_replace(regexp_replace(rule, '[$]$', ''), '([.\\[\\]{}()+?^$|\\\\])', '\\\\\\1', 'g'), '*', '.*')
     || CASE WHEN rule LIKE '%$' THEN '$' ELSE '' END)"""
_DECIDED = f"""planned AS (SELECT site_id, pos, url, {_pct(q.path('url'))} AS path FROM page_urls),
    hits AS (SELECT p.site_id, p.pos, length(rule) AS n, allow FROM planned p JOIN rules r
        ON p.site_id = r.site_id WHERE regexp_matches(path, {_RX})),
    verdict AS (SELECT site_id, pos, max(n * 2 + allow::INT) % 2 = 1 AS ok FROM hits GROUP BY 1, 2),
    inputs AS (SELECT p.site_id, p.pos, max_by(value, length(s.path) * 1000 - s.pos) AS ai_input
        FROM planned p JOIN signals s ON p.site_id = s.site_id AND s.signal = 'ai-input'
         AND starts_with(p.path, s.path) GROUP BY 1, 2),
    decided AS (SELECT p.site_id, p.pos, p.url, coalesce(ok, true) AS robots_ok, ai_input
        FROM planned p LEFT JOIN verdict v ON p.site_id = v.site_id AND p.pos = v.pos
        LEFT JOIN inputs i ON p.site_id = i.site_id AND p.pos = i.pos)"""


def _decided(spark, sf):
    return robots.decide(derived(spark, sf, "page_urls"), robots.site_rules(derived(spark, sf, "robots_txt")))


@query(
    "robots_decide",
    f"{ctes('page_urls', 'robots_txt')}, {_ROBOTS}, {_DECIDED} SELECT site_id, pos, url, robots_ok FROM decided",
)
def robots_decide(spark, sf):
    return _decided(spark, sf).drop("ai_input")


@query(
    "content_signal_decide",
    f"{ctes('page_urls', 'robots_txt')}, {_ROBOTS}, {_DECIDED} SELECT site_id, pos, ai_input FROM decided",
)
def content_signal_decide(spark, sf):
    return _decided(spark, sf).select("site_id", "pos", "ai_input")


_COUNTS = """SELECT site_id, count(*) FILTER (robots_ok AND ai_input IS DISTINCT FROM false) AS allowed,
    count(*) FILTER (NOT robots_ok) AS dropped_robots,
    count(*) FILTER (robots_ok AND ai_input IS NOT DISTINCT FROM false) AS dropped_signal FROM decided GROUP BY 1"""


@query("robots_filter_counts", f"{ctes('page_urls', 'robots_txt')}, {_ROBOTS}, {_DECIDED} {_COUNTS}")
def robots_filter_counts(spark, sf):
    return robots.drop_counts(_decided(spark, sf))


@query(
    "ethics_report",
    f"""{ctes('page_urls', 'robots_txt', 'repo_meta')}, {_ROBOTS}, {_DECIDED}, counts AS ({_COUNTS}),
    site_signal AS (SELECT site_id, min_by(value, pos) AS ai_input FROM signals
        WHERE signal = 'ai-input' AND path = '/' GROUP BY 1)
    SELECT r.site_id, crawl_delay, ai_input, coalesce(dropped_robots, 0) AS dropped_robots,
           coalesce(dropped_signal, 0) AS dropped_signal, 0::BIGINT AS dropped_tags, spdx_id AS license,
           greatest(1.5, coalesce(crawl_delay, 0)) AS delay
      FROM robots_txt r LEFT JOIN delays d ON d.site_id = r.site_id LEFT JOIN counts c ON c.site_id = r.site_id
      LEFT JOIN site_signal s ON s.site_id = r.site_id LEFT JOIN repo_meta m ON m.repo = r.site_id""",
)
def ethics_report(spark, sf):
    rules = robots.site_rules(derived(spark, sf, "robots_txt"))
    decided = robots.decide(derived(spark, sf, "page_urls"), rules)
    licenses = derived(spark, sf, "repo_meta").select(
        F.col("repo").alias("site_id"), F.col("spdx_id").alias("license")
    )
    report = robots.ethics_report(rules, decided, licenses)
    return report.withColumn(
        "delay", robots.effective_delay(F.lit(params.DELAY_SECONDS), F.col("crawl_delay"))
    )


@query(
    "robots_path_escapes",
    f"""SELECT page_id, {_pct("escaped")} AS path FROM (SELECT page_id, replace(replace(replace(
        regexp_extract(url, '//[^/]+([^?#]*)', 1), '/e', '/%65'), '5', '%35%c3%aA'), '7', '%7e%%2f%4') AS escaped FROM pages) p""",
)
def robots_path_escapes(spark, sf):
    from docweir.catalog.inputs import table

    p = F.regexp_extract("url", "//[^/]+([^?#]*)", 1)
    for old, new in (("/e", "/%65"), ("5", "%35%c3%aA"), ("7", "%7e%%2f%4")):
        p = F.replace(p, F.lit(old), F.lit(new))
    return table(spark, sf, "pages").select("page_id", robots.normalize_path(p).alias("path"))


@query(
    "robots_directives",
    f"""{ctes('robots_headers')}, tok AS (SELECT page_id, trim(unnest(string_split(header, ','))) AS t,
        generate_subscripts(string_split(header, ','), 1) AS i FROM robots_headers),
    ctx AS (SELECT page_id, i, lower(trim(regexp_replace(t, '^[^:]*:', ''))) AS word,
        last_value(CASE WHEN t LIKE '%:%' THEN lower(trim(split_part(t, ':', 1))) END IGNORE NULLS)
          OVER (PARTITION BY page_id ORDER BY i) AS ctx FROM tok WHERE t <> ''),
    bound AS (SELECT page_id, word FROM ctx WHERE word <> '' AND coalesce(ctx, '{_BOT}') = '{_BOT}')
    SELECT h.page_id, coalesce((SELECT string_agg(DISTINCT word, ' ' ORDER BY word) FROM bound b
              WHERE b.page_id = h.page_id), '') AS directives,
           EXISTS (SELECT 1 FROM bound b WHERE b.page_id = h.page_id AND word = 'nofollow') AS nofollow,
           EXISTS (SELECT 1 FROM bound b WHERE b.page_id = h.page_id AND word = 'none') AS blocked
      FROM robots_headers h""",
)
def robots_directives(spark, sf):
    found = robots.header_directives(F.col("header"))
    return derived(spark, sf, "robots_headers").select(
        "page_id",
        F.array_join(F.array_sort(found), " ").alias("directives"),
        robots.nofollow(F.col("header"), F.lit("")).alias("nofollow"),
        robots.blocked(found, ("none",)).alias("blocked"),
    )


_PLAN = f"""{ctes('page_urls', 'sites', 'robots_txt')}, {_ROBOTS},
    uniq AS (SELECT site_id, min(pos) AS pos, {q.norm('url')} AS url FROM page_urls GROUP BY 1, 3),
    scoped AS (SELECT u.*, base_url FROM uniq u JOIN sites s ON u.site_id = s.site_id
        WHERE {q.in_scope('url', q.prefix('base_url'))}
          AND ({q.version_seg(q.path('base_url'))} IS NULL OR {q.version_seg(q.path('url'))} IS NULL
            OR {q.version_seg(q.path('url'))} = {q.version_seg(q.path('base_url'))})),
    tagged AS (SELECT *, {q.url_lang('url', 'base_url')} AS lang FROM scoped),
    stats AS (SELECT site_id, count(DISTINCT lang) AS codes,
       coalesce(max(CASE WHEN lang = 'en' THEN 'en' END), max(CASE WHEN lang = 'en-us' THEN 'en-us' END),
                max(CASE WHEN lang = 'en-gb' THEN 'en-gb' END)) AS pick FROM tagged GROUP BY 1),
    cand AS (SELECT t.site_id, pos, url FROM tagged t JOIN stats s ON t.site_id = s.site_id
        WHERE codes < 2 OR lang IS NOT DISTINCT FROM pick), {_VERSIONED},
    planned AS (SELECT *, {_pct(q.path('url'))} AS path FROM newest),
    hits AS (SELECT p.site_id, p.pos, length(rule) AS n, allow FROM planned p JOIN rules r
        ON p.site_id = r.site_id WHERE regexp_matches(path, {_RX})),
    verdict AS (SELECT site_id, pos, max(n * 2 + allow::INT) % 2 = 1 AS ok FROM hits GROUP BY 1, 2),
    inputs AS (SELECT p.site_id, p.pos, max_by(value, length(s.path) * 1000 - s.pos) AS ai_input
        FROM planned p JOIN signals s ON p.site_id = s.site_id AND s.signal = 'ai-input'
         AND starts_with(p.path, s.path) GROUP BY 1, 2),
    plan AS (SELECT p.site_id, url, row_number() OVER (PARTITION BY p.site_id ORDER BY is_versioned, group_pos, p.pos) AS rank
        FROM planned p LEFT JOIN verdict v ON p.site_id = v.site_id AND p.pos = v.pos
        LEFT JOIN inputs i ON p.site_id = i.site_id AND p.pos = i.pos
       WHERE coalesce(ok, true) AND ai_input IS DISTINCT FROM false QUALIFY rank <= %d)"""


def plan_oracle(cap: int) -> str:
    return _PLAN.replace("%d", str(cap))


def plan_frame(spark, sf, cap: int):
    return url_plan.plan_urls(
        derived(spark, sf, "page_urls"), derived(spark, sf, "sites"),
        robots.site_rules(derived(spark, sf, "robots_txt")), cap,
    )


@query("url_plan_capped", f"{plan_oracle(3)} SELECT site_id, rank, url FROM plan")
def url_plan_capped(spark, sf):
    return plan_frame(spark, sf, 3)


@query(
    "url_probe",
    f"""{plan_oracle(params.MAX_PAGES)} SELECT site_id,
        min_by(url, (CASE WHEN regexp_matches(url, '^https?://[^/]+/?$') THEN 1000000 ELSE 0 END) + rank) AS probe_url
        FROM plan GROUP BY 1""",
)
def url_probe(spark, sf):
    return urlset.probe_url(plan_frame(spark, sf, params.MAX_PAGES))
