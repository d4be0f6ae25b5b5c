"""Inputs of the registered queries, all derived from the given tables.

The given tables hold web pages, prose, dialogues and events but no robots
files, sitemaps, repository trees or Markdown. Each derivation below is one SQL
text that Spark and DuckDB both run, so the operator under test is the only
thing the two sides express differently. Every derived table grows with the
table it comes from and no derived row gathers an unbounded group.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from docweir.session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

NL = "\n"


class Dialect:
    """The few spellings on which the two engines differ."""

    def __init__(self, name: str):
        self.spark = name == "spark"

    def replace(self, value: str, pattern: str, repl: str) -> str:
        """Replace all matches; groups are written ``<1>`` in ``repl``."""
        mark = "$" if self.spark else "\\"
        repl = re.sub(r"<(\d)>", lambda m: mark + m.group(1), repl)
        flags = "" if self.spark else ", 'g'"
        return f"regexp_replace({value}, '{pattern}', '{repl}'{flags})"

    def text(self, value: str) -> str:
        return f"CAST({value} AS {'STRING' if self.spark else 'VARCHAR'})"

    def listing(self, value: str, sep: str, order: str) -> str:
        if self.spark:
            return f"listagg({value}, '{sep}') WITHIN GROUP (ORDER BY {order})"
        return f"string_agg({value}, '{sep}' ORDER BY {order})"


DUCK, SPARK = Dialect("duck"), Dialect("spark")

HOST = "lower(regexp_extract(url, '^https?://([^/?#]+)', 1))"
URL_PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"


def page_urls(d: Dialect) -> str:
    return f"SELECT {HOST} AS site_id, page_id AS pos, url FROM @pages"


def sites(d: Dialect) -> str:
    """One row per host; every second host asks for its English branch only."""
    return f"""
    SELECT site_id,
           scheme || '://' || site_id ||
           CASE WHEN length(site_id) % 2 = 0 THEN '/' ELSE '/en/' END AS base_url
      FROM (SELECT {HOST} AS site_id, max(regexp_extract(url, '^(https?)://', 1)) AS scheme
              FROM @pages GROUP BY 1) h"""


def version_urls(d: Dialect) -> str:
    """Page addresses moved under product and version folders."""
    n = d.text("page_id % 7")
    return f"""
    SELECT {HOST} AS site_id, page_id AS pos,
           'https://' || {HOST} || '/docs/' || lang ||
           CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 5 = 1 THEN '/v1.' || {n}
                WHEN page_id % 5 = 2 THEN '/latest' WHEN page_id % 5 = 3 THEN '/v2.x'
                ELSE '/1.10.' || {n} END || '/topic-' || {d.text('page_id % 11')} AS url
      FROM (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]+/([a-z]+)', 1) AS lang
              FROM @pages) p"""


def version_sites(d: Dialect) -> str:
    return f"""
    SELECT site_id, 'https://' || site_id ||
           CASE WHEN length(site_id) % 3 = 0 THEN '/docs/en/v2.x/' ELSE '/docs/' END AS base_url
      FROM (SELECT DISTINCT {HOST} AS site_id FROM @pages) h"""


def robots_txt(d: Dialect) -> str:
    """A robots file per host, written from the host's own languages and page count."""
    count = d.text("pages % 4 + 1")
    return f"""
    SELECT site_id,
           '# rules of ' || site_id || '{NL}User-Agent: *{NL}Disallow: /' || last_lang || '/{NL}' ||
           'Allow: /' || last_lang || '/%38{NL}Crawl-delay: ' || {count} || '{NL}' ||
           'Content-Signal: ai-train=no, search=yes{NL}' ||
           CASE WHEN pages % 2 = 0 THEN 'Content-Signal: /de/ ai-input=no{NL}'
                ELSE 'Content-Signal: /es/ search=no, ai-input=no # note{NL}' END ||
           '{NL}User-agent: otherbot{NL}Disallow: /{NL}' ||
           CASE WHEN pages % 3 = 0 THEN 'User-agent: DocweirBot{NL}Crawl-delay: 7{NL}User-agent: twin{NL}' ||
                'Disallow: /*.html${NL}Disallow:{NL}Disallow: /en/1{NL}Allow: /en/1*5{NL}' ||
                'Content-Signal: / ai-input=yes{NL}Content-Signal: /fr ai-input=no{NL}'
                ELSE '' END ||
           'Sitemap: https://' || site_id || '/sitemap-a.xml{NL}' AS body
      FROM (SELECT {HOST} AS site_id, count(*) AS pages,
                   max(regexp_extract(url, '^https?://[^/?#]+/([a-z]+)', 1)) AS last_lang
              FROM @pages GROUP BY 1) h"""


def robots_headers(d: Dialect) -> str:
    """One X-Robots-Tag value per page."""
    return f"""
    SELECT page_id, url,
           CASE WHEN page_id % 4 = 0 THEN 'noindex, ' || regexp_extract(url, '([a-z]+)', 1)
                WHEN page_id % 4 = 1 THEN 'otherbot: nofollow, noarchive'
                WHEN page_id % 4 = 2 THEN 'noarchive, DocweirBot: NoFollow, , nosnippet'
                ELSE 'none,nofollow' END AS header
      FROM @pages"""


def sitemap_files(d: Dialect) -> str:
    """Sitemap files of at most fifty addresses, and index files of at most fifty files."""
    leaf, top = d.text("page_id // 50") if not d.spark else d.text("page_id div 50"), (
        d.text("page_id // 2500") if not d.spark else d.text("page_id div 2500")
    )
    entry = "'<url><loc>' || replace(url, '&', '&amp;') || '</loc><lastmod>2024-01-0' || " + d.text(
        "page_id % 9 + 1") + " || '</lastmod></url>'"
    return f"""
    SELECT 'https://' || site_id || folder || 'sitemap-' || leaf || '.xml' AS url, site_id,
           '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' ||
           {d.listing('entry', '', 'page_id')} || '</urlset>' AS body
      FROM (SELECT {HOST} AS site_id, page_id, {leaf} AS leaf, {entry} AS entry,
                   CASE WHEN page_id % 3 = 0 THEN '/v1.2/' WHEN page_id % 3 = 1 THEN '/v1.10/' ELSE '/' END AS folder
              FROM @pages) e
     GROUP BY site_id, folder, leaf
    UNION ALL
    SELECT 'https://' || site_id || '/index-' || top || '.xml' AS url, site_id,
           '<sitemapindex>' || {d.listing('entry', '', 'entry')} || '</sitemapindex>' AS body
      FROM (SELECT DISTINCT {HOST} AS site_id, {top} AS top,
                   '<sitemap><loc>https://' || {HOST} ||
                   CASE WHEN page_id % 3 = 0 THEN '/v1.2/' WHEN page_id % 3 = 1 THEN '/v1.10/' ELSE '/' END ||
                   'sitemap-' || {leaf} || '.xml</loc></sitemap>' AS entry
              FROM @pages) s
     GROUP BY site_id, top"""


def sitemap_roots(d: Dialect) -> str:
    top = d.text("page_id // 2500") if not d.spark else d.text("page_id div 2500")
    return f"""
    SELECT DISTINCT {HOST} AS site_id, 'https://' || {HOST} || '/index-' || {top} || '.xml' AS url
      FROM @pages"""


def index_files(d: Dialect) -> str:
    """Link-index files made of the prose: some lines become headings, some become links."""
    body = "text"
    body = d.replace(body, "(^|\n)([A-D][^ \n]*) ([^\n]*)", "<1>- [<2>](/docs/<2>.md): <3>")
    body = d.replace(body, "(^|\n)([EI][^ \n]*) ([^\n]*)", "<1>## <2>")
    body = d.replace(body, "(^|\n)([O][^ \n]*) ([^\n]*)", "<1>## Optional")
    body = d.replace(body, "(^|\n)([T][^ \n]*) ([^\n]*)", "<1>- [<2>](https://docs.example.org/<2>)")
    return f"""
    SELECT doc_id AS file_id, 'https://' || source || '.example.org/' ||
           {d.text('doc_id')} || '/llms.txt' AS url,
           '# Index ' || {d.text('doc_id')} || '{NL}> Notes of ' || source || '{NL}> in ' || lang || '{NL}{NL}' ||
           {body} AS body
      FROM @documents"""


def markdown_docs(d: Dialect) -> str:
    """The prose as Markdown: lines become headings, lists, tables and fenced code by first letter."""
    body = "text"
    body = d.replace(body, "(^|\n)([A-B][^\n]*)", "<1>## <2>")
    body = d.replace(body, "(^|\n)([C-D][^\n]*)", "<1>### <2>")
    body = d.replace(body, "(^|\n)([E-F][^\n]*)", "<1>- <2>")
    body = d.replace(body, "(^|\n)([I-L][^\n]*)", "<1>```python\n<2>\n\n# not a heading\n```")
    body = d.replace(body, "(^|\n)([M-N][^\n]*)", "<1>| <2> | x |\n|---|---|")
    body = d.replace(body, "(^|\n)([O][^\n]*)", "<1>\nimport Widget from x\n<Card title=\"a\">\n<2>\n</Card>")
    return f"""
    SELECT doc_id, source, lang,
           CASE WHEN doc_id % 3 = 0 THEN '---{NL}title: "Doc ' || {d.text('doc_id')} || '"{NL}tag: ' || lang || '{NL}---{NL}{NL}'
                WHEN doc_id % 3 = 1 THEN '+++{NL}title = "Doc ' || {d.text('doc_id')} || '"{NL}+++{NL}'
                ELSE '# Doc ' || {d.text('doc_id')} || '{NL}{NL}' END || {body} AS text
      FROM @documents"""


def repo_tree(d: Dialect) -> str:
    """A repository per host whose files are the host's pages."""
    return f"""
    SELECT {HOST} AS repo, page_id AS pos,
           CASE WHEN page_id % 9 = 8 THEN '' WHEN length({HOST}) % 4 = 0 THEN 'Docs/'
                WHEN length({HOST}) % 4 = 1 THEN 'src/docs/' WHEN length({HOST}) % 4 = 2 THEN 'guide/'
                ELSE 'docs/' END ||
           CASE WHEN page_id % 9 = 0 THEN 'tests/' WHEN page_id % 9 = 8 THEN ''
                WHEN length({HOST}) % 3 = 0 THEN '' ELSE lang || '/' END ||
           CASE WHEN page_id % 13 = 0 THEN 'LICENSE' WHEN page_id % 13 = 1 THEN 'Changelog'
                ELSE 'topic-' || {d.text('page_id')} END ||
           CASE WHEN page_id % 6 = 0 THEN '.mdx' WHEN page_id % 6 = 1 THEN '.rst'
                WHEN page_id % 6 = 2 THEN '.py' ELSE '.md' END AS path,
           CASE WHEN page_id % 17 = 0 THEN 'tree' ELSE 'blob' END AS type
      FROM (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]+/([a-z]+)', 1) AS lang
              FROM @pages) p"""


def repo_meta(d: Dialect) -> str:
    return f"""
    SELECT repo, CASE WHEN length(repo) % 5 = 0 THEN 'MIT' WHEN length(repo) % 5 = 1 THEN 'NOASSERTION'
                      WHEN length(repo) % 5 = 2 THEN 'Apache-2.0' WHEN length(repo) % 5 = 3 THEN NULL
                      ELSE 'Custom' END AS spdx_id,
           CASE WHEN length(repo) % 7 = 0 THEN NULL ELSE 'main' END AS default_branch
      FROM (SELECT DISTINCT {HOST} AS repo FROM @pages) h"""


def snapshots(d: Dialect) -> str:
    """Fetched bodies: the HTML of each page, some Markdown siblings, some negotiated Markdown."""
    u = d.replace("regexp_extract(url, '^([^?#]*)', 1)", "/+$", "")
    head = "regexp_extract(html, '<h1>([^<]*)</h1>', 1)"
    return f"""
    SELECT {HOST} AS site_id, {u} AS url, 'html' AS variant,
           CASE WHEN page_id % 10 = 3 THEN 404 ELSE 200 END AS status,
           CASE WHEN page_id % 11 = 4 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
           html AS body FROM @pages
    UNION ALL
    SELECT {HOST} AS site_id, {u} || '.md' AS url, 'md' AS variant, 200 AS status,
           CASE WHEN page_id % 7 = 0 THEN 'text/html' ELSE 'text/plain' END AS content_type,
           CASE WHEN page_id % 5 = 0 THEN ' <!doctype html>' ELSE '---{NL}title: "M ' || {d.text('page_id')} ||
                '"{NL}---{NL}' || {head} END AS body FROM @pages WHERE length({HOST}) % 3 < 2
    UNION ALL
    SELECT {HOST} AS site_id, {u} AS url, 'negotiated' AS variant,
           CASE WHEN page_id % 4 = 3 THEN 500 ELSE 200 END AS status,
           CASE WHEN page_id % 8 = 1 THEN 'text/html' ELSE 'text/markdown; charset=utf-8' END AS content_type,
           CASE WHEN page_id % 9 = 0 THEN ' {NL} ' ELSE '# ' || {head} || '{NL}{NL}body of page' END AS body
      FROM @pages WHERE length({HOST}) % 3 = 0"""


def index_snapshots(d: Dialect) -> str:
    """Index files as fetched: one full and one link file in some folder of each site."""
    base = "'https://' || site_id"
    lines = " || ".join([f"'- [p{i}](/p{i}.md){NL}'" for i in range(3)])
    return f"""
    SELECT {base} || CASE WHEN length(site_id) % 2 = 0 THEN '/llms.txt' ELSE '/en/llms-full.txt' END AS url,
           CASE WHEN pages % 4 = 0 THEN {base} || '/llms.txt' ELSE {base} || '/en/llms-full.txt' END AS final_url,
           CASE WHEN pages % 5 = 4 THEN 404 ELSE 200 END AS status,
           CASE WHEN pages % 7 = 6 THEN 'text/html' ELSE 'text/plain' END AS content_type,
           '# ' || site_id || '{NL}' || CASE WHEN pages % 3 = 0 THEN {lines} ELSE '' END ||
           repeat('prose line{NL}', CAST(pages * 3 AS INT)) AS body
      FROM (SELECT {HOST} AS site_id, count(*) AS pages FROM @pages GROUP BY 1) h"""


def crawl_edges(d: Dialect) -> str:
    """Link rows of a crawlable site: root -> language listings -> pages -> their navigation."""
    nav = (
        "explode(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1))"
        if d.spark
        else "unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1))"
    )
    return f"""
    SELECT site_id, '/' AS src, '/' || lang AS dst, min(page_id) AS link_pos
      FROM (SELECT {HOST} AS site_id, page_id, regexp_extract(url, '^https?://[^/?#]+/([a-z]+)', 1) AS lang
              FROM @pages) a GROUP BY 1, 2, 3
    UNION ALL
    SELECT site_id, '/' || regexp_extract(dst, '^/([a-z]+)', 1) AS src, dst, min(page_id) AS link_pos
      FROM (SELECT {HOST} AS site_id, page_id, {d.replace(URL_PATH, '/+$', '')} AS dst FROM @pages) b
     GROUP BY 1, 2, 3
    UNION ALL
    SELECT site_id, src, dst, min(page_id) AS link_pos
      FROM (SELECT {HOST} AS site_id, page_id, {d.replace(URL_PATH, '/+$', '')} AS src, {nav} AS dst
              FROM @pages) c GROUP BY 1, 2, 3"""


def messages(d: Dialect) -> str:
    """Dialogue rows as stored messages; a long dialogue carries flags and answer variants."""
    return f"""
    SELECT conv_id * 4294967296 + turn AS message_id, conv_id, turn,
           CASE WHEN role = 'assistant' THEN 'ai' ELSE 'user' END AS role,
           CASE WHEN role <> 'assistant' THEN NULL WHEN (conv_id + turn) % 3 = 0 THEN 'rag_on'
                WHEN (conv_id + turn) % 3 = 1 THEN 'rag_off' ELSE NULL END AS variant,
           text AS content,
           CASE WHEN role = 'user' AND turn % 4 = 0 THEN substring(text, 1, 20) END AS raw_question,
           (turn < conv_id % 3) AS compacted, (turn = 2 AND conv_id % 5 = 0) AS truncated
      FROM @conversations"""


def attachments(d: Dialect) -> str:
    """An image and a text file per user turn, on some turns."""

    def kind(n: int, name: str, mime: str, body: str) -> str:
        return f"""
        SELECT conv_id * 4294967296 + turn AS message_id, {n} AS seq,
               'file-' || {d.text('conv_id')} || '-{n}' AS file_id, {name} AS name,
               length(text) AS size, '{mime}' AS mime_type, {body} AS file_text
          FROM @conversations WHERE role = 'user' AND (conv_id + turn + {n}) % 2 = 0"""

    return (
        kind(0, "'a.png'", "image/png", "CAST(NULL AS STRING)" if d.spark else "CAST(NULL AS VARCHAR)")
        + " UNION ALL "
        + kind(1, "CASE WHEN turn % 3 = 0 THEN '../b.md' ELSE 'b.md' END", "text/markdown",
               "CASE WHEN turn % 2 = 0 THEN text END")
    )


def job_events(d: Dialect) -> str:
    """Polls of crawl jobs: one job per user, one poll per event in time order."""
    return f"""
    SELECT 'job-' || {d.text('user_id')} AS job_id, event_id AS seq,
           CASE event_type WHEN 'view' THEN 'in_progress' WHEN 'click' THEN 'in_progress'
                WHEN 'purchase' THEN CASE WHEN value > 60 THEN 'completed' ELSE 'in_progress' END
                WHEN 'signup' THEN 'paused' ELSE NULL END AS status,
           event_type <> 'error' AS http_ok,
           CAST(floor(value) AS BIGINT) AS pages_fetched,
           CAST(floor(value * 2) AS BIGINT) + 1 AS pages_total, ts
      FROM @events"""


def token_events(d: Dialect) -> str:
    """Answer streams: the words of each assistant turn, then usage and the closing event."""
    posed = (
        "posexplode(split(text, ' ')) AS (i, word)"
        if d.spark
        else "unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS i"
    )
    return f"""
    SELECT conv_id, turn, CAST(i AS BIGINT) AS seq, 'token' AS type, word || ' ' AS content,
           CAST(NULL AS BIGINT) AS total_tokens
      FROM (SELECT conv_id, turn, {posed} FROM @conversations WHERE role = 'assistant') w
    UNION ALL
    SELECT conv_id, turn, CAST(4611686018427387904 AS BIGINT) AS seq,
           CASE WHEN conv_id % 4 = 0 THEN 'error' ELSE 'done' END AS type,
           CASE WHEN conv_id % 4 = 0 THEN 'boom' ELSE '' END AS content,
           CAST(length(text) AS BIGINT) AS total_tokens
      FROM @conversations WHERE role = 'assistant' AND conv_id % 6 <> 1
    UNION ALL
    SELECT conv_id, turn, CAST(0 AS BIGINT) AS seq, 'start' AS type, '' AS content, CAST(NULL AS BIGINT) AS total_tokens
      FROM @conversations WHERE role = 'assistant'"""


def duck(name: str) -> str:
    """The derivation as DuckDB text over the pre-registered views."""
    return globals()[name](DUCK).replace("@", "")


def ctes(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for an oracle."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({duck(n)})" for n in names)


# The column that spreads a table where the session asks for it.
SPREAD_BY = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "embeddings": "vec_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, SPREAD_BY[name]) if name in SPREAD_BY else rows


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a derivation written against ``@table`` names over the parquet tables of ``sf_dir``."""
    stem = "docweir_" + hashlib.md5(sf_dir.encode()).hexdigest()[:8]
    for t in sorted(set(re.findall(r"@([a-z]+)", text))):
        table(spark, sf_dir, t).createOrReplaceTempView(f"{stem}_{t}")
    return spark.sql(re.sub(r"@([a-z]+)", rf"{stem}_\1", text))


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named derivation as a Spark frame."""
    return run(spark, sf_dir, globals()[name](SPARK))
