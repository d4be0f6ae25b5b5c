"""Registered queries: dialogues, listings, job and token streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweir import params
from docweir.catalog import fragments as q
from docweir.catalog.inputs import ctes, derived, table
from docweir.catalog.registry import query
from docweir.functions import text
from docweir.operators import browse, history
from docweir.sources import sinks
from docweir.streaming import jobs, tokens

MODEL, MAX_IN, MAX_OUT = "llama-3", 700, 400


def _messages(spark, sf):
    return derived(spark, sf, "messages")


def _model_tokens(x: str) -> str:
    return f"CAST(floor({q.tokens(x)} * 1.35::DOUBLE) AS BIGINT)"


_VISIBLE = """shown AS (SELECT * FROM messages WHERE NOT compacted AND NOT truncated)"""


@query(
    "history_window",
    f"""{ctes('messages')}, {_VISIBLE} SELECT message_id, CASE WHEN role = 'ai' THEN 'assistant' ELSE role END AS role,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency FROM shown QUALIFY recency <= 4""",
)
def history_window(spark, sf):
    return history.history(_messages(spark, sf), 4).select("message_id", "role", "recency")


@query(
    "history_variant",
    f"""{ctes('messages')}, {_VISIBLE} SELECT message_id, CASE WHEN role = 'ai' THEN 'assistant' ELSE role END AS role,
        CASE WHEN role = 'user' AND raw_question <> '' THEN raw_question ELSE content END AS content, variant,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency FROM shown
      WHERE variant = 'rag_off' OR variant IS NULL QUALIFY recency <= 5""",
)
def history_variant(spark, sf):
    return history.history(_messages(spark, sf), 5, "rag_off").select("message_id", "role", "content", "variant", "recency")


@query(
    "attachment_nesting",
    f"""{ctes('messages', 'attachments')} SELECT m.message_id, coalesce(string_agg(name || ':' || size || ':' ||
        CASE WHEN mime_type LIKE 'image/%' THEN 'image' ELSE 'document' END, ' ' ORDER BY seq), '') AS files
      FROM messages m LEFT JOIN attachments a ON a.message_id = m.message_id GROUP BY 1""",
)
def attachment_nesting(spark, sf):
    rows = history.with_attachments(_messages(spark, sf), derived(spark, sf, "attachments"))
    label = lambda a: F.concat_ws(":", a["name"], a["size"].cast("string"), history.attachment_kind(a["mime_type"]))
    return rows.select("message_id", F.array_join(F.transform("attachments", label), " ").alias("files"))


_FILES = """files AS (SELECT message_id, string_agg(CASE WHEN mime_type LIKE 'image/%' THEN '' ELSE chr(10) || '--- File: ' || name || ' ---' || chr(10) ||
        coalesce(file_text, 'Size: ' || size || ' bytes') || chr(10) || '----------------' END, '' ORDER BY seq) AS body,
        count(*) FILTER (mime_type LIKE 'image/%') AS images FROM attachments GROUP BY 1)"""
_COUNTED = f"""{_FILES}, counted AS (SELECT m.*, 3 + {_model_tokens("(content || coalesce(body, ''))")} + 200 * coalesce(images, 0) AS tokens
        FROM shown m LEFT JOIN files f ON f.message_id = m.message_id)"""


def _counted(spark, sf):
    rows = history.with_attachments(history.history(_messages(spark, sf)), derived(spark, sf, "attachments"))
    return rows.withColumn("tokens", history.message_tokens(F.col("content"), F.col("attachments"), F.lit(MODEL)))


@query(
    "token_budget",
    f"""{ctes('messages', 'attachments')}, {_VISIBLE}, {_COUNTED} SELECT message_id, tokens, 3 + {_model_tokens('content')} AS system_tokens FROM counted""",
)
def token_budget(spark, sf):
    return _counted(spark, sf).select(
        "message_id", "tokens", history.system_tokens(F.col("content"), F.lit(MODEL)).alias("system_tokens")
    )


@query(
    "model_token_families",
    f"""SELECT conv_id, turn, {q.tokens('text')} AS gpt, {_model_tokens('text')} AS other,
        CASE WHEN len(regexp_extract_all(text, '\\S+')) <= 12 THEN text ELSE array_to_string(regexp_extract_all(text, '\\S+')[1:12], ' ') END AS head FROM conversations""",
)
def model_token_families(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", text.model_tokens(t, F.lit("gpt-4o")).alias("gpt"),
        text.model_tokens(t, F.lit(MODEL)).alias("other"), text.truncate_words(t, 12).alias("head"),
    )


_TOTALS = f"""totals AS (SELECT conv_id, 20::BIGINT AS system_tokens, sum(tokens)::BIGINT AS history_tokens, 50::BIGINT AS new_tokens FROM counted GROUP BY 1)"""


def _totals(spark, sf):
    return _counted(spark, sf).groupBy("conv_id").agg(F.sum("tokens").alias("history_tokens")).select(
        "conv_id", F.lit(20).cast("bigint").alias("system_tokens"), "history_tokens",
        F.lit(50).cast("bigint").alias("new_tokens"), F.lit(MAX_IN).cast("bigint").alias("max_in"),
        F.lit(params.COMPACTION_THRESHOLD).alias("share"), F.lit(MAX_OUT).cast("bigint").alias("max_out"),
    )


_LIMIT = f"greatest(least({MAX_IN} - (least(1024, {MAX_IN} // 4) + 200), CAST(floor({MAX_IN} * 0.8::DOUBLE) AS BIGINT)), {MAX_IN} // 2)"


@query(
    "compaction_decision",
    f"""{ctes('messages', 'attachments')}, {_VISIBLE}, {_COUNTED}, {_TOTALS}
    SELECT conv_id, system_tokens + history_tokens + new_tokens + 24 AS total, CAST({_LIMIT} AS BIGINT) AS threshold,
           system_tokens + history_tokens + new_tokens + 24 > {_LIMIT} AS compact FROM totals""",
)
def compaction_decision(spark, sf):
    return history.compaction_decision(_totals(spark, sf)).select(
        "conv_id", "total", F.col("threshold").cast("bigint").alias("threshold"), "compact"
    )


_HALVED = f"""newest AS (SELECT conv_id, list(tokens ORDER BY turn DESC) AS t, count(*) AS n FROM counted GROUP BY 1),
    halving AS (SELECT conv_id, t, n AS before, n AS size FROM newest
      UNION ALL SELECT conv_id, t, before, size - size // 2 FROM halving WHERE size > 1 AND 94 + list_sum(t[1:size]) > {_LIMIT}),
    halved AS (SELECT conv_id, before, min(size) AS kept FROM halving GROUP BY 1, 2)"""


def _halved(spark, sf):
    budgets = _totals(spark, sf).select(
        "conv_id", F.lit(94).alias("fixed_tokens"),
        history.compaction_threshold(F.col("max_in"), F.col("share")).alias("threshold"),
    )
    return history.halving_truncate(_counted(spark, sf).select("conv_id", "recency", "tokens"), budgets)


@query(
    "halving_truncate",
    f"{ctes('messages', 'attachments')}, {_VISIBLE}, {_COUNTED}, {_HALVED} SELECT * FROM halved",
)
def halving_truncate(spark, sf):
    return _halved(spark, sf).select("conv_id", F.col("before").cast("bigint").alias("before"), F.col("kept").cast("bigint").alias("kept"))


@query(
    "mark_truncated",
    f"""{ctes('messages', 'attachments')}, {_VISIBLE}, {_COUNTED}, {_HALVED},
    oldest AS (SELECT message_id FROM (SELECT message_id, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM shown) s
        JOIN halved h ON h.conv_id = s.conv_id WHERE n <= before - kept)
    SELECT m.message_id, truncated OR o.message_id IS NOT NULL AS truncated FROM messages m LEFT JOIN oldest o ON o.message_id = m.message_id""",
)
def mark_truncated(spark, sf):
    counts = _halved(spark, sf).select("conv_id", (F.col("before") - F.col("kept")).alias("count"))
    rows = history.mark_truncated(_messages(spark, sf), counts)
    # rows before the cut that were truncated already keep their flag
    return rows.select("message_id", "truncated")


@query(
    "apply_compaction",
    f"""{ctes('messages')}, tail AS (SELECT conv_id, max(turn) + 1 AS turn FROM messages WHERE conv_id % 3 = 0 GROUP BY 1)
    SELECT message_id, compacted OR conv_id % 3 = 0 AS compacted, false AS is_summary, md5(content) AS digest FROM messages
    UNION ALL SELECT conv_id * 4294967296 + turn, false, true, md5('summary ' || conv_id) FROM tail""",
)
def apply_compaction(spark, sf):
    rows = _messages(spark, sf)
    tail = rows.where("conv_id % 3 = 0").groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"))
    summaries = tail.select(
        "conv_id", (F.col("conv_id") * (1 << 32) + F.col("turn")).alias("message_id"), "turn",
        F.concat(F.lit("summary "), F.col("conv_id").cast("string")).alias("summary"),
    )
    return history.apply_compaction(rows, summaries).select("message_id", "compacted", "is_summary", F.md5("content").alias("digest"))


_ASK = (
    "Create a concise but comprehensive summary of this conversation. Preserve all key facts, decisions, user requirements, "
    "and important context. The summary should be complete enough that someone reading it would understand everything that "
    "was discussed and decided."
)


@query(
    "summary_transcript",
    f"""{ctes('messages', 'attachments')}, {_VISIBLE}, marks AS (SELECT message_id, string_agg(CASE WHEN mime_type LIKE 'image/%'
        THEN chr(10) || '[Image Attachment: ' || name || ']' ELSE chr(10) || '[File Attachment: ' || name || ']' ||
          CASE WHEN file_text IS NULL THEN '' ELSE chr(10) || '--- Content ---' || chr(10) || file_text || chr(10) || '---------------' END END, '' ORDER BY seq) AS m
        FROM attachments GROUP BY 1)
    SELECT conv_id, md5('Recent conversation:' || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || content || coalesce(m, ''),
        chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || '{_ASK}') AS prompt
      FROM shown s LEFT JOIN marks k ON k.message_id = s.message_id GROUP BY 1""",
)
def summary_transcript(spark, sf):
    rows = history.with_attachments(history.history(_messages(spark, sf)), derived(spark, sf, "attachments"))
    return history.summary_transcript(rows).select("conv_id", F.md5("prompt").alias("prompt"))


@query(
    "output_budget",
    f"""{ctes('messages', 'attachments')}, {_VISIBLE}, {_COUNTED}, {_TOTALS}
    SELECT conv_id, {MAX_IN} - (history_tokens + 94) AS remaining, CASE WHEN {MAX_IN} - (history_tokens + 94) < 100 THEN 'rejected' ELSE 'ok' END AS status,
        CASE WHEN {MAX_IN} - (history_tokens + 94) >= 100 THEN greatest(16, least({MAX_OUT}, {MAX_IN} - (history_tokens + 94) - 50)) END AS output_tokens FROM totals""",
)
def output_budget(spark, sf):
    totals = _totals(spark, sf).withColumn(
        "prompt_tokens", history.prompt_total(F.col("system_tokens"), F.col("history_tokens"), F.col("new_tokens"))
    )
    return history.output_budget(totals).select("conv_id", "remaining", "status", "output_tokens")


@query(
    "refinement_window",
    f"""{ctes('messages')}, {_VISIBLE}, recent AS (SELECT conv_id, -row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS pos,
        CASE WHEN role = 'ai' THEN 'assistant' ELSE role END AS role, md5(content) AS digest FROM shown)
    SELECT * FROM recent WHERE pos >= -5 UNION ALL SELECT DISTINCT conv_id, 0, 'user', md5('next ' || conv_id) FROM messages""",
)
def refinement_window(spark, sf):
    rows = _messages(spark, sf)
    asked = rows.select("conv_id").distinct().withColumn("query", F.concat(F.lit("next "), F.col("conv_id").cast("string")))
    out = history.refinement_window(history.history(rows), asked)
    return out.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "role", F.md5("content").alias("digest"))


@query(
    "conversation_title",
    f"""{ctes('messages')} SELECT message_id, CASE WHEN length({q.strip('content')}) <= 50 THEN {q.strip('content')} ELSE
        regexp_replace(substr({q.strip('content')}, 1, 50), ' [^ ]*$', '') || '...' END AS title FROM messages""",
)
def conversation_title(spark, sf):
    return _messages(spark, sf).select("message_id", text.title(F.col("content")).alias("title"))


@query(
    "last_activity",
    f"""{ctes('messages')}, pairs AS (SELECT conv_id, max(turn) AS t FROM messages GROUP BY 1)
    SELECT conv_id, t + 2 AS last_turn, (SELECT count(*) FROM messages m WHERE m.conv_id = p.conv_id) + 2 AS messages FROM pairs p""",
)
def last_activity(spark, sf):
    rows = _messages(spark, sf)
    tail = rows.groupBy("conv_id").agg(F.max("turn").alias("t"))
    pair = tail.select(
        "conv_id",
        F.explode(F.array(F.struct((F.col("t") + 1).alias("turn"), F.lit("user").alias("role")),
                          F.struct((F.col("t") + 2).alias("turn"), F.lit("ai").alias("role")))).alias("p"),
    ).select("conv_id", "p.*", F.lit("new").alias("content"))
    return history.last_activity(history.append_pairs(rows, pair))


@query(
    "usage_fallback",
    f"""SELECT conv_id, turn, coalesce(CASE WHEN turn % 2 = 0 THEN turn * 10 END, {q.tokens('text')}) AS prompt_tokens,
        coalesce(CASE WHEN turn % 2 = 0 THEN turn END, {_model_tokens('text')}) AS completion_tokens FROM conversations""",
)
def usage_fallback(spark, sf):
    t = F.col("text")
    even = F.col("turn") % 2 == 0
    usage = history.usage_or_estimate(
        F.when(even, F.col("turn") * 10), F.when(even, F.col("turn")),
        text.model_tokens(t, F.lit("gpt-4o")), text.model_tokens(t, F.lit(MODEL)),
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", usage.alias("u")).select("conv_id", "turn", "u.*")


# contexts: every question carries two citations, every third answer one of its own
_CITED = """cited AS (SELECT message_id, conv_id, turn, role, content || ' see [1] and [' || (turn % 4) || ']' AS content,
        CASE WHEN role = 'user' AND turn % 4 <> 3 THEN ['1=a' || turn, '2=b' || turn]
             WHEN role = 'ai' AND turn % 3 = 0 THEN ['1=own' || turn] END AS ctx FROM messages),
    attached AS (SELECT *, CASE WHEN role = 'ai' AND lag(role) OVER w = 'user' AND lag(ctx) OVER w IS NOT NULL THEN lag(ctx) OVER w ELSE ctx END AS cites
        FROM cited WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def _cited(spark, sf):
    entry = lambda i, name: F.struct(F.lit(i).alias("index"), F.concat(F.lit(name), F.col("turn").cast("string")).alias("document_filename"))
    rows = _messages(spark, sf).withColumn(
        "context",
        F.when((F.col("role") == "user") & (F.col("turn") % 4 != 3), F.array(entry(1, "a"), entry(2, "b"))).when(
            (F.col("role") == "ai") & (F.col("turn") % 3 == 0), F.array(entry(1, "own"))
        ),
    )
    marks = F.concat("content", F.lit(" see [1] and ["), (F.col("turn") % 4).cast("string"), F.lit("]"))
    return history.attach_citations(rows.withColumn("content", marks))


@query("citation_attach", f"{ctes('messages')}, {_CITED} SELECT message_id, array_to_string(cites, ' ') AS citations FROM attached")
def citation_attach(spark, sf):
    show = F.transform("citations", lambda c: F.concat(c["index"].cast("string"), F.lit("="), c["document_filename"]))
    return _cited(spark, sf).select("message_id", F.array_join(show, " ").alias("citations"))


@query(
    "citation_resolve",
    f"""{ctes('messages')}, {_CITED}, marks AS (SELECT message_id, cites, unnest(regexp_extract_all(content, '\\[([0-9]+)\\]', 1)) AS mark,
        generate_subscripts(regexp_extract_all(content, '\\[([0-9]+)\\]', 1), 1) - 1 AS pos FROM attached)
    SELECT message_id, CAST(pos AS BIGINT) AS pos, mark, list_filter(cites, lambda c: starts_with(c, mark || '='))[1][3:] AS source FROM marks""",
)
def citation_resolve(spark, sf):
    return history.resolve_citations(_cited(spark, sf)).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "answer_pairs",
    f"""{ctes('messages')}, seq AS (SELECT *, CASE WHEN role = 'ai' AND variant = 'rag_on' THEN 'on' WHEN role = 'ai' AND variant = 'rag_off' THEN 'off' ELSE 'other' END AS k FROM messages),
    near AS (SELECT *, lag(k) OVER w AS before, lead(k) OVER w AS after, lead(message_id) OVER w AS next_id FROM seq WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, CASE WHEN k = 'other' THEN 'single' ELSE 'pair' END AS kind, CASE WHEN k <> 'off' THEN message_id END AS left_id,
        CASE WHEN k = 'off' THEN message_id WHEN k = 'on' AND after = 'off' THEN next_id END AS right_id
      FROM near WHERE NOT (k = 'off' AND before IS NOT DISTINCT FROM 'on')""",
)
def answer_pairs(spark, sf):
    return history.answer_pairs(_messages(spark, sf))


_HEADS = """heads AS (SELECT conv_id, conv_id % 5 AS user_id, max(turn) AS last_turn, min_by(text, turn) AS title FROM conversations GROUP BY 1)"""


def _heads(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.max("turn").alias("last_turn"), F.min_by("text", "turn").alias("title")
    ).withColumn("user_id", F.col("conv_id") % 5)


@query("history_search", f"WITH {_HEADS} SELECT conv_id, last_turn FROM heads WHERE lower(title) LIKE '%the%'")
def history_search(spark, sf):
    return history.search_titles(_heads(spark, sf), " The ").select("conv_id", "last_turn").orderBy(F.desc("last_turn"))


@query("document_picker", "SELECT doc_id::VARCHAR AS document_id, 'doc-' || doc_id || '.' || lang AS filename FROM documents WHERE 'doc-' || doc_id || '.' || lang LIKE '%1.e%'")
def document_picker(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("filename"),
    )
    return history.search_titles(rows, "1.E", "filename")


@query(
    "keyset_page",
    f"""WITH {_HEADS}, totals AS (SELECT user_id, count(*) AS total FROM heads GROUP BY 1)
    SELECT h.user_id, conv_id, last_turn, row_number() OVER (PARTITION BY h.user_id ORDER BY last_turn DESC, conv_id DESC) AS nth, total
      FROM heads h JOIN totals t ON t.user_id = h.user_id WHERE h.user_id = 0 OR (last_turn, conv_id) < (5, 60) QUALIFY nth <= 20""",
)
def keyset_page(spark, sf):
    heads = _heads(spark, sf)
    first = F.col("user_id") == 0
    cursors = heads.select("user_id").distinct().select(
        "user_id", F.when(~first, F.lit(5).cast("bigint")).alias("cursor_order"), F.when(~first, F.lit(60).cast("bigint")).alias("cursor_id")
    )
    return history.keyset_page(heads, cursors, "user_id", "last_turn", "conv_id").drop("title")


@query("unseen_merge", "SELECT conv_id, turn FROM conversations")
def unseen_merge(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn")
    return history.merge_unseen(rows.where("turn < 5"), rows.where("turn > 1"), ["conv_id", "turn"])


@query("user_isolation", f"WITH {_HEADS} SELECT conv_id, title FROM heads WHERE user_id = 3")
def user_isolation(spark, sf):
    return history.owned_by(_heads(spark, sf), 3).select("conv_id", "title")


_USES = """uses AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'llamacpp' WHEN event_type IN ('view', 'click') THEN 'a' ELSE 'b' END AS provider,
        'm' || (CAST(floor(value) AS BIGINT) % 5) AS model, event_id AS used_at FROM {t})"""


@query(
    "recent_models",
    f"""WITH {_USES.format(t='events')}, last AS (SELECT user_id, provider, model, max(used_at) AS used_at FROM uses WHERE provider <> 'llamacpp' GROUP BY 1, 2, 3)
    SELECT user_id, provider, string_agg(model, ' ' ORDER BY used_at DESC) AS models FROM last GROUP BY 1, 2""",
)
def recent_models(spark, sf):
    from docweir.catalog import inputs

    uses = inputs.run(spark, sf, f"WITH {_USES.format(t='@events')} SELECT * FROM uses")
    return history.recent_models(uses).withColumn("models", F.array_join("models", " "))


# ---- listings -----------------------------------------------------------------------------------


def _users(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("user_id")).distinct().withColumn(
        "email", F.concat(F.col("user_id"), F.lit("@Example.org"))
    )


@query(
    "browse_documents",
    """SELECT doc_id, source AS user_id, lang AS language, n_chars AS created, 'f-' || doc_id || '.txt' AS filename, source || '@Example.org' AS email
       FROM documents WHERE lang = 'en' AND (lower('f-' || doc_id || '.txt') LIKE '%src1%' OR lower(source || '@Example.org') LIKE '%src1%')""",
)
def browse_documents(spark, sf):
    rows = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("user_id"), F.col("lang").alias("language"), F.col("n_chars").alias("created"),
        F.concat(F.lit("f-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.col("text").alias("raw_text"),
    )
    return browse.browse(
        rows, {"language": "en"}, "SRC1", ("filename", "email"), newest="created", hide=("raw_text",), users=_users(spark, sf)
    )


@query(
    "browse_chunks",
    "SELECT doc_id, 0::BIGINT AS chunk_index, lang, substr(text, 1, 100) AS content_preview FROM documents WHERE lower(text) LIKE '%the%'",
)
def browse_chunks(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.lit(0).cast("bigint").alias("chunk_index"), "lang", F.col("text").alias("content"))
    found = browse.browse(rows, search="the", search_in=("content",), order=("doc_id", "chunk_index"))
    return browse.preview(found)


@query(
    "browse_jobs",
    """SELECT event_id, user_id, event_type AS status, props AS url FROM events WHERE event_type = 'error' AND (props LIKE '%9%' OR user_id::VARCHAR LIKE '%9%')""",
)
def browse_jobs(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", "user_id", F.col("event_type").alias("status"), F.col("props").alias("url"), F.col("user_id").cast("string").alias("job")
    )
    return browse.browse(rows, {"status": "error"}, "9", ("url", "job"), newest="event_id").drop("job")


@query(
    "job_list",
    """SELECT event_id AS job_id, CASE WHEN event_type = 'view' THEN props END AS url, CASE WHEN event_type = 'click' THEN props END AS github_repo
       FROM events WHERE event_type IN ('view', 'click')""",
)
def job_list(spark, sf):
    kind = F.col("event_type")
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("job_id"), F.when(kind == "view", F.col("props")).alias("url"),
        F.when(kind == "click", F.col("props")).alias("github_repo"), F.col("props").alias("result"),
    )
    return sinks.job_list(rows)


@query(
    "browse_messages",
    f"{ctes('messages')} SELECT message_id, role, turn FROM messages WHERE role = 'ai' AND lower(content) LIKE '%re%' AND lower(content) LIKE '%th%'",
)
def browse_messages(spark, sf):
    found = browse.browse(_messages(spark, sf), {"role": "ai"}, "re TH", ("content", "raw_question"), newest="turn", order=("message_id",))
    return found.select("message_id", "role", "turn")


# ---- jobs and token streams ---------------------------------------------------------------------

_POLLS = """numbered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n FROM job_events),
    bounded AS (SELECT * FROM numbered WHERE n <= 201),
    islands AS (SELECT *, sum(CASE WHEN http_ok THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY n) AS island FROM bounded),
    streaks AS (SELECT *, sum(CASE WHEN http_ok THEN 0 ELSE 1 END) OVER (PARTITION BY job_id, island ORDER BY n) AS streak FROM islands)"""


@query(
    "job_state_last",
    f"""{ctes('job_events')}, {_POLLS},
    ends AS (SELECT job_id, n, CASE WHEN n > 200 OR streak >= 5 THEN 'failed' WHEN http_ok AND status IN ('completed', 'failed') THEN status END AS final,
        CASE WHEN n > 200 THEN 'Polling timed out after 10 minutes.' WHEN streak >= 5 THEN 'Microservice unreachable after multiple attempts'
             WHEN http_ok AND status = 'failed' THEN 'Job failed in microservice.' END AS error FROM streaks),
    stops AS (SELECT job_id, min(n) AS stop, min_by(final, n) AS final, nullif(min_by(coalesce(error, ''), n), '') AS error FROM ends WHERE final IS NOT NULL GROUP BY 1),
    lived AS (SELECT s.*, stop, final, error FROM streaks s LEFT JOIN stops t ON t.job_id = s.job_id WHERE stop IS NULL OR n <= stop),
    answered AS (SELECT * FROM lived WHERE http_ok AND (stop IS NULL OR n < stop OR final = 'completed'))
    SELECT l.job_id, coalesce(any_value(final), (SELECT max_by(status, n) FROM answered a WHERE a.job_id = l.job_id AND status IN ('pending', 'in_progress')), 'pending') AS status,
        any_value(error) AS error_message, (SELECT max_by(pages_fetched, n) FROM answered a WHERE a.job_id = l.job_id) AS pages_fetched,
        (SELECT max_by(pages_total, n) FROM answered a WHERE a.job_id = l.job_id) AS pages_total, max(n) AS polls FROM lived l GROUP BY 1""",
)
def job_state_last(spark, sf):
    return jobs.job_states(derived(spark, sf, "job_events"))


@query(
    "job_failure_runs",
    f"""{ctes('job_events')}, {_POLLS} SELECT job_id, max(run) AS longest_run, max(run) >= 5 AS gives_up FROM
      (SELECT job_id, island, count(*) FILTER (NOT http_ok) AS run FROM streaks WHERE n <= 200 GROUP BY 1, 2) r GROUP BY 1""",
)
def job_failure_runs(spark, sf):
    return jobs.failure_runs(derived(spark, sf, "job_events"))


@query(
    "job_progress",
    f"{ctes('job_events')} SELECT job_id, max_by(pages_fetched, seq) AS pages_fetched, max_by(pages_total, seq) AS pages_total FROM job_events WHERE http_ok GROUP BY 1",
)
def job_progress(spark, sf):
    return jobs.progress(derived(spark, sf, "job_events"))


@query(
    "job_expiry",
    """WITH last AS (SELECT user_id, max(ts) AS ts, max_by(event_type, ts) AS kind FROM events GROUP BY 1), edge AS (SELECT max(ts) AS as_of FROM events)
    SELECT user_id AS job_id, CASE WHEN epoch_us(as_of) - epoch_us(ts) < (CASE WHEN kind = 'purchase' THEN 3600 ELSE 600 END) * 1000000::BIGINT
        THEN CASE WHEN kind = 'purchase' THEN 'completed' ELSE 'in_progress' END END AS status FROM last, edge""",
)
def job_expiry(spark, sf):
    ts = F.col("ts").cast("timestamp")
    events = table(spark, sf, "events")
    edge = events.agg(F.max(ts).alias("as_of")).scalar()
    last = events.groupBy(F.col("user_id").alias("job_id")).agg(
        F.max(ts).alias("updated_at"), F.max_by("event_type", "ts").alias("kind")
    )
    states = last.select("job_id", "updated_at", F.when(F.col("kind") == "purchase", "completed").otherwise("in_progress").alias("status"))
    return jobs.expire(states, edge).select("job_id", "status")


@query(
    "token_assembly",
    """SELECT conv_id, turn, CASE WHEN conv_id % 6 <> 1 AND conv_id % 4 = 0 THEN text || ' ' || chr(10) || chr(10) || '*Error: boom*' ELSE text || ' ' END AS content,
        CASE WHEN conv_id % 6 = 1 THEN 'stopped' WHEN conv_id % 4 = 0 THEN 'error' ELSE 'done' END AS ended_by,
        CASE WHEN conv_id % 6 = 1 THEN 0 ELSE length(text) END AS total_tokens FROM conversations WHERE role = 'assistant'""",
)
def token_assembly(spark, sf):
    return tokens.assemble(derived(spark, sf, "token_events"), ["conv_id", "turn"])


@query(
    "stopped_generation",
    """WITH a AS (SELECT *, string_split(text, ' ') AS words, conv_id % 6 = 1 AS stopped, CASE WHEN conv_id % 12 = 1 THEN 0 ELSE len(string_split(text, ' ')) // 2 END AS n
        FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, CASE WHEN stopped AND n = 0 THEN '*Generation stopped.*' WHEN stopped THEN array_to_string(words[1:n], ' ') || ' '
            WHEN conv_id % 4 = 0 THEN text || ' ' || chr(10) || chr(10) || '*Error: boom*' ELSE text || ' ' END AS content,
        CASE WHEN stopped THEN 'stopped' WHEN conv_id % 4 = 0 THEN 'error' ELSE 'done' END AS ended_by,
        CASE WHEN stopped THEN 0 ELSE length(text) END AS total_tokens FROM a""",
)
def stopped_generation(spark, sf):
    """Every sixth dialogue stops its answers: half of them after half of the words, half before the first one."""
    events = derived(spark, sf, "token_events")
    counts = F.count(F.when(F.col("type") == "token", 1)).over(Window.partitionBy("conv_id", "turn"))
    stop = F.when(F.col("conv_id") % 12 == 1, 0).otherwise(F.floor(counts / 2))
    behind = (F.col("conv_id") % 6 == 1) & (F.col("type") == "token") & (F.col("seq") >= stop)
    return tokens.assemble(events.withColumn("_behind", behind).where("NOT _behind").drop("_behind"), ["conv_id", "turn"])


_SSE = """SELECT event_id, CASE WHEN event_type = 'view' THEN ': keep-alive' WHEN event_type = 'click' THEN 'data: {"type": "token", "content": "w' || event_id || '", "variant": "rag_on"}'
    WHEN event_type = 'purchase' THEN '  data: {"type": "done"}  ' WHEN event_type = 'signup' THEN 'data: {broken ' ELSE 'data: {"type": "error"}' END AS line FROM {t}"""


@query(
    "sse_parse",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'token' WHEN 'purchase' THEN 'done' ELSE 'error' END AS type,
        CASE event_type WHEN 'click' THEN 'w' || event_id WHEN 'error' THEN 'Unknown streaming error' END AS content,
        CASE WHEN event_type = 'click' THEN 'rag_on' END AS variant FROM events WHERE event_type IN ('click', 'purchase', 'error')""",
)
def sse_parse(spark, sf):
    from docweir.catalog import inputs

    return tokens.parse_lines(inputs.run(spark, sf, _SSE.replace("{t}", "@events")))
