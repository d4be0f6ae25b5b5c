"""Stored dialogues: history selection, token budgets, compaction, citations, listings.

``messages`` rows carry ``(message_id, conv_id, turn, role, variant, content,
raw_question, compacted, truncated)``. Selections that keep the last or first few
rows of a dialogue are ranked windows with a group limit, which trims long
dialogues before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweir import params
from docweir.functions import text
from docweir.operators.blocks import first_rows, with_neighbour

STOPPED = "*Generation stopped.*"


# ---- selection ----------------------------------------------------------------------------------


def visible(messages: DataFrame) -> DataFrame:
    return messages.where(~F.col("compacted") & ~F.col("truncated"))


def of_variant(messages: DataFrame, variant: str) -> DataFrame:
    """Rows of one answer variant and the rows both variants share."""
    return messages.where((F.col("variant") == variant) | F.col("variant").isNull())


def last_messages(messages: DataFrame, limit: int = params.HISTORY_LIMIT) -> DataFrame:
    """The newest ``limit`` rows of each dialogue; ``recency`` counts back from the newest."""
    newest = [F.desc("turn"), F.desc("message_id")]
    return first_rows(messages, "conv_id", newest, limit, "recency", "message_id")


def as_prompt(messages: DataFrame, variant: str | None = None) -> DataFrame:
    """Model roles; without retrieval a question shows as it was typed."""
    content = F.col("content")
    if variant == "rag_off":
        typed = F.nullif("raw_question", F.lit(""))
        content = F.when(F.col("role") == "user", F.coalesce(typed, content)).otherwise(content)
    return messages.withColumn("content", content).withColumn(
        "role", F.when(F.col("role") == "ai", "assistant").otherwise(F.col("role"))
    )


def history(
    messages: DataFrame, limit: int = params.HISTORY_LIMIT, variant: str | None = None, hide: bool = True
) -> DataFrame:
    rows = visible(messages) if hide else messages
    rows = of_variant(rows, variant) if variant else rows
    return as_prompt(last_messages(rows, limit), variant)


def with_attachments(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Nest each message's files as ``attachments``, an empty array when it has none."""
    fields = ["seq", "file_id", "name", "size", "mime_type", "file_text"]
    nested = attachments.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("attachments"))
    of_type = nested.schema["attachments"].dataType
    return messages.join(nested, "message_id", "left").withColumn(
        "attachments", F.coalesce("attachments", F.array().cast(of_type))
    )


def attachment_kind(mime_type: Column) -> Column:
    return F.when(F.startswith(mime_type, F.lit("image/")), "image").otherwise("document")


# ---- tokens -------------------------------------------------------------------------------------


def _is_image(a: Column) -> Column:
    return F.startswith(a["mime_type"], F.lit("image/"))


def message_tokens(content: Column, attachments: Column, model: Column) -> Column:
    """Three tokens per message plus its text with its text files, and a flat cost per image."""
    files = F.filter(attachments, lambda a: ~_is_image(a))
    # The frame of a file's text in a prompt.
    blocks = F.transform(
        files,
        lambda a: F.concat(
            F.lit("\n--- File: "), a["name"], F.lit(" ---\n"),
            F.coalesce(
                F.nullif(a["file_text"], F.lit("")),
                F.concat(F.lit("Size: "), a["size"].cast("string"), F.lit(" bytes")),
            ),
            F.lit("\n----------------"),
        ),
    )
    images = F.size(F.filter(attachments, _is_image))
    whole = F.concat(content, F.array_join(blocks, ""))
    return 3 + text.model_tokens(whole, model) + images * params.IMAGE_TOKENS


def system_tokens(prompt: Column, model: Column) -> Column:
    return F.when(text.is_blank(prompt), F.lit(0).cast("bigint")).otherwise(3 + text.model_tokens(prompt, model))


def compaction_threshold(max_in: Column, share: Column) -> Column:
    headroom = F.least(F.lit(1024), F.floor(max_in / 4)) + 200
    return F.greatest(
        F.least(max_in - headroom, F.floor(max_in * share)), F.floor(max_in / 2)
    )


def prompt_total(system: Column, hist: Column, new: Column) -> Column:
    return system + hist + new + params.PROMPT_MARGIN


def compaction_decision(totals: DataFrame) -> DataFrame:
    """``(conv_id, system_tokens, history_tokens, new_tokens, max_in, share)`` -> total and decision."""
    total = prompt_total(F.col("system_tokens"), F.col("history_tokens"), F.col("new_tokens"))
    limit = compaction_threshold(F.col("max_in"), F.col("share"))
    return totals.withColumn("total", total).withColumn("threshold", limit).withColumn("compact", total > limit)


def halving_truncate(rows: DataFrame, budgets: DataFrame, limit: int = params.HISTORY_LIMIT) -> DataFrame:
    """How many of each dialogue's newest messages survive halving.

    ``rows`` is ``(conv_id, recency, tokens)`` of at most ``limit`` messages per
    dialogue and ``budgets`` ``(conv_id, fixed_tokens, threshold)``. Halving drops
    the older half until the rest fits or one message is left, so the sizes it
    can stop at are known up front and the first that fits is the answer.
    """
    lists = rows.groupBy("conv_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("recency", "tokens"))), lambda s: s["tokens"]
        ).alias("newest")
    )
    n = F.size("newest")
    sizes = F.aggregate(
        F.sequence(F.lit(1), F.lit(max(limit, 2).bit_length())),
        F.array(n),
        lambda acc, _: F.array_append(acc, F.element_at(acc, -1) - F.floor(F.element_at(acc, -1) / 2).cast("int")),
    )

    def fits(size: Column) -> Column:
        kept = F.aggregate(F.slice("newest", F.lit(1), size), F.lit(0).cast("bigint"), lambda s, t: s + t)
        return (size <= 1) | (F.col("fixed_tokens") + kept <= F.col("threshold"))

    return lists.join(budgets, "conv_id").select(
        "conv_id", n.alias("before"), F.try_element_at(F.filter(sizes, fits), F.lit(1)).alias("kept")
    )


def mark_truncated(messages: DataFrame, counts: DataFrame) -> DataFrame:
    """Flag the oldest ``count`` visible rows of each dialogue as truncated.

    The last row to flag is found first (the counts bound the ranked rows), then
    rows are flagged by comparing positions, without ranking whole dialogues.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "message_id")
    cut = (
        visible(messages)
        .join(counts.where(F.col("count") > 0), "conv_id")
        .withColumn("_n", F.row_number().over(w))
        .where(F.col("_n") <= F.col("count"))
        .groupBy("conv_id")
        .agg(F.max(F.struct("turn", "message_id")).alias("_cut"))
    )
    hit = ~F.col("compacted") & (F.struct("turn", "message_id") <= F.col("_cut"))
    return (
        messages.join(cut, "conv_id", "left")
        .withColumn("truncated", F.col("truncated") | F.coalesce(hit, F.lit(False)))
        .drop("_cut")
    )


def apply_compaction(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """Flag all rows of summarised dialogues and append their summary rows.

    ``summaries`` is ``(conv_id, message_id, turn, summary)``.
    """
    done = summaries.select("conv_id", F.lit(True).alias("_done"))
    flagged = (
        messages.join(done, "conv_id", "left")
        .withColumn("compacted", F.col("compacted") | F.coalesce("_done", F.lit(False)))
        .drop("_done")
        .withColumn("is_summary", F.lit(False))
    )
    rows = summaries.select(
        "conv_id", "message_id", "turn", F.lit("ai").alias("role"), F.col("summary").alias("content"),
        F.lit(False).alias("compacted"), F.lit(False).alias("truncated"), F.lit(True).alias("is_summary"),
    )
    return flagged.unionByName(rows, allowMissingColumns=True)


def summary_transcript(rows: DataFrame) -> DataFrame:
    """History with nested attachments -> the text a summary is asked for.

    Takes rows of :func:`history`, so a dialogue brings at most the history limit.
    """

    # How attachments are told in a transcript.
    def marker(a: Column) -> Column:
        body = F.when(
            F.coalesce(a["file_text"], F.lit("")) != "",
            F.concat(F.lit("\n--- Content ---\n"), a["file_text"], F.lit("\n---------------")),
        ).otherwise(F.lit(""))
        return F.when(
            _is_image(a), F.concat(F.lit("\n[Image Attachment: "), a["name"], F.lit("]"))
        ).otherwise(F.concat(F.lit("\n[File Attachment: "), a["name"], F.lit("]"), body))

    label = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    line = F.concat(label, "content", F.array_join(F.transform("attachments", marker), ""))
    joined = rows.select("conv_id", F.struct((-F.col("recency")).alias("p"), line.alias("line")).alias("r"))
    # Fixed text of the request.
    ask = (
        "Create a concise but comprehensive summary of this conversation. "
        "Preserve all key facts, decisions, user requirements, and important context. "
        "The summary should be complete enough that someone reading it would understand "
        "everything that was discussed and decided."
    )
    return joined.groupBy("conv_id").agg(F.sort_array(F.collect_list("r")).alias("r")).select(
        "conv_id",
        F.concat(
            F.lit("Recent conversation:\n"), F.array_join(F.transform("r", lambda r: r["line"]), "\n\n"),
            F.lit("\n\n" + ask),
        ).alias("prompt"),
    )


def output_budget(totals: DataFrame) -> DataFrame:
    """``(conv_id, prompt_tokens, max_in, max_out)`` -> output limit, or a rejection."""
    left = F.col("max_in") - F.col("prompt_tokens")
    return totals.withColumn("remaining", left).withColumn(
        "status", F.when(left < 100, "rejected").otherwise("ok")
    ).withColumn(
        "output_tokens", F.when(left >= 100, F.greatest(F.lit(16), F.least(F.col("max_out"), left - 50)))
    )


def refinement_window(rows: DataFrame, queries: DataFrame, limit: int = params.REFINEMENT_HISTORY) -> DataFrame:
    """The last few history rows of each dialogue followed by the new query."""
    recent = rows.where(F.col("recency") <= limit).select("conv_id", (-F.col("recency")).alias("pos"), "role", "content")
    return recent.unionByName(
        queries.select("conv_id", F.lit(0).alias("pos"), F.lit("user").alias("role"), F.col("query").alias("content"))
    )


def append_pairs(messages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Append question and answer rows that are built by the caller in the messages' shape."""
    return messages.unionByName(pairs, allowMissingColumns=True)


def last_activity(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("messages"))


def usage_or_estimate(prompt: Column, completion: Column, est_prompt: Column, est_completion: Column) -> Column:
    """Reported usage, or the estimate when the provider sent none."""
    return F.when(
        prompt.isNull() & completion.isNull(),
        F.struct(est_prompt.alias("prompt_tokens"), est_completion.alias("completion_tokens")),
    ).otherwise(F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens")))


# ---- citations and pairs ------------------------------------------------------------------------


def attach_citations(messages: DataFrame) -> DataFrame:
    """Answers cite the context of the question right before them, else their own."""
    prev = F.struct("role", "context")
    rows = with_neighbour(messages, "conv_id", "turn", "_prev", prev)
    borrowed = F.when(
        (F.col("role") == "ai") & (F.col("_prev.role") == "user"), F.col("_prev.context")
    )
    return rows.withColumn("citations", F.coalesce(borrowed, F.col("context"))).drop("_prev")


def resolve_citations(messages: DataFrame) -> DataFrame:
    """``[n]`` marks of each message with the citation they name; unknown numbers stay null."""
    marks = messages.select(
        "message_id", "citations",
        F.posexplode(F.regexp_extract_all("content", F.lit(r"\[([0-9]+)\]"), F.lit(1))).alias("pos", "mark"),
    )
    hit = F.try_element_at(
        F.filter("citations", lambda c: c["index"].cast("string") == F.col("mark")), F.lit(-1)
    )
    return marks.select("message_id", "pos", "mark", hit["document_filename"].alias("source"))


def answer_pairs(messages: DataFrame) -> DataFrame:
    """Side-by-side view: an answer with retrieval and the one without right behind it form a pair.

    Lone variant answers get an empty partner; rows of other kinds pass as they are.
    """
    is_on = (F.col("role") == "ai") & F.col("variant").eqNullSafe(F.lit("rag_on"))
    is_off = (F.col("role") == "ai") & F.col("variant").eqNullSafe(F.lit("rag_off"))
    marked = messages.withColumn("_k", F.when(is_on, "on").when(is_off, "off").otherwise("other"))
    rows = with_neighbour(marked, "conv_id", "turn", "_next", F.struct("_k", "message_id"), 1)
    rows = with_neighbour(rows, "conv_id", "turn", "_before", F.col("_k"), -1)
    consumed = (F.col("_k") == "off") & F.col("_before").eqNullSafe(F.lit("on"))
    return rows.where(~consumed & F.col("role").isin("user", "ai")).select(
        "conv_id", "turn",
        F.when(F.col("_k") == "other", "single").otherwise("pair").alias("kind"),
        F.when(F.col("_k") == "off", F.lit(None).cast("bigint")).otherwise(F.col("message_id")).alias("left_id"),
        F.when(F.col("_k") == "off", F.col("message_id"))
        .when((F.col("_k") == "on") & (F.col("_next._k") == "off"), F.col("_next.message_id")).alias("right_id"),
    )


# ---- listings -----------------------------------------------------------------------------------


def search_titles(rows: DataFrame, needle: str, title: str = "title") -> DataFrame:
    """Rows whose title holds the needle, whatever the case; a blank needle keeps all."""
    bare = needle.strip().lower()
    return rows.where(F.contains(F.lower(title), F.lit(bare))) if bare else rows


def keyset_page(rows: DataFrame, cursors: DataFrame, key: str, order: str, row_id: str, size: int = params.PAGE_SIZE) -> DataFrame:
    """The page behind each owner's cursor, newest first, with the owner's total count.

    ``cursors`` is ``(key, cursor_order, cursor_id)``; null cursors ask for page one.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    after = F.col("cursor_order").isNull() | (
        F.struct(F.col(order), F.col(row_id)) < F.struct(F.col("cursor_order"), F.col("cursor_id"))
    )
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc(row_id))
    return (
        rows.join(cursors, key)
        .where(after)
        .withColumn("nth", F.row_number().over(w))
        .where(F.col("nth") <= size)
        .join(counts, key)
        .drop("cursor_order", "cursor_id")
    )


def merge_unseen(shown: DataFrame, page: DataFrame, keys: list[str]) -> DataFrame:
    """Append the rows of a page that are not shown yet."""
    return shown.unionByName(page.join(shown.select(*keys), keys, "left_anti"))


def owned_by(rows: DataFrame, user_id) -> DataFrame:
    return rows.where(F.col("user_id") == user_id)


def recent_models(uses: DataFrame) -> DataFrame:
    """Distinct models per user and provider, most recently used first."""
    named = uses.where((F.col("provider") != "llamacpp") & F.col("model").rlike(r"\S")).withColumn("model", F.trim("model"))
    last = named.groupBy("user_id", "provider", "model").agg(F.max("used_at").alias("used_at"))
    return last.groupBy("user_id", "provider").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("used_at", "model")), asc=False), lambda s: s["model"]
        ).alias("models")
    )
