"""Documents -> parents -> child chunks.

A document is one row all the way: splitting, indexes and counts happen inside
the row or on its exploded arrays, so chunking never shuffles. ``documents`` has
``(document_id, user_id, filename, content_type, language, raw_text)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir import params
from docweir.functions import text
from docweir.functions.front_matter import split_front_matter
from docweir.functions.windows import count_words, estimate_tokens, pack_parents, scan_blocks, split_windows

#: ``words`` has the number of words of each child.
PARENTS = "array<struct<content:string,breadcrumb:string,children:array<string>,words:array<int>>>"


def once(fn):
    """Has a costly function run once a row: a filter on its result, such as an explode brings, is not moved
    below it, where the function and the texts it reads would be computed a second time."""
    return fn.asNondeterministic()


def char_chunks(c: Column, size: int = params.CHILD_TOKENS, overlap: int = params.CHILD_OVERLAP) -> Column:
    """Split a text into overlapping windows of about ``size`` tokens."""
    width, back = size * params.CHARS_PER_TOKEN, overlap * params.CHARS_PER_TOKEN

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_windows(t or "", width, back))

    return once(split)(c)


def token_chunks(c: Column, size: int = params.CHILD_TOKENS, overlap: int = params.CHILD_OVERLAP) -> Column:
    """Windows of ``size`` white-space tokens that overlap; short texts stay whole."""
    tokens = text.words(c)
    step = size - overlap if overlap < size else size
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)), F.lit(step))
    windows = F.transform(starts, lambda s: F.array_join(F.slice(tokens, s, F.lit(size)), " "))
    return (
        F.when(text.is_blank(c), F.array().cast("array<string>"))
        .when(F.size(tokens) <= size, F.array(text.strip(c)))
        .otherwise(windows)
    )


def front_matter(c: Column) -> Column:
    """Text -> struct(meta JSON, body)."""

    @F.pandas_udf("struct<meta:string,body:string>")
    def split(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split_front_matter(t or "") for t in texts], columns=["meta", "body"])

    return split(c)


def blocks(c: Column) -> Column:
    """Markdown body -> array of (kind, content) blocks."""

    @F.pandas_udf("array<struct<kind:string,content:string>>")
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": k, "content": v} for k, v in scan_blocks(t or "")])

    return scan(c)


def _counted_windows(width: int, back: int) -> Callable[[str | None], dict]:
    """Text -> its windows, or itself where it has none, and their numbers of words, counted while they are at hand."""

    def windows(whole: str | None) -> dict:
        children = split_windows(whole or "", width, back) or [whole]
        return {"children": children, "words": [None if c is None else count_words(c) for c in children]}

    return windows


def _plain_children(width: int, back: int) -> Callable[[Column], Column]:
    counted_windows = _counted_windows(width, back)

    @F.pandas_udf("struct<children:array<string>,words:array<int>>")
    def split(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counted_windows(t) for t in texts], columns=["children", "words"])

    return once(split)


def _markdown_parents(
    count: Callable[[str], int], parent_size: int, width: int, back: int
) -> Callable[[Column], Column]:
    counted_windows = _counted_windows(width, back)

    @F.pandas_udf(f"struct<meta:string,parents:{PARENTS},error:string>")
    def chunk(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for raw in texts:
                try:
                    meta, body = split_front_matter(raw or "")
                    parents = [
                        {"content": c, "breadcrumb": b} | counted_windows(c)
                        for c, b in pack_parents(scan_blocks(body), parent_size, count)
                    ]
                    rows.append((meta, parents, None))
                except Exception as e:  # one bad document must not fail the job
                    rows.append(("{}", [], str(e)))
            yield pd.DataFrame(rows, columns=["meta", "parents", "error"])

    return once(chunk)


def parse_documents(
    documents: DataFrame,
    parent_size: int = params.PARENT_TOKENS,
    child_size: int = params.CHILD_TOKENS,
    child_overlap: int = params.CHILD_OVERLAP,
    count: Callable[[str], int] = estimate_tokens,
) -> DataFrame:
    """Add ``meta``, ``parents`` and ``error``.

    Plain text is one parent with its whole text; everything else is Markdown.
    The two kinds are separate branches, so plain text never enters the scanner.
    """
    width, back = child_size * params.CHARS_PER_TOKEN, child_overlap * params.CHARS_PER_TOKEN
    is_plain = F.col("content_type").eqNullSafe("text/plain")
    windows = _plain_children(width, back)
    plain = (
        documents.where(is_plain)
        .withColumn("_w", windows(F.col("raw_text")))
        .withColumn("meta", F.lit("{}"))
        .withColumn(
            "parents",
            F.array(
                F.struct(
                    F.col("raw_text").alias("content"),
                    F.lit(None).cast("string").alias("breadcrumb"),
                    F.col("_w.children").alias("children"),
                    F.col("_w.words").alias("words"),
                )
            ).cast(PARENTS),
        )
        .withColumn("error", F.lit(None).cast("string"))
        .drop("_w")
    )
    chunk = _markdown_parents(count, parent_size, width, back)
    marked = (
        documents.where(~is_plain)
        .withColumn("_c", chunk(F.col("raw_text")))
        .select(*documents.columns, "_c.meta", "_c.parents", "_c.error")
    )
    return plain.unionByName(marked)


def parent_rows(parsed: DataFrame) -> DataFrame:
    """``(parent_id, document_id, user_id, parent_index, content)``."""
    return parsed.select("document_id", "user_id", F.posexplode("parents").alias("parent_index", "p")).select(
        parent_id(F.col("document_id"), F.col("parent_index")).alias("parent_id"),
        "document_id", "user_id", "parent_index", F.col("p.content").alias("content"),
    )


def parent_id(document_id: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws("/", document_id.cast("string"), F.lit("p"), index.cast("string")), 256)


def chunk_id(document_id: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws("/", document_id.cast("string"), F.lit("c"), index.cast("string")), 256)


def child_rows(parsed: DataFrame) -> DataFrame:
    """Child chunks with their context prefix, running index and word count."""
    flat = F.flatten(
        F.transform(
            "parents",
            lambda p, i: F.transform(
                p["children"],
                lambda c, nth: F.struct(
                    i.alias("parent_index"), p["breadcrumb"].alias("breadcrumb"), c.alias("child"), F.get(p["words"], nth).alias("words")
                ),
            ),
        )
    )
    rows = parsed.select(
        "document_id", "user_id", "filename", "language", F.posexplode(flat).alias("chunk_index", "c")
    )
    prefix = F.concat_ws(
        "\n",
        F.concat(F.lit("[Document: "), "filename", F.lit("]")),
        F.concat(F.lit("[Context: "), F.col("c.breadcrumb"), F.lit("]")),
    )
    content = F.concat(prefix, F.lit("\n\n"), F.col("c.child"))
    # the blank line parts the words of the prefix from those of the child
    word_count = text.word_count(prefix) + F.col("c.words")
    return rows.select(
        chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"),
        parent_id(F.col("document_id"), F.col("c.parent_index")).alias("parent_id"),
        "document_id",
        "user_id",
        "language",
        "chunk_index",
        F.col("c.parent_index").alias("parent_index"),
        content.alias("content"),
        word_count.alias("word_count"),
    )


def lifecycle(parsed: DataFrame) -> DataFrame:
    """Document status after chunking: failed with the error text, else completed; new meta wins."""
    has_meta = ~F.col("meta").isin("{}", "null")
    return parsed.select(
        "document_id",
        F.when(F.col("error").isNotNull(), "failed").otherwise("completed").alias("status"),
        F.col("error").alias("error_message"),
        F.when(has_meta, F.col("meta")).alias("meta"),
        F.size("parents").alias("parents"),
    )


def without_chunks(parsed: DataFrame) -> DataFrame:
    """Documents that produced no parent and are skipped by the sinks."""
    return parsed.where(F.size("parents") == 0).select("document_id", "filename")
