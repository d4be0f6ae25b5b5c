"""Uploaded, pasted, crawled and attached texts: acceptance, routing, decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir import params
from docweir.functions.text import is_blank

# Accepted content types and file endings.
SUPPORTED_TYPES = (
    "text/plain", "text/markdown", "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/msword",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation", "application/vnd.ms-powerpoint",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-excel", "text/csv",
    "application/rtf", "text/rtf", "application/epub+zip", "application/vnd.oasis.opendocument.text",
    "application/vnd.oasis.opendocument.spreadsheet", "application/vnd.oasis.opendocument.presentation",
)
OFFICE_ENDINGS = (
    ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls", ".csv", ".rtf", ".epub", ".odt", ".ods", ".odp",
)
TEXT_ENDINGS = (
    ".txt", ".md", ".markdown", ".py", ".js", ".ts", ".json", ".html", ".css", ".yaml", ".yml", ".toml",
)
PASTE_TYPES = ("text/plain", "text/markdown")
PASTE_NAME = "pasted-text.txt"

CRAWL_RESULT = (
    "pages array<struct<url:string,title:string,content:string>>, source_method string, "
    "progress struct<pages_fetched:int,pages_total:int>"
)


def ending(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"[^/.](\.[^./]*)$", 1))


def route(content_type: Column, filename: Column) -> Column:
    """How a file turns into text: plain, pdf, office or unsupported."""
    end = ending(filename)
    return (
        F.when(content_type.isin("text/plain", "text/markdown") | end.isin(*TEXT_ENDINGS), "plain")
        .when((content_type == "application/pdf") | (end == ".pdf"), "pdf")
        .when(content_type.isin(*SUPPORTED_TYPES) | end.isin(*OFFICE_ENDINGS), "office")
        .otherwise("unsupported")
    )


def decode_text(content: Column) -> Column:
    """UTF-8 bytes to text, dropping bytes that are not valid; replacement characters of the text itself stay."""
    mark, aside = F.lit("�"), F.lit("﷐")
    text = content.cast("string")
    repaired = F.replace(F.make_valid_utf8(F.replace(text, mark, aside)), mark, F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(repaired, aside, mark))


def check_uploads(rows: DataFrame, max_bytes: int = params.UPLOAD_MAX_BYTES) -> DataFrame:
    """Add ``error_message`` to ``(content_type, size, text)`` rows; accepted ones have none."""
    kind = F.col("content_type")
    return rows.withColumn(
        "error_message",
        F.when(~F.coalesce(kind.isin(*SUPPORTED_TYPES), F.lit(False)), F.concat(F.lit("Unsupported file type: "), F.coalesce(kind, F.lit(""))))
        .when(F.col("size") > max_bytes, F.lit(f"File too large. Maximum size: {max_bytes // (1024 * 1024)}MB"))
        .when(is_blank(F.col("text")), F.lit("Could not extract any text from the file.")),
    )


def check_pasted(rows: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """Pasted texts: plain or Markdown only, not blank, in a known language, with a default name."""
    kind = F.col("content_type")
    return rows.withColumn(
        "filename", F.coalesce(F.nullif("filename", F.lit("")), F.lit(PASTE_NAME))
    ).withColumn(
        "error_message",
        F.when(~F.coalesce(kind.isin(*PASTE_TYPES), F.lit(False)), F.concat(F.lit("Unsupported content type for text paste: "), F.coalesce(kind, F.lit(""))))
        .when(is_blank(F.col("text")), F.lit("Content cannot be empty."))
        .when(~F.coalesce(F.col("language").isin(*languages), F.lit(False)), F.concat(F.lit("Unknown language: "), F.coalesce("language", F.lit("")))),
    )


def read_files(spark, folder: str, max_bytes: int = params.UPLOAD_MAX_BYTES) -> DataFrame:
    """Text files of a folder as ``(path, size, route, text)``; other kinds come without text."""
    files = spark.read.format("binaryFile").load(folder)
    kind = route(F.lit(""), F.col("path"))
    return files.select(
        "path",
        F.col("length").alias("size"),
        kind.alias("route"),
        F.when((kind == "plain") & (F.col("length") <= max_bytes), decode_text(F.col("content"))).alias("text"),
    )


def crawl_pages(results: DataFrame, result: Column) -> DataFrame:
    """Crawl results in JSON form -> one row per page."""
    keep = [c for c in results.columns]
    parsed = results.select(*keep, F.from_json(result, CRAWL_RESULT).alias("_r"))
    return parsed.select(*keep, F.posexplode("_r.pages").alias("pos", "_p")).select(
        *keep, "pos", "_p.url", "_p.title", "_p.content"
    )


def page_projection(pages: DataFrame, *keys: str) -> DataFrame:
    return pages.select(*keys, "url", "title", "content", F.length("content").alias("content_length"))


def is_safe_name(name: Column) -> Column:
    return (name != "") & ~name.rlike(r"[/\\]|\.\.")


def capped_text(text: Column, limit: int = params.ATTACHMENT_MAX_CHARS) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(params.ATTACHMENT_WARNING))
    ).otherwise(text)
