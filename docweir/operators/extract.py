"""Pages -> title, Markdown, robots directives.

One Arrow pass reads a page into its title and content blocks; rendering and
clean-up are expressions over the block array, inside the page's own row, so
extraction never shuffles.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir import params
from docweir.functions import html_runs, markdown

PAGE = "struct<title:string,blocks:array<struct<kind:string,text:string>>,directives:array<string>>"


def read_page(html: Column, css_class: str | None = None, bot: str = params.BOT_NAME) -> Column:
    @F.pandas_udf(PAGE)
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [html_runs.read(p, css_class, bot) for p in pages], columns=["title", "blocks", "directives"]
        )

    return run(html)


def render(blocks: Column) -> Column:
    """Content blocks -> Markdown; list items follow each other without blank lines."""

    def piece(b: Column, i: Column) -> Column:
        kind = b["kind"]
        before = F.coalesce(F.get(blocks, i - 1)["kind"], F.lit(""))
        level = F.regexp_extract(kind, "^h([1-6])$", 1).try_cast("int")
        depth = F.regexp_extract(kind, "^li:([0-9]+)", 1).try_cast("int")
        is_pre = F.startswith(kind, F.lit("pre:"))
        gap = (
            F.when(F.startswith(kind, F.lit("li")) & F.startswith(before, F.lit("li")), "\n")
            .otherwise("\n\n")
        )
        text = (
            F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), b["text"]))
            .when(
                depth.isNotNull(),
                F.concat(
                    F.repeat(F.lit("  "), depth - 1),
                    F.when(F.endswith(kind, F.lit("ol")), "1. ").otherwise("* "),
                    b["text"],
                ),
            )
            .when(is_pre, F.concat(F.lit("```"), F.substr(kind, F.lit(5)), F.lit("\n"), b["text"], F.lit("\n```")))
            .when(kind == "quote", F.concat(F.lit("> "), b["text"]))
            .when(kind == "dt", F.concat(F.lit("**"), b["text"], F.lit("**")))
            .otherwise(b["text"])
        )
        return F.concat(gap, text)

    return F.array_join(F.transform(blocks, piece), "")


def extract_pages(pages: DataFrame, html: str = "html", css_class: str | None = None) -> DataFrame:
    """``pages`` -> the other columns plus ``title``, ``content`` and robots ``directives``.

    Pages without a content element have an empty content.
    """
    keep = [c for c in pages.columns if c != html]
    read = pages.select(*keep, read_page(F.col(html), css_class).alias("_p"))
    content = markdown.strip_jsx(render(F.col("_p.blocks")))
    return read.select(
        *keep,
        F.when(F.col("_p.title") != "", F.col("_p.title")).otherwise(markdown.title(content)).alias("title"),
        content.alias("content"),
        F.col("_p.directives").alias("directives"),
    )


def plain_text(html: Column) -> Column:
    """Visible text by pattern: noise elements, comments and tags cut, plain entities resolved."""
    tags = "nav|header|footer|aside|script|style|noscript|button"
    out = F.regexp_replace(html, rf"(?is)<({tags})\b.*?</({tags})>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    out = F.replace(F.replace(out, F.lit("&amp;"), F.lit("&")), F.lit("&middot;"), F.lit(""))
    return F.trim(F.regexp_replace(out, r"\s+", " "))
