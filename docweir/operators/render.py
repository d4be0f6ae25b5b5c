"""Answer sinks: context blocks, Markdown answers, query strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY_ANSWER = "No relevant documentation found."


def _per_query(results: DataFrame) -> DataFrame:
    fields = ["rank", "document_filename", "source_url", "chunk_index", "chunk_content", "document_id", "score"]
    return results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("r"))


def context_block(results: DataFrame) -> DataFrame:
    """Numbered context text of each query's results."""

    def entry(r: Column) -> Column:
        source = F.when(
            F.coalesce(r["source_url"], F.lit("")) != "",
            F.concat(F.lit("Source: "), r["source_url"], F.lit("\n\n")),
        ).otherwise(F.lit(""))
        return F.concat(
            F.lit("["), r["rank"].cast("string"), F.lit("] (source: "), r["document_filename"],
            F.lit(", chunk "), r["chunk_index"].cast("string"), F.lit(")\n"), source, r["chunk_content"],
        )

    return _per_query(results).select("query_id", F.array_join(F.transform("r", entry), "\n\n").alias("context"))


def prompt(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """Question wrapped with its context; questions without results stay as they are."""
    return queries.join(contexts, "query_id", "left").select(
        "query_id",
        F.when(
            F.col("context").isNotNull(),
            F.concat(
                F.lit("<CONTEXT>\n"), "context", F.lit("\n</CONTEXT>\n\n<QUESTION>\n"), "query", F.lit("\n</QUESTION>")
            ),
        ).otherwise(F.col("query")).alias("message"),
    )


def context_chunks(results: DataFrame) -> DataFrame:
    """Results of each query as an array of structs, numbered from one, as messages store them."""
    return _per_query(results).select(
        "query_id",
        F.transform(
            "r",
            lambda r: F.struct(
                r["rank"].alias("index"), r["chunk_content"].alias("content"), r["document_id"].alias("document_id"),
                r["document_filename"].alias("document_filename"), r["chunk_index"].alias("chunk_index"),
                r["score"].alias("score"), r["source_url"].alias("source_url"),
            ),
        ).alias("context"),
    )


def markdown_answer(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Markdown with a front matter of distinct sources and one section per result."""
    name = lambda r: F.coalesce(F.nullif(r["source_url"], F.lit("")), r["document_filename"])
    found = _per_query(results).select(
        "query_id",
        F.array_distinct(F.transform("r", name)).alias("sources"),
        F.transform("r", lambda r: F.concat(F.lit("### Source: "), name(r), F.lit("\n"), r["chunk_content"], F.lit("\n"))).alias("parts"),
    )
    text = F.concat(
        F.lit("---\nsources:\n"),
        F.array_join(F.transform("sources", lambda s: F.concat(F.lit("  - "), s)), "\n"),
        F.lit("\n---\n\n"),
        F.array_join("parts", "\n"),
    )
    empty = F.lit(f"---\nsources: []\n---\n\n{EMPTY_ANSWER}")
    return queries.select("query_id").join(found, "query_id", "left").select(
        "query_id", F.when(F.col("sources").isNull(), empty).otherwise(text).alias("markdown")
    )


def combined_query(language: Column, english: Column, polish: Column, raw: Column) -> Column:
    """Both refined forms in one string, the detected language first; missing forms are the raw query."""
    en, pl = F.coalesce(english, raw), F.coalesce(polish, raw)
    return F.when(language == "polish", F.concat_ws(" ; ", pl, en)).otherwise(F.concat_ws(" ; ", en, pl))


def retrieval_mode(document_ids: Column) -> Column:
    """No list: no retrieval; an empty list: all documents; otherwise the listed ones."""
    return (
        F.when(document_ids.isNull(), "none").when(F.size(document_ids) == 0, "all").otherwise("listed")
    )
