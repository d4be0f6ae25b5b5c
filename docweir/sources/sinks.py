"""Writing postings, deleting documents, list projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir.operators import index


def write_postings(chunks: DataFrame, folder: str, analyzers=None, mode: str = "append") -> None:
    """Postings partitioned by language and ordered by lexeme, so term lookups skip row groups."""
    rows = index.postings(chunks, analyzers)
    # the writer needs its partition column in order; one sort serves both
    rows.sortWithinPartitions("language", "lexeme").write.mode(mode).partitionBy("language").parquet(f"{folder}/postings")


def cascade_delete(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of any child table without those of deleted documents."""
    return rows.join(deleted.select("document_id"), "document_id", "left_anti")


def result_json(rows: DataFrame, columns: list[str], verbose: bool) -> Column:
    """Crawl result in JSON form; the short form leaves the request and the policy report out."""
    kept = [c for c in columns if verbose or c not in ("request", "ethics")]
    return F.to_json(F.struct(*kept))


def document_list(documents: DataFrame) -> DataFrame:
    """Documents without their text and meta columns."""
    return documents.drop("raw_text", "meta")


def job_list(jobs: DataFrame) -> DataFrame:
    """Crawl jobs that name a site or a repository, without their raw results."""
    return jobs.where(F.col("url").isNotNull() | F.col("github_repo").isNotNull()).drop("result")
