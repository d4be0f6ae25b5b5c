"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents; so a stage first deletes what the one before has
stored on its way. All but the last return the columns of ``documents`` as they came.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweir.llm import curriculum, exact_merge, hyperdim, relations, tournament
from docweir.llm.common import delete_stored, numbered, owned
from docweir.session import cut_lineage, tune

ROW = "stage_row"
#: A text of at least so many characters whose cosine with every language is below the floor is in none of them.
TOLD_CHARS = 100
LEAST_SCORE = 0.05

_stage_tables: list[str] = []


def _stage(stage: Callable[..., DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes the tables of the stage before, whose result has been written; no other tables."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete_stored(tune(spark), _stage_tables)
        with owned(_stage_tables):
            return stage(spark, docs, sf_dir)

    return run


def _rows(docs: DataFrame) -> DataFrame:
    """The documents as a stored table in which each row has a number."""
    return numbered(docs, ROW)


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told: null texts, texts without letters, and texts like no learned language."""
    names, table = hyperdim.prototypes(docs)
    # where no label teaches a language, one prototype for all still tells texts without letters
    model = (names, table) if names else (["any"], np.zeros((1, hyperdim.DIMS), dtype=np.float32))
    guessed = hyperdim.identify(docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns}), model, text="in_text")
    told = F.col("lang_pred") != hyperdim.UNKNOWN
    if names:
        told = told & ((F.col("score") >= LEAST_SCORE) | (F.length("in_text") < TOLD_CHARS))
    return guessed.filter(told).select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text: the one of largest id."""
    rows = _rows(docs)
    kept = exact_merge.exact_groups(rows, doc_id="doc_id", row=ROW).filter("kept").select(F.col("row").alias(ROW))
    return rows.join(kept, ROW, "left_semi").select(*docs.columns)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of linked shingle sets: the one of smallest id, then of smallest row.

    Sets and links are those of the operator's contract: three words, 90 percent.
    """
    rows = _rows(docs)
    found = relations.jaccard_components(rows, row=ROW)  # SHINGLE and PERCENT of the operator
    # a component's label may be an id that repeats; its own number tells components apart
    first = found.groupBy("component").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias(ROW)).select(ROW)
    return rows.join(first, ROW, "left_semi").select(*docs.columns)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it, range-sorted by training position.

    A last pass counts where it takes at least half of the document; so texts stay whole.
    Documents without words are taken by no mix and go.
    """
    rows = _rows(docs)
    plan = curriculum.passes(curriculum.mix(rows, row=ROW)).select(F.col("row").alias(ROW), F.col("pass").alias("stage_pass"), F.col("position").alias("stage_position"))
    order = ["stage_position", ROW, "stage_pass"]
    return rows.join(plan, ROW).repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mixed documents into sequences; one row per piece."""
    return tournament.pack(docs, special=True)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", packing),
]

#: Stages on learned prototypes, shingle components and token ids are beyond SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
