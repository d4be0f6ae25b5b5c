"""Language identification with hyperdimensional profiles.

A letter is a random vector of +1 and -1. A run of three letters binds the first rolled
by two, the second rolled by one and the third as it is; a text bundles the runs in
it. A language's prototype bundles the texts of a bounded sample of its labelled rows,
and a text gets the language whose prototype lies at the smallest angle.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMS = 512
GRAM = 3
SLICES = 64
TRAIN_DOCS = 400
BUNDLE_DOCS = 64
BUNDLE_CHARS = 400_000
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)])


@functools.cache
def _letter(code: int) -> np.ndarray:
    return (np.random.default_rng((7, code)).integers(0, 2, DIMS) * 2 - 1).astype(np.int8)


def letter_runs(text: str | None) -> np.ndarray:
    """The text's letters in lower case as code points, words apart by one 0, with a 0 at both ends; empty without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(_letters()[points], points, 0).astype(np.int64)
    codes = np.concatenate(([0], codes, [0]))
    codes = codes[(codes != 0) | np.concatenate(([True], codes[:-1] != 0))]
    return codes if len(codes) > 2 or codes.any() else codes[:0]


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """One bundled vector per text, divided by its number of runs, and that number."""
    runs = [letter_runs(t) for t in texts]
    counts = np.array([max(0, len(r) - GRAM + 1) for r in runs])
    if not counts.sum():
        return np.zeros((len(texts), DIMS), dtype=np.float32), counts
    grams = np.concatenate([(r[:-2] << 42) | (r[1:-1] << 21) | r[2:] for r in runs])
    different, at = np.unique(grams, return_inverse=True)
    of = np.repeat(np.arange(len(texts)), counts)
    table = np.bincount(of * len(different) + at, minlength=len(texts) * len(different)).reshape(len(texts), -1)
    mask = (1 << 21) - 1
    known = np.unique(np.concatenate([different >> 42, (different >> 21) & mask, different & mask]))
    vectors = np.stack([_letter(int(c)) for c in known])
    first, second, third = (np.searchsorted(known, x) for x in (different >> 42, (different >> 21) & mask, different & mask))
    bound = np.roll(vectors, 2, axis=1)[first] * np.roll(vectors, 1, axis=1)[second] * vectors[third]
    return (table.astype(np.float32) @ bound.astype(np.float32)) / np.maximum(counts, 1)[:, None].astype(np.float32), counts


def _groups(texts: pa.Array) -> Iterator[list[str | None]]:
    """Texts in runs of bounded length."""
    held, size = [], 0
    for text in texts:
        body = text.as_py()
        if held and (len(held) >= BUNDLE_DOCS or size + len(body or "") > BUNDLE_CHARS):
            yield held
            held, size = [], 0
        held.append(body)
        size += len(body or "")
    if held:
        yield held


def held_out(doc_id: Column) -> Column:
    """The fold that training never sees: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Language names and their unit prototypes.

    Learned from at most ``train_docs`` documents per language outside the held-out fold, those
    of smallest id hash; this bound is the sample's only parameter. Of rows that repeat an id, the
    first text in order counts. What reaches the
    driver is DIMS sums per language.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id")).filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    rows = rows.withColumn("draw", F.xxhash64("doc_id"))
    # the draw is decided on ids and labels alone; texts are read for what it keeps
    ranked = rows.select("lang", "draw", F.pmod(F.xxhash64("draw", F.lit("slice")), F.lit(SLICES)).alias("slice"))
    # slices of a language first: one task never sees more of it than SLICES times the sample
    for keys in (["lang", "slice"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("draw"))).filter(F.col("rank") <= train_docs)
    last = ranked.groupBy("lang").agg(F.max("draw").alias("last"))
    # one row per language, of which the model has DIMS numbers each
    sample = rows.join(F.broadcast(last), "lang").filter("draw <= last").groupBy("lang", "draw").agg(F.min("text").alias("text")).select("lang", "text")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for group in _groups(batch.column(1)):
                for vector in bundles(group)[0]:
                    name = next(names)
                    total[name] = total.get(name, 0) + vector.astype(np.float64)
        for name, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMS), pa.array(range(DIMS), pa.int32()), pa.array(vector)], names=["lang", "i", "value"])

    parts = sample.mapInArrow(sums, "lang string, i int, value double").groupBy("lang", "i").agg(F.sum("value").alias("value")).collect()
    names = sorted({r.lang for r in parts})
    table = np.zeros((len(names), DIMS))
    for r in parts:
        table[names.index(r.lang), r.i] = r.value
    norms = np.linalg.norm(table, axis=1, keepdims=True)
    return names, (table / np.where(norms == 0, 1, norms)).astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """All rows and columns, with ``lang_pred`` and ``score`` behind them (or in the place of columns of those names).

    ``score`` is the cosine with the chosen prototype, from 0 to 1. Texts that are null or
    have no letter get ``und`` and 0, as do all when nothing was learned. Ties go to the first
    name in order. Whole texts count, in pieces of bounded size only where many short
    ones share a matrix product.
    """
    names, table = model

    @F.pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            out = []
            for group in _groups(pa.array(series, pa.string(), from_pandas=True)):
                vectors, counts = bundles(group)
                norms = np.linalg.norm(vectors, axis=1)
                if not names:
                    out += [(UNKNOWN, 0.0)] * len(group)
                    continue
                cosine = (vectors @ table.T) / np.where(norms == 0, 1, norms)[:, None]
                best = cosine.argmax(axis=1)
                out += [(names[b], float(min(1.0, max(0.0, c[b])))) if n else (UNKNOWN, 0.0) for b, c, n in zip(best, cosine, counts, strict=True)]
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return docs.withColumn("_guess", guess(F.col(text))).withColumns({"lang_pred": F.col("_guess.lang_pred"), "score": F.col("_guess.score")}).drop("_guess")
