"""Nearest neighbours by inner product with collision-counting hashing.

A task takes its vectors in blocks. In a block each random line, one of orthogonal ones as far as the
dimensions reach, keeps the projections as one sorted array. A query opens a window around its
own projection on every line; virtual rehashing widens all windows by the same factor, and a
vector that falls into enough of them is verified by its exact inner product. Widening ends
when enough vectors of the block collide that often.

The queries are a stated set that goes over all rows in blocks: batches of at most BATCH_QUERIES
of them are broadcast, one after the other. A block's arrays are built once for a batch;
vectors are neither copied nor shuffled, and a task brings its own best k rows per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweir.llm.common import numbered, stored

#: Lines: one for each dimension, within these bounds.
LEAST_LINES, MOST_LINES = 64, 256
#: Share of the lines on which a vector must collide with the query.
THRESHOLD = 0.8
#: First half width of a window, in standard deviations of a line, and the factor of each rehash.
FIRST_WIDTH = 0.5
WIDEN = 1.2
#: Colliding vectors of a block at which widening ends, beyond k: a share of the block, and at least so many.
VERIFIED = 0.06
LEAST_VERIFIED = 256
#: Queries of a block that tell the others below which width no window is enough.
SCOUTS = 16
BLOCK_ROWS = 1 << 13
BATCH_QUERIES = 1 << 15
FOUND_SCHEMA = "query_row long, row long, vec_id long, score double"


def usable(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """Stored rows whose vector is neither null nor zero and has only finite components, as doubles, with the logarithm of its norm."""
    values = F.col(vector).cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    rows = vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), values.alias("v"))
    peak = F.array_max(F.transform("v", F.abs))
    # the sum of squares over the largest component stays within 1 and the length
    rows = rows.withColumn("peak", peak).withColumn("log_norm", F.log2("peak") + F.log2(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.col("peak")) * (x / F.col("peak")))) / 2)
    return numbered(rows.drop("peak"))


@dataclass
class Rows:
    """Vectors of one length: as they are, their directions, and their norms over the largest of all."""

    row: np.ndarray
    vec_id: np.ndarray
    unnamed: np.ndarray
    x: np.ndarray
    unit: np.ndarray
    ratio: np.ndarray


def rows_by_length(table: pa.Table, top: float) -> dict[int, Rows]:
    vectors = table["v"].combine_chunks()
    vectors = vectors if isinstance(vectors, pa.ListArray) else vectors.chunk(0)
    sizes, starts = np.diff(vectors.offsets.to_numpy()), vectors.offsets.to_numpy()[:-1]
    values = vectors.values.to_numpy(zero_copy_only=False)
    ids = table["vec_id"].combine_chunks()
    named, unnamed = ids.fill_null(np.iinfo(np.int64).max).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
    row, ratio = table["row"].to_numpy(), np.exp2(np.minimum(table["log_norm"].to_numpy() - top, 0))
    out = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        x = values[starts[at][:, None] + np.arange(d)]
        unit = x / np.abs(x).max(axis=1)[:, None]
        unit /= np.sqrt((unit**2).sum(axis=1))[:, None]
        out[d] = Rows(row[at], named[at], unnamed[at], x, unit, ratio[at])
    return out


def lines(d: int, seed: int) -> np.ndarray:
    """Random lines through ``d`` dimensions, orthogonal in groups of ``d``; a column is one line, on which a direction spreads by 1."""
    n, draw = min(MOST_LINES, max(LEAST_LINES, d)), np.random.default_rng(seed)
    groups = [np.linalg.qr(draw.standard_normal((d, min(d, n))))[0] for _ in range(-(-n // d))]
    return np.concatenate(groups, axis=1)[:, :n] * math.sqrt(d)


class Block:
    """The sorted projections of a block of vectors."""

    def __init__(self, rows: Rows, axes: np.ndarray) -> None:
        self.rows = rows
        # one more coordinate makes all norms equal, so that the nearest has the largest inner product
        rest = np.sqrt(np.maximum(0, 1 - rows.ratio**2))
        projections = ((rows.unit * rows.ratio[:, None]) @ axes[:-1] + rest[:, None] * axes[-1]).T
        order = np.argsort(projections, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projections, order, axis=1)
        self.rank = np.empty(order.shape, dtype=np.uint16)
        np.put_along_axis(self.rank, order, np.arange(order.shape[1], dtype=np.uint16)[None], axis=1)
        self.start = FIRST_WIDTH

    def colliding(self, asked: np.ndarray, enough: int) -> list[np.ndarray]:
        """Per query (a row of projections) the vectors that collide on THRESHOLD of the lines, once ``enough`` of them do."""
        m, n = self.sorted.shape
        need, kind = math.ceil(THRESHOLD * m), np.uint8 if m < 256 else np.uint16
        open_, width, out = np.arange(len(asked)), self.start, [np.zeros(0, dtype=np.int64)] * len(asked)
        while len(open_):
            low = np.stack([np.searchsorted(self.sorted[j], asked[open_, j] - width, "left") for j in range(m)], axis=1)
            high = np.stack([np.searchsorted(self.sorted[j], asked[open_, j] + width, "right") for j in range(m)], axis=1)
            left = []
            for i, (query, a, b) in enumerate(zip(open_, low, high, strict=True)):
                # places from the window's start on; those before it wrap around to large numbers
                inside = (self.rank - a.astype(np.uint16)[:, None]) < (b - a).astype(np.uint16)[:, None]
                hits = np.flatnonzero(np.add.reduce(inside.view(np.uint8), axis=0, dtype=kind) >= need)
                if len(hits) >= enough or (b - a).min() == n:
                    out[query] = hits
                else:
                    left.append(i)
            open_, width = open_[left], width * WIDEN
        self.last = width / WIDEN
        return out


class Best:
    """The best ``k`` rows found so far for each query."""

    def __init__(self, queries: Rows, k: int) -> None:
        self.queries, self.k = queries, k
        shape = (len(queries.row), k)
        self.score, self.vec_id, self.row = np.full(shape, -np.inf), np.zeros(shape, dtype=np.int64), np.full(shape, -1)
        self.unnamed = np.ones(shape, dtype=bool)

    def search(self, rows: Rows, seed: int) -> None:
        axes = lines(rows.x.shape[1] + 1, seed)
        block, asked = Block(rows, axes), self.queries.unit @ axes[:-1]
        enough = min(len(rows.row), math.ceil(VERIFIED * len(rows.row)) + LEAST_VERIFIED + self.k + 1)
        # the first queries find out where windows begin to be enough
        scouts = asked[:SCOUTS]
        hits, reached = [], []
        for one in scouts:
            hits += block.colliding(one[None], enough)
            reached.append(block.last)
        block.start = min(reached, default=FIRST_WIDTH)
        hits += block.colliding(asked[SCOUTS:], enough)
        for i, found in enumerate(hits):
            self._verify(i, rows, found[rows.row[found] != self.queries.row[i]])

    def _verify(self, i: int, rows: Rows, hits: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            score = (rows.x[hits] * self.queries.x[i]).sum(axis=1)
        score = np.where(np.isnan(score), -np.inf, score)
        # all ties with the worst stay, so that ids can decide
        fit = np.flatnonzero(score >= self.score[i, -1])
        held = [np.concatenate((getattr(self, name)[i], new)) for name, new in (("score", score[fit]), ("unnamed", rows.unnamed[hits[fit]]), ("vec_id", rows.vec_id[hits[fit]]), ("row", rows.row[hits[fit]]))]
        best = np.lexsort((held[3], held[2], held[1], -held[0], held[3] < 0))[: self.k]
        for name, values in zip(("score", "unnamed", "vec_id", "row"), held, strict=True):
            getattr(self, name)[i] = values[best]

    def found(self) -> pa.RecordBatch:
        at = np.nonzero(self.row >= 0)
        ids = pa.array(self.vec_id[at], mask=self.unnamed[at])
        return pa.RecordBatch.from_arrays([pa.array(self.queries.row[at[0]]), pa.array(self.row[at]), ids, pa.array(self.score[at])], names=["query_row", "row", "vec_id", "score"])


def _batch(vectors: DataFrame, queries: DataFrame, top: float, k: int, block_rows: int, seed: int) -> DataFrame:
    columns = ("row", "vec_id", "v", "log_norm")
    asked = queries.select(*columns).orderBy("row").toArrow()
    sent = vectors.sparkSession.sparkContext.broadcast(rows_by_length(asked, top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, n = {d: Best(rows, k) for d, rows in sent.value.items()}, [], 0

        def search() -> None:
            for d, rows in rows_by_length(pa.Table.from_batches(held), top).items():
                if d in best:
                    best[d].search(rows, seed)

        for batch in batches:
            for part in (batch.slice(at, block_rows) for at in range(0, batch.num_rows, block_rows)):
                if n + part.num_rows > block_rows:
                    search()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            search()
        for one in best.values():
            yield one.found()

    found = vectors.select(*columns).mapInArrow(run, FOUND_SCHEMA)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    done = stored(ranked.join(named, "query_row").select("query_id", "rank", "vec_id", "score"))
    sent.destroy()
    return done


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS, batch_queries: int = BATCH_QUERIES, seed: int = 11) -> DataFrame:
    """Each query's ``k`` best rows of ``vectors`` found, its own row left out, ties to the smaller id, null ids last.

    ``vectors`` comes from ``usable`` and ``queries`` is a part of it. Every row lies in the
    sorted arrays of its block of at most ``block_rows``. A query row gets every other row where there
    are fewer than ``k``. Vectors of another length are no candidates. Rows that repeat an id are rows of their
    own. A score that overflows to no number counts as minus infinity.
    """
    top = vectors.agg(F.max("log_norm")).first()[0] or 0.0
    n = queries.count()
    parts = max(1, math.ceil(n / batch_queries))
    # a hash deals unevenly; twice the number keeps every batch below the bound
    parts = parts if parts == 1 else 2 * parts
    dealt = queries.withColumn("part", F.pmod(F.xxhash64(F.col("row"), F.lit("queries")), F.lit(parts)))
    out = None
    for part in range(parts):
        one = _batch(vectors, dealt.filter(F.col("part") == part), top, k, min(block_rows, 1 << 15), seed)
        out = one if out is None else out.unionByName(one)
    return out
