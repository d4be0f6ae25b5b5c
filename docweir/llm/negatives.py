"""Hard negatives by exact inner products, on candidate lists that clusters of anchors share.

Anchors are clustered by direction. In a block of candidates each cluster sorts all of them
once by an angular upper bound: with theta_c the angle between candidate and centroid and theta_b
the widest angle of a member, no member of norm |a| scores above |a| |c| cos(max(0, theta_c -
theta_b)). All members walk that list together; one leaves as soon as the bound of what is
left falls below the worst score it still needs, which certifies its result. What a task has
found in one block raises what the next block must reach.

The anchors are a stated query set that goes over all rows in blocks: batches of at most
BATCH_ANCHORS anchors are broadcast, one after the other, and every batch scans the stored
vectors twice, for positives and then for negatives. Neither vectors nor
candidate lists are shuffled; a task brings at most its own best rows per anchor.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweir.llm.common import numbered, stored

SCALE = 256
#: Anchors of one broadcast, anchors that centroids are fitted on (they change the speed alone) and anchors of one shared list.
BATCH_ANCHORS = 1 << 15
FITTED_ANCHORS = 4096
LIST_ANCHORS = 64
BLOCK_ROWS = 1 << 13
STRIDE = 1024
#: Scores beyond this are returned as this; up to it all band products fit a long.
LARGEST = 1 << 56
#: Below this norm of both sides a sum of products is exact in double precision.
EXACT_NORM = float(1 << 26)
NONE = np.iinfo(np.int64).min
FOUND = "anchor_row long, band int, row long, vec_id long, score long"


def usable(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str | Column = "label") -> DataFrame:
    """Stored rows with a label and a vector of finite components: row, vec_id, label, v."""
    values = F.col(vector).cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = (F.col(label) if isinstance(label, str) else label).cast("long")
    rows = vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), own.alias("label"), values.alias("v"))
    return numbered(rows.filter("label IS NOT NULL"))


@dataclass
class Rows:
    """Vectors of one length, with integers for components, as doubles where those are exact."""

    row: np.ndarray
    vec_id: np.ndarray
    unnamed: np.ndarray
    label: np.ndarray
    x: np.ndarray
    norm: np.ndarray

    def take(self, at: np.ndarray) -> Rows:
        return Rows(*(getattr(self, f)[at] for f in self.__dataclass_fields__))


def _scaled(x: np.ndarray) -> np.ndarray:
    return np.floor(x * SCALE)


def _integers(x: np.ndarray) -> np.ndarray:
    """The scaled components as Python integers; large doubles are whole numbers already."""
    out = np.empty(x.shape, dtype=object)
    out.flat = [math.floor(c * SCALE) if abs(c) < 2.0**60 else int(c) * SCALE for c in x.flat]
    return out


def rows_by_length(table: pa.Table) -> dict[int, Rows]:
    """The rows of a table of ``usable``, by vector length."""
    vectors = table["v"].combine_chunks()
    vectors = vectors if isinstance(vectors, pa.ListArray) else vectors.chunk(0)
    sizes = np.diff(vectors.offsets.to_numpy())
    values, starts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1]
    ids = table["vec_id"].combine_chunks()
    row, label = table["row"].to_numpy(), table["label"].to_numpy()
    unnamed, named = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(np.iinfo(np.int64).max).to_numpy()
    out = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        x = values[starts[at][:, None] + np.arange(d)] if d else np.zeros((len(at), 0))
        with np.errstate(over="ignore"):
            norm = np.sqrt((_scaled(x) ** 2).sum(axis=1))
        out[d] = Rows(row[at], named[at], unnamed[at], label[at], x, norm)
    return out


def products(a: Rows, b: Rows) -> np.ndarray:
    """Integer inner products, exact at any size, held within LARGEST."""
    if len(a.norm) and len(b.norm) and max(a.norm.max(), b.norm.max()) >= EXACT_NORM:
        exact = _integers(a.x) @ _integers(b.x).T if a.x.shape[1] else np.zeros((len(a.norm), len(b.norm)), dtype=object)
        return np.clip(exact, -LARGEST, LARGEST).astype(np.int64)
    return (_scaled(a.x) @ _scaled(b.x).T).astype(np.int64)


def _directions(rows: Rows) -> np.ndarray:
    top = np.abs(rows.x).max(axis=1, initial=0.0)[:, None]
    x = np.floor(rows.x * SCALE) if not len(top) or top.max() < 1e150 else rows.x / np.where(top > 0, top, 1)
    norm = np.sqrt((x**2).sum(axis=1))[:, None]
    return x / np.where(norm > 0, norm, 1)


def clusters(rows: Rows, size: int = LIST_ANCHORS, fitted: int = FITTED_ANCHORS, rounds: int = 8) -> list[np.ndarray]:
    """Positions of the anchors of each cluster, ``size`` of them at most, by spherical k-means."""
    unit = _directions(rows)
    sample = unit[:: max(1, math.ceil(len(unit) / fitted))]
    centres = sample[:: max(1, size)].copy()
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norm = np.sqrt((sums**2).sum(axis=1))[:, None]
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    near = (unit @ centres.T).argmax(axis=1)
    groups = (np.flatnonzero(near == c) for c in range(len(centres)))
    return [g[i : i + size] for g in groups for i in range(0, len(g), size)]


class Walk:
    """One cluster's anchors: their bands of wanted scores and the best rows found so far in each band.

    ``low`` and ``high`` bound the scores of each anchor's bands; ``same`` asks for rows of
    the anchor's own label, else for those of other labels.
    """

    def __init__(self, anchors: Rows, k: int, same: bool, low: np.ndarray, high: np.ndarray) -> None:
        self.anchors, self.k, self.same, self.low, self.high = anchors, k, same, low, high
        unit = _directions(anchors)
        centre = unit.sum(axis=0)
        length = math.sqrt(float((centre**2).sum()))
        self.centre = centre / length if length > 0 else centre
        # without a direction in common nothing is known of the angles
        self.widest = float(np.arccos(np.clip(unit @ self.centre, -1, 1)).max()) if length > 0 else math.pi
        shape = (len(anchors.norm), low.shape[1], k)
        self.score, self.vec_id, self.row = np.full(shape, NONE), np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64)
        self.unnamed = np.zeros(shape, dtype=bool)

    def needed(self) -> np.ndarray:
        """The least score of use to each band; a band that nothing can enter needs more than any score."""
        worst = np.maximum(self.score[:, :, -1], self.low)
        return np.where(self.high < self.low, np.iinfo(np.int64).max, worst)

    def block(self, candidates: Rows) -> None:
        turned = np.arccos(np.clip(_directions(candidates) @ self.centre, -1, 1))
        bound = candidates.norm * np.cos(np.maximum(0, turned - self.widest))
        bound = np.where(np.isfinite(bound), bound, np.inf)
        order = np.argsort(-bound, kind="stable")
        slack = float(candidates.norm.max(initial=0.0)) * 1e-7
        for at in range(0, len(order), STRIDE):
            needed = self.needed()
            with np.errstate(over="ignore", invalid="ignore"):
                reach = self.anchors.norm * (bound[order[at]] + slack)
            # clipped scores stay below LARGEST
            reach = np.where(np.isfinite(reach), np.minimum(reach, 2.0 * LARGEST), 2.0 * LARGEST)
            walking = np.flatnonzero((reach[:, None] + 1 >= needed).any(axis=1))
            if not len(walking):
                return
            part = candidates.take(order[at : at + STRIDE])
            members = self.anchors.take(walking)
            scores = products(members, part)
            allowed = ((members.label[:, None] == part.label) == self.same) & (members.row[:, None] != part.row)
            allowed &= scores >= needed[walking].min(axis=1)[:, None]
            for i in np.flatnonzero(allowed.any(axis=1)).tolist():
                hits = np.flatnonzero(allowed[i])
                for band in range(self.low.shape[1]):
                    own = scores[i, hits]
                    fit = hits[(own >= needed[walking[i], band]) & (own <= self.high[walking[i], band])]
                    if len(fit):
                        self._merge(walking[i], band, part.take(fit), scores[i, fit])

    def _merge(self, i: int, band: int, part: Rows, scores: np.ndarray) -> None:
        held = [np.concatenate((getattr(self, name)[i, band], new)) for name, new in (("score", scores), ("unnamed", part.unnamed), ("vec_id", part.vec_id), ("row", part.row))]
        # minus the smallest integer is itself, so free places are put behind by hand
        best = np.lexsort((held[3], held[2], held[1], -held[0], held[0] == NONE))[: self.k]
        for name, values in zip(("score", "unnamed", "vec_id", "row"), held, strict=True):
            getattr(self, name)[i, band] = values[best]

    def found(self) -> pa.RecordBatch:
        i, band, place = np.nonzero(self.score != NONE)
        at = (i, band, place)
        ids = pa.array(self.vec_id[at], mask=self.unnamed[at])
        columns = [pa.array(self.anchors.row[i]), pa.array(band.astype(np.int32)), pa.array(self.row[at]), ids, pa.array(self.score[at])]
        return pa.RecordBatch.from_arrays(columns, names=["anchor_row", "band", "row", "vec_id", "score"])


def _scan(vectors: DataFrame, make: Callable[[], dict[int, list[Walk]]]) -> DataFrame:
    """Every task's best rows per anchor and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks, held, n = make(), [], 0

        def walk() -> None:
            for d, rows in rows_by_length(pa.Table.from_batches(held)).items():
                for one in walks.get(d, []):
                    one.block(rows)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                walk()
                held, n = [], 0
        if n:
            walk()
        for one in (w for group in walks.values() for w in group):
            yield one.found()

    return vectors.select("row", "vec_id", "label", "v").mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_row", "band").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return stored(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))


def _batch(vectors: DataFrame, anchors: DataFrame, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    context = vectors.sparkSession.sparkContext
    groups = rows_by_length(anchors.select("row", "vec_id", "label", "v").toArrow())
    packs = {d: [rows.take(at) for at in clusters(rows)] for d, rows in groups.items()}
    sent = context.broadcast(packs)

    def near() -> dict[int, list[Walk]]:
        return {d: [Walk(a, positives, True, np.full((len(a.row), 1), -LARGEST), np.full((len(a.row), 1), LARGEST)) for a in p] for d, p in sent.value.items()}

    best = _best(_scan(vectors, near), positives)
    # at most ``positives`` scores for each anchor of the batch
    scores: dict[int, list[int]] = {}
    for r in best.select("anchor_row", "rank", "score").orderBy("anchor_row", "rank").toArrow().to_pylist():
        scores.setdefault(r["anchor_row"], []).append(r["score"])
    bands = context.broadcast(scores)

    def far() -> dict[int, list[Walk]]:
        out = {}
        for d, p in sent.value.items():
            out[d] = []
            for a in p:
                low, high = np.full((len(a.row), positives), LARGEST), np.full((len(a.row), positives), -LARGEST)
                for i, row in enumerate(a.row.tolist()):
                    for j, s in enumerate(bands.value.get(row, [])):
                        low[i, j], high[i, j] = -(-least * s // 100), most * s // 100
                out[d].append(Walk(a, negatives, False, low, high))
        return out

    worst = _best(_scan(vectors, far), negatives)
    pairs = best.select("anchor_row", (F.col("rank") - 1).alias("band"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = worst.select("anchor_row", "band", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["anchor_row", "band"])
    named = anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    done = stored(found.join(named, "anchor_row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    sent.destroy()
    bands.destroy()
    return done


def mine(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, batch_anchors: int = BATCH_ANCHORS
) -> DataFrame:
    """For each anchor and each of its best ``positives`` rows of the same label, the best rows of other labels in a band below.

    ``vectors`` comes from ``usable`` and ``anchors`` is a part of it. Components count as the
    integers floor(256 x) and scores are their exact inner products. A negative scores between ``least`` and
    ``most`` percent of the positive; so a positive below zero has none. Higher scores come first,
    ties by smaller vec_id, null ids last, then by row. Rows that repeat an id are rows of their own:
    an anchor leaves out its own row alone. Vectors of another length than the anchor's are
    no candidates. Scores beyond LARGEST count as LARGEST. No anchors or no vectors give no rows.
    """
    n = anchors.count()
    parts = max(1, math.ceil(n / batch_anchors))
    # a hash deals unevenly; twice the number keeps every batch below the bound
    parts = parts if parts == 1 else 2 * parts
    dealt = anchors.withColumn("part", F.pmod(F.xxhash64(F.col("row"), F.lit("anchors")), F.lit(parts)))
    out = None
    for part in range(parts):
        one = _batch(vectors, dealt.filter(F.col("part") == part), positives, negatives, least, most)
        out = one if out is None else out.unionByName(one)
    return out
