"""Hard negatives against a plain search over all pairs."""

import math

import numpy as np
import pyarrow as pa
import pytest

from docweir.llm import negatives


def plain(rows, positives=5, negatives=10):
    """rows: (vec_id, vector, label); every row with an id divisible by 100 is an anchor."""
    fine = [(i, [math.floor(256 * x) if abs(x) < 1e15 else 256 * int(x) for x in v], y) for i, v, y in rows if v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (anchor, a, label) in enumerate(fine):
        if anchor is None or anchor % 100:
            continue
        scored = [(-max(-(2**56), min(2**56, sum(x * y for x, y in zip(a, c, strict=True)))), i is None, i or 0, y == label, i) for n, (i, c, y) in enumerate(fine) if n != at and len(c) == len(a)]
        scored.sort(key=lambda s: s[:3])
        for s in [s for s in scored if s[3]][:positives]:
            band = [c for c in scored if not c[3] and -30 * s[0] <= -100 * c[0] <= -90 * s[0]][:negatives]
            out += [(anchor, s[4], rank, c[4], -s[0], -c[0]) for rank, c in enumerate(band, 1)]
    return sorted(out, key=str)


def got(table, **options):
    vectors = negatives.usable(table)
    return sorted((tuple(r) for r in negatives.mine(vectors, vectors.filter("vec_id % 100 = 0"), **options).collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label int, row string, part int, score int, rank int")


@pytest.mark.parametrize("batch", [1 << 15, 3])
def test_tables(spark, sf, batch):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = got(table(spark, rows).repartition(3), batch_anchors=batch)
    assert found and found == plain(rows)


def test_edges(spark):
    rows = [
        (0, [1.0, 0.0], 1), (100, [0.5, 0.5], 2), (100, [0.5, 0.5], 2), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (2, [0.5, 0.0], 2), (3, None, 1), (4, [0.3, 0.1], None),
        (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [None, 1.0], 1), (200, [], 1), (8, [], 1), (9, [], 2), (None, [0.5, 0.0], 2), (None, [0.9, 0.0], 1),
        (300, [0.0, 0.0], 1), (400, [1.0, 2.0, 3.0], 1), (10, [1.0, 2.0, 3.5], 1), (11, [0.5, 0.5, 1.0], 3), (12, [0.4, 0.1], 3), (13, [-1.0, 0.1], 3), (500, [-0.2, -0.7], 3), (14, [0.0, -0.4], 4),
    ]
    want = plain(rows)
    assert want and got(table(spark, rows)) == want
    assert got(table(spark, rows[:1])) == [] and got(table(spark, rows).limit(0)) == []


def test_large_components(spark):
    rows = [(0, [3e7, 1.5], 1), (1, [4e7, 2.25], 1), (2, [2e7, 1.0], 2), (3, [1e7 + 0.125, 3.0], 2), (4, [1e300, 1.0], 1), (5, [5e299, 1.0], 2), (100, [2.0, 1e200], 3), (6, [1.0, 1e-200], 3)]
    assert got(table(spark, rows)) == plain(rows)


def test_bounded_walk_ends_early():
    """Two far clusters: a walk over its own cluster never scores the other one, and finds what a full walk finds."""
    draw = np.random.default_rng(5)
    centres = np.array([[1.0, 0, 0, 0], [0, 1.0, 0, 0]])
    x = centres[np.arange(20_000) % 2] + draw.normal(0, 0.02, (20_000, 4))
    rows = pa.table({"row": np.arange(20_000), "vec_id": np.arange(20_000), "label": np.zeros(20_000, dtype=np.int64), "v": list(x)})
    all_rows = negatives.rows_by_length(rows)[4]
    anchors = all_rows.take(np.arange(0, 40, 2))
    walk = negatives.Walk(anchors, 5, True, np.full((20, 1), -negatives.LARGEST), np.full((20, 1), negatives.LARGEST))
    seen, original = [], negatives.products
    negatives.products = lambda a, b: (seen.append(len(b.row)), original(a, b))[1]
    try:
        walk.block(all_rows)
    finally:
        negatives.products = original
    assert sum(seen) < 15_000
    scores = original(anchors, all_rows)
    scores[np.arange(20), np.arange(0, 40, 2)] = negatives.NONE
    assert (np.sort(scores, axis=1)[:, ::-1][:, :5] == walk.score[:, 0]).all()
