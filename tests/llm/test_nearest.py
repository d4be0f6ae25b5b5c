"""Nearest neighbours against exact search."""

import numpy as np
import pytest

from docweir.llm import collisions


def exact(rows, k):
    fine = [(i, np.array(v, dtype=float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for at, (i, v) in enumerate(fine):
        if i is not None and i % 20 == 0:
            scores = [(-float((v * w).sum()), j is None, j) for n, (j, w) in enumerate(fine) if n != at and len(w) == len(v)]
            out[i] = [(j, -s) for s, _, j in sorted(scores)[:k]]
    return out


def test_recall_and_scores(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = exact([(r.vec_id, r.embedding) for r in table.collect()], 20)
    vectors = collisions.usable(table)
    got = collisions.nearest(vectors, vectors.filter("vec_id % 20 = 0"), block_rows=200, batch_queries=4).collect()
    hits = total = 0
    for query, best in want.items():
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == query)
        assert [m[0] for m in mine] == list(range(1, len(best) + 1)) and [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)
        hits += len({m[1] for m in mine} & {b[0] for b in best})
        total += len(best)
    assert hits / total >= 0.9


def test_edges(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [3.0, 4.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (40, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
        (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, []), (None, [0.5, 0.5]), (9, [-9.0, 0.0]), (60, [1.0, 2.0, 3.0]),
    ]
    table = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, row string, block int")
    vectors = collisions.usable(table)
    got = {}
    for r in collisions.nearest(vectors, vectors.filter("vec_id % 20 = 0")).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {k: v for k, v in exact(rows, 20).items() if v}
    none = vectors.limit(0)
    assert collisions.nearest(none, none).collect() == []


@pytest.mark.parametrize("n", [2_000, 10_000, 50_000])
def test_recall_at_three_sizes(spark, n):
    """Near-random directions with norms that differ: the hardest case for any index."""
    draw = np.random.default_rng(n)
    x = draw.standard_normal((n, 64)) + 0.4 * draw.standard_normal((20, 64))[draw.integers(0, 20, n)]
    x = (x / np.linalg.norm(x, axis=1)[:, None] * draw.uniform(0.7, 1.0, (n, 1))).astype(np.float32)
    table = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    vectors = collisions.usable(table)
    queries = range(0, n, n // 50)
    got = {}
    for r in collisions.nearest(vectors, vectors.filter(f"vec_id % {n // 50} = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    scores = x[::n // 50].astype(float) @ x.T.astype(float)
    hits = 0
    for at, query in enumerate(queries):
        scores[at, query] = -np.inf
        hits += len(got[query] & set(np.argsort(-scores[at])[:20].tolist()))
        assert len(got[query]) == 20
    assert hits / (20 * len(queries)) >= 0.9


def test_lines_are_orthogonal():
    for d in (2, 5, 65, 300):
        axes = collisions.lines(d, 1)
        n = min(d, axes.shape[1])
        assert np.allclose(axes[:, :n].T @ axes[:, :n], d * np.eye(n)) and collisions.LEAST_LINES <= axes.shape[1] <= collisions.MOST_LINES


def test_extreme_norms(spark):
    """Squares that overflow or vanish hold no search up."""
    rows = [(0, [1e200, 1.0, 2.0]), (20, [1e-170, 2e-170, 0.0]), (1, [3.0, 4.0, 5.0]), (2, [1e-300, 0.0, 1e-300]), (40, [1.5, -1.0, 0.25]), (3, [-1e200, 1e200, 0.0])]
    vectors = collisions.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in collisions.nearest(vectors, vectors.filter("vec_id % 20 = 0")).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    with np.errstate(over="ignore"):
        assert got == exact(rows, 20)
