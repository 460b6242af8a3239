"""Nearest neighbours against brute force in double precision."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import ann


def brute(rows, k):
    """rows: (id, vector); {query row: [(rank, id, score)]}"""
    out = []
    for a, (i, q) in enumerate(rows):
        if i % 20:
            continue
        scored = []
        for b, (j, x) in enumerate(rows):
            if a != b:
                s = 0.0
                for t in range(len(q)):
                    s += q[t] * x[t]
                scored.append((-s, j))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(spark, rows, k=20, kind="double", more=()):
    df = spark.createDataFrame([(*r, *more) for r in rows], f"vec_id long, embedding array<{kind}>" + (", ROW string, cell string" if more else "")).repartition(3)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.Index(df, "vec_id", "embedding", k).search(F.col("id") % 20 == 0).collect())


def clustered(n, d, seed=1, centres=6):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, d))
    x = c[rng.integers(0, centres, n)] + 0.7 * rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("d", [1, 3, 64, 300])
def test_one_cell_equals_brute_force(spark, d):
    x = clustered(230, d, d) * np.random.default_rng(2).uniform(0.01, 30, (230, 1))
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    assert found(spark, rows) == brute(rows, 20)


def test_unusable_vectors_ties_and_repeats(spark):
    good = [(i, [float(i % 4), 1.0]) for i in range(-20, 30)]
    bad = [(40, None), (60, []), (80, [0.0, 0.0]), (100, [math.nan, 1.0]), (120, [math.inf, 1.0]), (140, [None, 1.0]), (None, [1.0, 1.0]), (160, [1.0, 2.0, 3.0])]
    assert found(spark, good + bad, more=("x", "y")) == brute(good, 20)
    again = [*good, (0, [0.0, 1.0]), (0, [3.0, 3.0]), (20, [0.0, 1.0])]
    assert found(spark, again) == brute(again, 20)
    assert found(spark, good[:3], kind="float") == brute(good[:3], 20) and found(spark, good[:1]) == []
    assert found(spark, [(40, None)]) == []
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.Index(empty, "vec_id", "embedding").search().count() == 0


def test_many_cells_and_blocks_keep_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 150)
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERIES", 16)
    x = clustered(3000, 48, 5)
    x[1000:2000] = x[0] + 0.01 * np.random.default_rng(1).standard_normal((1000, 48))  # a third of all rows in one cell
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    got, want = found(spark, rows), brute(rows, 20)
    assert len(got) == len(want)
    hit = {(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}
    assert len(hit) >= 0.95 * len(want)
    scores = {(q, v): s for q, _, v, s in want}
    assert all(s == scores[q, v] for q, _, v, s in got if (q, v) in scores)


def test_bounds_hold_and_leave_most_vectors_out():
    x = clustered(4000, 64, 3)
    c = ann.centroids_of(x[:500].astype(np.float32), 1)
    model = ann.Model(c, ann.rotation(64, 256, 1), 1.0, 1)
    cell, codes, scalars = ann.encoded(x, model)
    q = x[:50].astype(np.float32)
    est, err = ann.estimates(q, 0, codes, scalars, model)
    real = q.astype(np.float64) @ x.T
    assert np.mean(np.abs(est - real) > err) < 1e-3
    assert abs(np.mean(est - real)) < 2e-3  # no bias
    limit = np.sort(real, axis=1)[:, -20]
    assert np.mean(est + err >= limit[:, None]) < 0.35
    assert (cell == 0).all()


def test_rotation_keeps_products():
    p = ann.rotation(30, 256, 3)
    assert np.allclose(p @ p.T, np.eye(30), atol=1e-5)
