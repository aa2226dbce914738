import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import topk

KIND = "vec_id long, embedding array<double>, row long, score long, cell string"


def brute(rows, k, every=20, scale=64):
    good = [(i, v, [math.floor(scale * x) for x in e]) for i, (v, e) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, q, x in good:
        if q is not None and q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), v is None, v or 0, j) for j, v, y in good if j != i and len(x) == len(y))[:k]
            out += [(q, n + 1, None if none else v, -s) for n, (s, none, v, _) in enumerate(found)]
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(v, e, 1, 2, "x") for v, e in rows], KIND)


@pytest.mark.parametrize("clustered", [False, True])
def test_against_brute_force(spark, monkeypatch, clustered):
    """Ties, hot vectors, repeated and null ids, other dimensions; clusters make whole rings drop out."""
    rng = random.Random(int(clustered))
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(8)]
    point = lambda: [c + rng.gauss(0, 0.02) for c in rng.choice(centres)] if clustered else [rng.gauss(0, 0.4) for _ in range(6)]
    rows = [(i, point()) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(300)]
    rows += [(20, point()), (20, point()), (None, point()), (None, [0.1] * 6), (60, None), (80, [0.1, None] * 3), (100, [math.nan] * 6), (120, [math.inf] * 6)]
    rows += [(140, []), (141, []), (160, [0.5, -0.5]), (161, [1.0, 0.25]), (180, [3.0])]
    monkeypatch.setattr(topk, "PART_ROWS", 100)
    monkeypatch.setattr(topk, "RING_ROWS", 30)
    got = topk.search(table(spark, rows), F.col("vec_id") % 20 == 0, k=7, expand=(2, 5))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 7)


def test_few_vectors_and_empty_tables(spark):
    rows = [(0, [1.0]), (20, [2.0]), (21, [-3.0])]
    got = topk.search(table(spark, rows), F.col("vec_id") % 20 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 20)
    for none in (table(spark, []), table(spark, [(0, None)]), table(spark, [(1, [1.0]), (2, [2.0])])):
        assert topk.search(none, F.col("vec_id") % 20 == 0).collect() == []


def test_large_components_are_exact():
    q, c = np.array([[2**40, 3]]), np.array([[2**40, -1], [5, 7]])
    got = topk.scores(np.array([[2**20 + 1, 3]]), np.array([[2**30, 1], [-5, 7]]))
    assert got.tolist() == [[(2**20 + 1) * 2**30 + 3, -5 * (2**20 + 1) + 21]]
    assert topk.scores(q, c).tolist() == [[2**63 - 1, 5 * 2**40 + 21]]
    for x in ([0, 127], [-128], [300, -2], [2**31], [-(2**62)], []):
        assert topk.unpack(topk.pack(np.array(x, np.int64))).tolist() == x


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 2, (300, 8)) for c in rng.normal(0, 60, (6, 8))]).round().astype(np.int64)
    index = topk.fit(x[::3].tolist(), 2000)
    cell, dist = index.place(x)
    rings = [(c, dist[cell == c].min(), dist[cell == c].max(), (x[cell == c].astype(float) ** 2).sum(1).max()) for c in np.unique(cell)]
    own = topk.Rings(*(np.array(v) for v in zip(*rings, strict=True)))
    bound, s = own.bounds(x[:40], index), x[:40] @ x.T
    for k, c in enumerate(own.cell):
        assert (s[:, cell == c].max(1) <= bound[:, k]).all()
    kth = np.sort(s, 1)[:, -20]
    assert (bound >= kth[:, None]).mean() < 0.7
