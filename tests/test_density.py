"""Density clusters and components against plain loops."""

import random

import numpy as np
import pytest

from pulseloom.operators import density
from pulseloom.operators.graphs import components


def brute(points, eps, least):
    """points: {id: coordinates}; core flags and clusters."""
    ids = sorted(points)
    x = np.array([points[i] for i in ids], float)
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    near = d2 <= eps * eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(ids)), len(ids))
    while True:
        low = np.where(core, np.where(near & core[None, :], label[None, :], len(ids)).min(1), len(ids))
        if (low == label).all():
            break
        label = low
    out = {}
    for k, i in enumerate(ids):
        best = min(((d2[k, j], ids[label[j]]) for j in np.flatnonzero(near[k] & core)), default=(0, -1)) if not core[k] else (0, ids[label[k]])
        out[i] = (bool(core[k]), int(best[1]))
    return out


def check(spark, points, eps, least, dims, **more):
    rows = [(i, "k", *map(float, p)) for i, p in points.items()]
    cols = [f"c{k}" for k in range(dims)]
    df = spark.createDataFrame(rows, "event_id long, kind string, " + ", ".join(f"{c} double" for c in cols)).repartition(3)
    got = {r.event_id: (r.core, r.cluster) for r in density.dbscan(df, cols, eps, least, ["kind"]).collect()}
    want = brute(points, eps, least)
    assert got == want, [(i, points[i], got[i], want[i]) for i in want if got[i] != want[i]][:5]
    return want


@pytest.mark.parametrize("dims,n,eps,block", [(3, 2000, 0.5, 4096), (2, 600, 0.3, 40), (1, 200, 0.2, 4096), (5, 300, 1.2, 4096)])
def test_equals_brute_force(spark, monkeypatch, dims, n, eps, block):
    monkeypatch.setattr(density, "BLOCK", block)
    rng = np.random.default_rng(dims)
    centres = rng.normal(0, 3, (6, dims))
    x = np.concatenate([centres[rng.integers(0, 6, n * 2 // 3)] + rng.normal(0, 0.4, (n * 2 // 3, dims)), rng.uniform(-6, 6, (n - n * 2 // 3, dims))])
    x[: n // 4] = x[rng.integers(0, 9, n // 4)]  # a quarter of all rows are copies of few points
    want = check(spark, dict(enumerate(x.tolist())), eps, 5, dims)
    assert {c for _, c in want.values()} > {-1} and any(not core and c >= 0 for core, c in want.values())


def test_grid_points_and_odd_rows(spark):
    # distances that are eps exactly, or a little more
    points = {i * 20 + j: (i * 1.0, j * 1.0) for i in range(8) for j in range(8) if (i, j) != (3, 3)}
    check(spark, points, 1.0, 4, 2)
    check(spark, points, 1.0, 6, 2)
    odd = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "a", None, 0.0), (3, None, float("nan"), 1.0), (4, "a", 0.1, 0.0), (5, None, 0.0, 0.0), (6, None, -0.0, 0.0)], "event_id long, kind string, x double, y double")
    got = {r.event_id: (r.core, r.cluster) for r in density.dbscan(odd, ["x", "y"], 0.5, 2, ["kind"]).collect()}
    assert got == {1: (True, 1), 4: (True, 1), 2: (False, -1), 3: (False, -1), 5: (True, 5), 6: (True, 5)}
    assert density.dbscan(odd.limit(0), ["x", "y"], 0.5, 2).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(1000 - i, 999 - i) for i in range(50)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)] + [(7, 7), (5000, 5000), (None, 3)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}


def test_rows_written_grow_with_the_points(spark, monkeypatch):
    """Where thousands of cells are near each other, no pairs of them are made; blocks of boxes give the same."""
    written = {}

    def counted(df, name):
        out = staged(df, name)
        written[name] = out.count()
        return out

    staged = density.staged
    monkeypatch.setattr(density, "staged", counted)
    monkeypatch.setattr(density, "OWN_BLOCK", 400, raising=False)
    monkeypatch.setattr(density, "OTHER_BLOCK", 900, raising=False)
    x = np.random.default_rng(8).normal(0, 0.5, (1500, 5))
    x[:500, :3] = 0.0
    want = check(spark, dict(enumerate(x.tolist())), 0.5, 5, 5)
    assert {core for core, _ in want.values()} == {True, False}
    assert max(written.values()) < 8 * len(x), written
