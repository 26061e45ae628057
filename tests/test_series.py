"""Segments, partial correlations and normality against independent computations."""

import datetime
import math

import numpy as np

from pulseloom.operators.correlations import partial_corr
from pulseloom.operators.learning import normality
from pulseloom.operators.trends import segments


def test_segments_finds_planted_steps(spark):
    """Two steps give three segments; a constant series is one; nulls are left out; an empty table has none."""
    levels = [1.0] * 12 + [20.0] * 9 + [6.0] * 15
    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k)
    rows = [(k, 1, "a", day(k), v + 0.1 * (k % 2)) for k, v in enumerate(levels)] + [(100 + k, 2, "a", day(k), 5.0) for k in range(8)] + [(200, 1, "a", day(50), None)]
    m = spark.createDataFrame(rows, "event_id long, user_id long, metric_type string, ts timestamp, value double")
    got = sorted((r.user_id, r.first_k, r.last_k) for r in segments(m).collect())
    assert got == [(1, 1, 12), (1, 13, 21), (1, 22, 36), (2, 1, 8)]
    assert segments(m.limit(0)).count() == 0


def test_partial_corr_equals_residuals(spark):
    """With three controls the result is the correlation of what regressions on them leave; a group that is too small has no row."""
    rng = np.random.default_rng(3)
    z = rng.normal(size=(80, 3))
    x = z @ [1.0, -2.0, 0.5] + rng.normal(size=80)
    y = z @ [0.3, 1.0, 1.0] + 0.5 * x + rng.normal(size=80)
    design = np.column_stack([np.ones(80), z])
    rest = [v - design @ np.linalg.lstsq(design, v, rcond=None)[0] for v in (x, y)]
    rows = [("big", *map(float, (a, b, *c))) for a, b, c in zip(x, y, z)]
    rows += [("small", *r[1:]) for r in rows[:5]]
    df = spark.createDataFrame(rows, "part string, x double, y double, z1 double, z2 double, z3 double")
    out = partial_corr(df, ["part"], ("z1", "z2", "z3")).collect()
    assert [r.part for r in out] == ["big"]
    assert abs(out[0].partial_r - np.corrcoef(*rest)[0, 1]) < 1e-9


def test_normality_with_ties_and_any_buckets(spark):
    """The ranks don't depend on the buckets, also where one value is a third of all rows; small and constant types have no row."""
    rng = np.random.default_rng(5)
    values = [float(v) for v in rng.normal(size=200).round(1)] + [0.3] * 100
    rows = [(k, "a", v) for k, v in enumerate(values)] + [(1000 + k, "b", 1.0) for k in range(30)] + [(2000 + k, "c", float(k)) for k in range(5)] + [(3000, "a", None)]
    m = spark.createDataFrame(rows, "event_id long, metric_type string, value double")
    many, one = normality(m).collect(), normality(m, 1).collect()
    assert many == one and [r.metric_type for r in many] == ["a"] and many[0].n == 300
    v = np.sort(np.array(values))
    phi = np.array([0.5 * (1 + math.erf(t / math.sqrt(2))) for t in (v - v.mean()) / v.std(ddof=1)])
    i = np.arange(1, 301)
    assert abs(many[0].a2 - (-300 - np.sum((2 * i - 1) * (np.log(phi) + np.log(1 - phi[::-1]))) / 300)) < 1e-3
    assert normality(m.limit(0)).count() == 0
