"""Models per series against numpy, one series at a time."""

import datetime
import math
import random

import numpy as np
import pytest

from pulseloom.operators import multivariate as V
from pulseloom.operators.learning import FEATURES

SCHEMA = "event_id long, user_id long, metric_type string, ts timestamp_ntz, value double, meta string"
START = datetime.datetime(2024, 1, 1)


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "{}") for i, r in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(4)
    rows = []
    for user in range(6):
        for kind in ("a", "b"):
            x = 0.0
            for k in range(rng.choice([5, 12, 40, 90])):
                x = 0.7 * x + rng.gauss(0, 1)
                rows.append((user, kind, START + datetime.timedelta(hours=7 * k + rng.random()), round(50 + 9 * x, 3)))
    rows += [(9, "a", START + datetime.timedelta(days=k), 5.0) for k in range(30)]  # constant, always at one hour
    rows += [(9, "a", START + datetime.timedelta(days=40), None)]
    return rows


def test_ridge_equals_numpy(spark, events):
    got = {(r.user_id, r.metric_type): r for r in V.ridge_by_series(table(spark, events)).collect()}
    series = {}
    for user, kind, ts, v in events:
        if v is not None:
            series.setdefault((user, kind), []).append((ts, v))
    turn = lambda x, n, f: round(f(x * (6.283185307179586 / n)), 6)
    checked = 0
    for key, rows in series.items():
        rows.sort()
        x = []
        for k in range(3, len(rows)):
            ts, _ = rows[k]
            h, d = ts.hour, ts.weekday()
            x.append([h, d, turn(h, 24, math.sin), turn(h, 24, math.cos), turn(d, 7, math.sin), turn(d, 7, math.cos), rows[k - 1][1], rows[k - 2][1], rows[k - 3][1]])
        y = np.array([v for _, v in rows[3:]])
        if len(y) < 10:
            assert key not in got
            continue
        x, cut = np.array(x, float), int(len(y) * 0.8)
        mean, sd = x[:cut].mean(0), x[:cut].std(0)
        sd[sd < 1e-9] = 1
        z = (x[:cut] - mean) / sd
        w = np.linalg.solve(z.T @ z + np.eye(len(FEATURES)), z.T @ (y[:cut] - y[:cut].mean()))
        e = y[cut:] - y[:cut].mean() - ((x[cut:] - mean) / sd) @ w
        r = got[key]
        assert (r.n_fit, r.n_test) == (cut, len(y) - cut)
        assert np.allclose(r.weights, w / sd, atol=2e-6) and math.isclose(r.rmse, math.sqrt((e * e).mean()), abs_tol=2e-6) and math.isclose(r.mae, abs(e).mean(), abs_tol=2e-6)
        spread = y[cut:].var()
        assert r.r2 is None if spread < 1e-12 else math.isclose(r.r2, 1 - (e * e).mean() / spread, abs_tol=2e-6)
        checked += 1
    assert checked >= 4 and (9, "a") in got
    assert V.ridge_by_series(table(spark, events).limit(0)).count() == 0


def test_hotelling_equals_numpy(spark):
    rng = np.random.default_rng(5)
    types, rows, want = ["p", "q", "r", "s"], [], {}
    for user, n in ((1, 40), (2, 12), (3, 4), (4, 30)):
        base = rng.normal(0, 3, (4, 4)) if user != 4 else np.outer(rng.normal(0, 3, 4), [1, 1, 0, 0])  # of low rank
        x = rng.normal(0, 1, (n, 4)) @ base + 20
        x[0] += 15
        for k in range(n):
            for t, kind in enumerate(types):
                ts = START + datetime.timedelta(days=k)
                rows += [(user, kind, ts, float(x[k, t]) - 1.0), (user, kind, ts + datetime.timedelta(hours=3), float(x[k, t]) + 1.0)]
        rows.append((user, "p", START + datetime.timedelta(days=90), 1.0))  # a day without the others
        if n >= 5:
            gap = x - x.mean(0)
            t2 = np.einsum("ki,ij,kj->k", gap, np.linalg.pinv(np.cov(x.T), rcond=1e-10, hermitian=True), gap)
            for k in range(n):
                want[user, (START + datetime.timedelta(days=k)).date()] = (t2[k], np.percentile(t2, 99.7))
    got = V.hotelling_by_person(table(spark, rows), types).collect()
    assert {(r.user_id, r.day) for r in got} == set(want)
    for r in got:
        t2, limit = want[r.user_id, r.day]
        assert math.isclose(r.t2, t2, rel_tol=1e-6, abs_tol=1e-5) and math.isclose(r.limit, limit, rel_tol=1e-6, abs_tol=1e-5) and r.is_anomaly == (r.t2 > r.limit)
    assert any(r.is_anomaly for r in got) and V.hotelling_by_person(table(spark, rows).limit(0), types).count() == 0
