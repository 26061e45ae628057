"""Normality of a series against plain numpy and a published value."""

import math
import statistics

import numpy as np

from pulseloom.operators.normality import normality_by_series

NORMAL = statistics.NormalDist()


def weights(n):
    m = np.array([NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    s, u = (m * m).sum(), 1 / math.sqrt(n)
    if n == 3:
        return np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    last = m[-1] / math.sqrt(s) + np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0], u)
    if n <= 5:
        a = m / math.sqrt((s - 2 * m[-1] ** 2) / (1 - 2 * last**2))
    else:
        second = m[-2] / math.sqrt(s) + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
        a = m / math.sqrt((s - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
        a[1], a[-2] = -second, second
    a[0], a[-1] = -last, last
    return a


def test_w_equals_numpy(spark):
    rng = np.random.default_rng(3)
    series = {k: rng.normal(5, 2, n) if k % 2 else rng.exponential(1, n) for k, n in enumerate((3, 3, 4, 5, 6, 7, 11, 12, 20, 50, 300, 1200))}
    series[100] = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float)
    series[101] = np.array([2.0, 2.0, 2.0, 3.0, 3.0, 9.0])  # ties
    rows = [(k * 10_000 + i, k, "a", float(v)) for k, x in series.items() for i, v in enumerate(x)]
    rows += [(1, 200, "a", 4.0), (2, 200, "a", 4.0), (3, 200, "a", 4.0), (4, 201, "a", 1.0), (5, 201, "a", 2.0), (6, 201, "a", None), (7, 201, "a", float("nan"))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, metric_type string, value double")
    got = {r.user_id: r for r in normality_by_series(df).collect()}
    assert set(got) == set(series)  # neither constant series nor those of two values
    for k, x in series.items():
        x = np.sort(x)
        w = (weights(len(x)) @ x) ** 2 / ((x - x.mean()) ** 2).sum()
        assert abs(got[k].w - min(1, w)) < 1e-5, (k, got[k].w, w)
        assert 0 <= got[k].p <= 1 and (got[k].k2 is None) == (len(x) < 20)
    assert abs(got[100].w - 0.78881) < 2e-5 and abs(got[100].p - 0.006704) < 2e-5
    assert got[11].is_normal and not got[10].is_normal and got[10].votes == 0
    assert normality_by_series(df.limit(0)).count() == 0
