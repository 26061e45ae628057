"""Queries against their SQL on readings that the smallest tables lack."""

import datetime
import random

import duckdb
import pytest

from pulseloom.plans import learning, outcomes, registry, relational, rollups  # noqa: F401

DAY = datetime.datetime(2024, 1, 1, 8)
READINGS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def both(spark, folder, name, readings):
    """Rows of the query and of its SQL on readings (user, day, type, value)."""
    rows = [(k, DAY + datetime.timedelta(days=day, seconds=k), user, kind, float(value), "{}") for k, (user, day, kind, value) in enumerate(readings)]
    spark.createDataFrame(rows, READINGS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted(tuple(norm(r[names.index(c)]) for c in df.columns) for r in found.fetchall())
    return sorted(tuple(norm(v) for v in r) for r in df.collect()), want


SWEEPS = ["alr_3_correlation_alerts", "cor_10_correlation_sweep", "cor_12_network", "cor_12_network_metrics", "cor_13_components", "cor_13_clusters"]


@pytest.mark.parametrize("name", SWEEPS)
def test_sweeps_of_a_type_that_does_not_vary(spark, tmp_path, name):
    """A person of one flat type keeps the pairs of the others."""
    flat = [(1, d, "click", 5) for d in range(8)]
    rows = flat + [(u, d, t, (d * k) % 7 + d * u) for u in (1, 2) for d in range(8) for k, t in ((3, "view"), (4, "error"), (5, "signup"))]
    got, want = both(spark, tmp_path, name, rows)
    assert got == want and len(got) > 1


def test_limit_that_ends_in_a_half(spark, tmp_path):
    """Two people of the larger tables whose percentile has a 5 at the seventh digit and nothing behind it."""
    first = {4: ((102.04, 27.1), (214.69, 6.39)), 10: ((118.28,), (27.6,)), 17: ((50.93,), (158.97,)), 22: ((40.71,), (145.43,)), 29: ((3.05,), (38.57,))}
    second = {3: ((7.81,), (315.88,)), 13: ((28.96, 85.99), (2.14,)), 14: ((6.9, 2.97), (36.53,)), 15: ((12.93,), (54.82,)), 17: ((57.81,), (16.01,)), 28: ((27.93,), (31.03,))}
    rows = [(u, d, t, v) for u, days in ((1, first), (2, second)) for d, sides in days.items() for t, values in zip(("click", "view"), sides, strict=True) for v in values]
    got, want = both(spark, tmp_path, "ano_3_hotelling_by_person", rows)
    assert got == want and len(got) == 11


@pytest.mark.parametrize("name", ["agg_24_sleep_schedule", "agg_25_bedtime_mean"])
def test_means_that_end_in_a_half(spark, tmp_path, name):
    """Hours of six digits whose mean has a 5 at the seventh: sums go in the order of the table, in however many pieces it's read."""
    rng = random.Random(3)
    rows = [(k, DAY + datetime.timedelta(minutes=rng.randrange(30 * 1440)), rng.randrange(1500), "signup", 1.0, "{}") for k in range(21000)]
    spark.createDataFrame(rows, READINGS).repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute("SET threads = 1")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet({sorted(map(str, (tmp_path / 'events.parquet').glob('part-*.parquet')))})")
    df = registry.QUERIES[name](spark, str(tmp_path))
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall())


def test_days_nearly_on_a_line(spark, tmp_path):
    """A person of the larger tables whose three days lie nearly on a line: each distance is 4/3, as of any three days that aren't on one."""
    rows = [(1, d, t, v) for d, *sides in ((3, 189.57, 37.88), (19, 21.26, 62.72), (23, 56.89, 57.46)) for t, v in zip(("click", "view"), sides, strict=True)]
    got, want = both(spark, tmp_path, "ano_3_hotelling_by_person", rows)
    assert got == want and len(got) == 3 and {r[3] for r in got} == {1.333333}


def test_limit_between_two_distances(spark, tmp_path):
    """Two people of the larger tables whose limit ends in a half only if it is interpolated with one rounding."""
    first = {6: ((94.11,), (62.93, 91.04)), 14: ((161.97,), (18.77,)), 23: ((104.87, 29.21), (55.47,)), 28: ((57.1,), (4.34,))}
    second = {2: ((26.09, 22.28), (43.56,)), 6: ((24.9,), (48.39,)), 10: ((12.54,), (21.41,)), 24: ((54.1, 77.27), (72.29,)), 27: ((164.99,), (71.22, 82.86))}
    rows = [(u, d, t, v) for u, days in ((1, first), (2, second)) for d, sides in days.items() for t, values in zip(("click", "view"), sides, strict=True) for v in values]
    got, want = both(spark, tmp_path, "ano_3_hotelling_by_person", rows)
    assert got == want and len(got) == 9


def test_days_on_a_line(spark, tmp_path):
    """A person whose clicks never vary, and one whose days are all on a line, have no number in SQL; others keep theirs."""
    rows = [(u, d, t, v) for u, f in ((1, lambda d: (5, d * d)), (2, lambda d: (d, d + 1)), (3, lambda d: (d, d * d))) for d in range(3) for t, v in zip(("click", "view"), f(d), strict=True)]
    got, want = both(spark, tmp_path, "ano_3_hotelling_by_person", rows)
    assert list(map(str, got)) == list(map(str, want)) and [r[3] == r[3] for r in got] == [False] * 6 + [True] * 3
