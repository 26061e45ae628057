"""State kept over batches: baselines against a rebuild, the limiter against a plain loop."""

import datetime
import math
import random

import pytest

from pulseloom.streaming import incremental as I, jobs, limiter

START = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, metric_type string, ts timestamp_ntz, value double"


def made(seed, n):
    rng = random.Random(seed)
    return [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["a", "b"]), START + datetime.timedelta(minutes=7 * i), rng.choice([1e6 + rng.gauss(0, 1), rng.gauss(5, 2), None, 3.0])) for i in range(n)]


def plain(rows):
    out = {}
    for _, user, kind, _, v in rows:
        if v is not None:
            out.setdefault((user, kind), []).append(v)
    return out


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_batches_equal_a_rebuild(spark, tmp_path):
    rows = made(1, 900)
    state = I.BaselineState(spark, str(tmp_path))
    assert state.table() is None
    batches = [spark.createDataFrame(rows[k : k + 225], SCHEMA) for k in range(0, 900, 225)]
    for k, batch in enumerate(batches):
        state.apply(batch, k)
        if k == 1:
            before = state.pointer()
            state.apply(batch, 1)  # the batch again, after it was applied
            state.apply(batches[0], 0)
            assert state.pointer() == before
    want = plain(rows)
    got = {(r.user_id, r.metric_type): r for r in state.table().collect()}
    whole = {(r.user_id, r.metric_type): r for r in I.partials(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == set(want) == set(whole)
    for key, values in want.items():
        mean = math.fsum(values) / len(values)
        m2 = math.fsum((v - mean) ** 2 for v in values)
        for r in (got[key], whole[key]):
            assert r.n == len(values) and close(r["mean"], mean) and math.isclose(r.m2, m2, rel_tol=1e-6) and (r.low, r.high) == (min(values), max(values))
    of = {(r.user_id, r.metric_type): r for r in I.as_baselines(state.table()).collect()}
    exact = 0
    for key, values in want.items():
        values, n = sorted(values), len(values)
        for q, c in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
            if n <= I.SKETCH_K:
                exact += of[key][c] == values[math.ceil(q * n) - 1]
            else:  # within the sketch's rank error
                low, high = sum(v < of[key][c] for v in values) / n, sum(v <= of[key][c] for v in values) / n
                assert low - 0.02 <= q <= high + 0.02
    assert exact >= 12


def test_a_crash_between_version_and_pointer(spark, tmp_path, monkeypatch):
    rows = made(2, 200)
    first, second = spark.createDataFrame(rows[:100], SCHEMA), spark.createDataFrame(rows[100:], SCHEMA)
    state = I.BaselineState(spark, str(tmp_path))
    state.apply(first, 0)
    with monkeypatch.context() as m:
        m.setattr(state, "_point", lambda to: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            state.apply(second, 1)
    assert state.table().agg({"n": "sum"}).first()[0] == sum(r[4] is not None for r in rows[:100])
    I.BaselineState(spark, str(tmp_path)).apply(second, 1)
    assert state.table().agg({"n": "sum"}).first()[0] == sum(r[4] is not None for r in rows)
    state.apply(first.limit(0), 2)
    assert state.pointer()["batch"] == 2 and state.table().agg({"n": "sum"}).first()[0] == sum(r[4] is not None for r in rows)


def test_limiter_with_late_and_unordered_events(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 1, 1, 1, 2, None]), rng.choice(["high", "low"]), START + datetime.timedelta(seconds=rng.randrange(6 * 86_400))) for i in range(1500)]
    rows.sort(key=lambda r: r[3] + datetime.timedelta(seconds=rng.randrange(5 * 3600)))  # up to five hours late
    rows.append((9_000, 1, "high", START + datetime.timedelta(days=9)))
    rows.append((9_001, 1, "high", START + datetime.timedelta(hours=1)))  # too late
    folder = tmp_path / "events"
    for k, (a, b) in enumerate(((0, 500), (500, 1000), (1000, 1501), (1501, 1502))):
        spark.createDataFrame(rows[a:b], "event_id long, user_id long, severity string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    stream = spark.readStream.schema("event_id long, user_id long, severity string, ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/*")
    limits = {"high": 8, "low": 3}
    with limiter.rocksdb(spark):
        got = {r.event_id: r.passed for r in jobs.drain(limiter.limit_in_order(stream, limits, 24), "limited").collect()}
    open_, want = {}, {}
    for event_id, user, severity, t in sorted(rows[:1500], key=lambda r: (r[3], r[0])):
        first, n = open_.get((user, severity), (None, 0))
        first, n = (t, 1) if first is None or t - first >= datetime.timedelta(hours=24) else (first, n + 1)
        open_[user, severity] = first, n
        want[event_id] = n <= limits[severity]
    assert got == want  # the last event waits for the watermark, the one that is too late is left out
