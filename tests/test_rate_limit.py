"""The alert limiter against a plain loop, and without a gathered group."""

import datetime
import random

import pandas as pd

from pulseloom.operators.outcomes import rate_limit
from pulseloom.streaming.limiter import Limiter


def test_hot_key_is_streamed(spark):
    rng = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, rng.choice([1] * 20 + [2, None]), rng.choice(["high", "low"]), start + datetime.timedelta(minutes=rng.randrange(60_000))) for i in range(15_000)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, severity string, created_at timestamp_ntz")
    limits, open_, want = {"high": 8, "low": 3}, {}, {}
    for event_id, user, severity, t in sorted(rows, key=lambda r: (r[3], r[0])):
        first, n = open_.get((user, severity), (None, 0))
        first, n = (t, 1) if first is None or t - first >= datetime.timedelta(hours=24) else (first, n + 1)
        open_[user, severity] = first, n
        want[event_id] = n <= limits[severity]
    out = rate_limit(df, limits)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert {r.event_id: r.passed for r in out.collect()} == want


def test_slots_share_timers_and_answers():
    """All slots of a key that the watermark has passed are answered by one call; the rest waits for a timer of its earliest."""
    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, v):
            self.held = v

        def clear(self):
            self.held = None

    class Map(dict):
        containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.get, dict.__setitem__, dict.__delitem__

    class Handle:
        timers: list = []
        getValueState = lambda self, *a: Value()
        getMapState = lambda self, *a: Map()

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

    class At:
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    hour, limiter, handle = 3_600_000, Limiter({"low": 3}, 24), Handle()
    limiter.init(handle)
    rng = random.Random(3)
    t = [rng.randrange(1000 * 1000 * hour // 1000) for _ in range(400)]  # a thousand hours, in microseconds / 1000
    rows = pd.DataFrame({"t": [v * 1000 for v in t], "event_id": range(400)})
    assert list(limiter.handleInputRows(("1", "low"), iter([rows]), At(0))) == []
    first = min(t) // 900_000 * 900_000 + 900_000
    assert handle.timers == [first]
    got, calls = {}, 0
    for mark in (500 * hour, 1100 * hour):
        at = At(mark)
        at.getExpiryTimeInMs = lambda: handle.timers[0]
        for out in limiter.handleExpiredTimer(("1", "low"), at, at):
            calls += 1
            got |= dict(zip(out["event_id"].tolist(), out["passed"].tolist(), strict=True))
        assert set(got) == {i for i, v in enumerate(t) if v // 900_000 * 900_000 + 900_000 <= mark}
    start, n, want = None, 0, {}
    for v, i in sorted(zip(t, range(400), strict=True)):
        start, n = (v, 1) if start is None or v - start >= 24 * hour else (start, n + 1)
        want[i] = n <= 3
    assert got == want and calls == 2 and len(handle.timers) <= 4 and limiter.window.held is None
