"""The alert limiter as a stateful processor: late and out-of-order events are put in order before they are counted."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event time of which the events of a key are held together until the watermark has passed it.
SLOT_MINUTES = 15
#: Answers of a key that are given at once.
ANSWERS = 10_000


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start within this scope keep their state in RocksDB, on disk rather than on the heap."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class Limiter(StatefulProcessor):
    """Per key: the open window (start, count), and slots of events that the watermark hasn't passed.

    An event waits in the slot of its time, in the state store. A timer of the
    earliest slot fires when nothing earlier can come any more; that call takes
    all slots that the watermark has passed, one after another, so what it holds
    is a slot of a key and some answers. A window that has ended is dropped then,
    or by a timer of its own.
    """

    def __init__(self, limits: dict[str, int], hours: int, slot_minutes: int = SLOT_MINUTES):
        self.limits, self.span, self.slot = limits, hours * 3_600_000_000, slot_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, count long")
        self.slots = handle.getMapState("slots", "slot long", "events binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        earliest = None
        for pdf in rows:
            t, ids = pdf["t"].to_numpy(np.int64), pdf["event_id"].to_numpy(np.int64)
            of = t // 1000 // self.slot
            for slot in np.unique(of):
                own = np.stack([t[of == slot], ids[of == slot]], 1).tobytes()
                held = self.slots.getValue((int(slot),))
                self.slots.updateValue((int(slot),), ((bytes(held[0]) if held else b"") + own,))
                earliest = int(slot) if earliest is None else min(earliest, int(slot))
        if earliest is not None:
            self.handle.registerTimer((earliest + 1) * self.slot)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = max(int(expiredTimerInfo.getExpiryTimeInMs()), int(timerValues.getCurrentWatermarkInMs()))
        held = sorted(k[0] for k in self.slots.keys())  # noqa: SIM118
        due = [k for k in held if (k + 1) * self.slot <= now]
        start, count = self.window.get() if self.window.exists() else (None, 0)
        most, ids, answers, waiting = self.limits.get(key[1], min(self.limits.values())), [], [], 0
        for slot in due:
            events = np.frombuffer(bytes(self.slots.getValue((slot,))[0]), np.int64).reshape(-1, 2)
            self.slots.removeKey((slot,))
            events = events[np.lexsort((events[:, 1], events[:, 0]))]
            passed = np.zeros(len(events), bool)
            for i, t in enumerate(events[:, 0].tolist()):
                if start is None or t - start >= self.span:
                    start, count = t, 0
                count += 1
                passed[i] = count <= most
            ids.append(events[:, 1])
            answers.append(passed)
            waiting += len(events)
            if waiting >= ANSWERS or slot == due[-1]:
                yield pd.DataFrame({"who": key[0], "severity": key[1], "event_id": np.concatenate(ids), "passed": np.concatenate(answers)})
                ids, answers, waiting = [], [], 0
        if len(held) > len(due):
            self.handle.registerTimer((held[len(due)] + 1) * self.slot)
        if start is not None:
            if now * 1000 - start >= self.span + self.slot * 1000:  # what is still held is no older than a slot
                self.window.clear()
            elif due:
                self.window.update((start, count))
                self.handle.registerTimer((start + self.span) // 1000 + 2 * self.slot)

    def close(self) -> None:
        pass


def limit_in_order(stream: DataFrame, limits: dict[str, int], hours: int = 24, late: str = "6 hours", slot_minutes: int = SLOT_MINUTES) -> DataFrame:
    """(user_id, severity, event_id, passed) of a stream (user_id, severity, event_id, ts): which events pass.

    Events are counted in order of their time (then id), whatever order they
    come in, if they are no later than ``late``; later ones are left out. The
    window of a key opens anew with the first event after it ends. An event is
    answered when the watermark has passed the slot it lies in. Events without a
    person are one key; a severity without a limit has the smallest. Start the
    stream within ``rocksdb``.
    """
    # a key without nulls, which pandas would turn into numbers that equal nothing
    who, severity = F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("who"), F.coalesce("severity", F.lit("")).alias("severity")
    keyed = stream.withWatermark("ts", late).select(who, severity, "event_id", "ts", F.unix_micros("ts").alias("t"))
    found = keyed.groupBy("who", "severity").transformWithStateInPandas(Limiter(limits, hours, slot_minutes), "who string, severity string, event_id long, passed boolean", "append", "eventTime")
    return found.select(F.nullif("who", F.lit("")).cast("long").alias("user_id"), F.nullif("severity", F.lit("")).alias("severity"), "event_id", "passed")
