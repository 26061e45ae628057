"""Payloads are parsed once."""

import datetime

from pulseloom.plans import storage
from pulseloom.sources.payloads import normalise_days

DAY = datetime.datetime(2024, 1, 1, 8)
READINGS = "event_id long, user_id long, metric_type string, ts timestamp_ntz, value double, meta string"


def test_days_are_made_in_one_pass(spark):
    """No join, and one parsed payload for the series and the single values of a day; a missing person is a person."""
    rows = [(k, u, "click", DAY + datetime.timedelta(minutes=k), float(k), "{}") for u, k in ((1, 1), (1, 2), (None, 3))]
    df = normalise_days(storage.payload(spark.createDataFrame(rows, READINGS)))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    got = {r.user_id: (r.resting_heart_rate, r.day, r.hba1c is None) for r in df.collect()}
    assert got == {1: (1.5, DAY.date(), False), None: (3.0, DAY.date(), False)}
