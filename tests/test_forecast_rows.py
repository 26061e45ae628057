"""The rows that models are fitted on."""

import datetime

from pulseloom.operators.learning import _split, forecast_rows

DAY = datetime.datetime(2024, 1, 1)
READINGS = "event_id long, user_id long, metric_type string, ts timestamp_ntz, value double"


def test_feature_rows_are_written_once(spark):
    """A pass over the rows reads what has been written, without exchange or sort; the first four fifths of a series are fitted."""
    m = spark.createDataFrame([(u * 100 + k, u, "a", DAY + datetime.timedelta(hours=k), float(k)) for u in (1, 2) for k in range(14)], READINGS)
    train, test = _split(m)
    for rows in (train, test):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and "Scan parquet" in plan
    assert sorted(r.label for r in train.collect()) == sorted([float(k) for k in range(3, 11)] * 2)
    assert sorted(r.label for r in test.collect()) == sorted([11.0, 12.0, 13.0] * 2)
    assert all((r.lag_1, r.lag_2, r.lag_3) == (r.label - 1, r.label - 2, r.label - 3) for r in train.collect())


def test_rows_of_one_event_id_stay_single(spark):
    """A reading that shares its number with another has one row."""
    m = spark.createDataFrame([(7, 1, "a", DAY + datetime.timedelta(hours=k), float(k)) for k in range(5)], READINGS)
    assert sorted(r.label for r in forecast_rows(m).collect()) == [3.0, 4.0]
