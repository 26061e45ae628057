"""What shows only on larger tables: sides that don't vary, half-way values, grids of many people."""

import datetime

from pyspark.sql import functions as F

from pulseloom.functions.stats import fixed
from pulseloom.operators import text
from pulseloom.operators.aggregates import KEYS, resample_hourly, resample_linear
from pulseloom.operators.correlations import lagged_corr, partial_corr, pearson, spearman
from pulseloom.operators.learning import motifs
from pulseloom.operators.outcomes import circadian_patterns
from pulseloom.operators.profiles import multi_scale_corr, sleep_schedule
from pulseloom.operators.windows import rolling_corr

DAY = datetime.datetime(2024, 1, 1)
READINGS = "event_id long, user_id long, metric_type string, ts timestamp_ntz, value double"


def test_correlations_of_a_side_that_does_not_vary(spark):
    """Such a group has no row, and the others keep theirs; pairs that lack a side don't count."""
    rows = [(1, k, 5.0, float(k * k)) for k in range(12)] + [(2, k, float(k), float(k * k)) for k in range(12)]
    pairs = spark.createDataFrame(rows, "user_id long, k long, x double, y double")
    for f in (pearson, spearman):
        assert [r.user_id for r in f(pairs, ["user_id"]).collect()] == [2]
    three = pairs.withColumn("z", F.col("k") * 1.0 + F.pmod("k", F.lit(3)))
    assert [r.user_id for r in partial_corr(three, ["user_id"]).collect()] == [2]
    daily = pairs.withColumn("day", F.date_add(F.lit(DAY.date()), F.col("k").cast("int")))
    assert {r.user_id for r in multi_scale_corr(daily).collect()} == {2}
    both = daily.select("user_id", F.col("day").cast("timestamp_ntz").alias("ts"), F.explode(F.create_map(F.lit("a"), "x", F.lit("b"), "y")).alias("metric_type", "value"))
    assert [r.user_id for r in rolling_corr(both, "a", "b").collect()] == [2]
    gap = pearson(spark.createDataFrame([(1, float(k), float(k % 4)) for k in range(10)] + [(1, 1e6, None)], "user_id long, x double, y double"), ["user_id"]).first()
    whole = pearson(spark.createDataFrame([(1, float(k), float(k % 4)) for k in range(10)], "user_id long, x double, y double"), ["user_id"]).first()
    assert abs(gap.r - whole.r) < 1e-12


def test_motifs_of_a_series_that_does_not_vary(spark):
    """Its shapes are flat; each window of four readings is counted."""
    rows = [(k, 1, "a", DAY + datetime.timedelta(hours=k), 3.0) for k in range(6)] + [(10 + k, 2, "a", DAY + datetime.timedelta(hours=k), float(k % 3)) for k in range(9)]
    out = motifs(spark.createDataFrame(rows, READINGS), k=4).collect()
    assert sum(r.n for r in out) == 3 + 6
    assert any([r[f"at_{i}"] for i in range(4)] == [0.0] * 4 for r in out)


def test_half_way_values_round_as_in_sql(spark):
    """Text of three digits follows the exact binary value; means near a half follow the product with a million."""
    import random

    import duckdb

    rng = random.Random(5)
    values = [36.6175, 71.0435, 0.0625, 0.1875, 0.0005, -2.0625, -0.3335, 0.0, 999999.9995] + [round(rng.uniform(0, 600), 4) for _ in range(2000)] + [k / 16 for k in range(200)]
    got = [r.s for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(fixed(F.col("v"), 3).alias("s")).collect()]
    assert got == [f"{v:.3f}" for v in values]
    halves = [k / 1e6 + 5e-7 for k in range(8143000, 8143400)]
    beds = spark.createDataFrame([(k, v, v) for k, v in enumerate(halves)], "user_id long, bed_hour double, wake_hour double")
    got = [r.bed_mean for r in sleep_schedule(beds).orderBy("user_id").collect()]
    assert got == [r[0] for r in duckdb.execute("SELECT round(unnest(?::DOUBLE[]), 6)", [halves]).fetchall()]


def test_hours_of_one_day_are_not_the_steadiest(spark):
    """An hour that the grid holds once has no deviation, which isn't the smallest one."""
    rows = [(k, 1, "a", DAY + datetime.timedelta(hours=h), float(v)) for k, (h, v) in enumerate([(2, 1), (3, 7), (26, 5), (27, 7), (29, 2)])]
    out = circadian_patterns(resample_hourly(spark.createDataFrame(rows, READINGS), KEYS), KEYS).first()
    assert out.steadiest_hour == 3 and out.trough_hour == 2


def test_grids_of_people_are_not_shuffled(spark):
    """Filled and interpolated hours of each series, also where means are null; everything is exchanged before the grid is made."""
    at = lambda h: DAY + datetime.timedelta(hours=h)
    rows = [(1, 1, "a", at(0), None), (2, 1, "a", at(2), 4.0), (3, 1, "a", at(4), 8.0), (4, 1, "a", at(6), None), (5, 2, "a", at(1), None), (6, 2, "a", at(2), None), (7, 1, "b", at(3), 1.0)]
    m = spark.createDataFrame(rows, READINGS)
    table = lambda df: sorted((r.user_id, r.metric_type, int((r.hour - DAY).total_seconds() // 3600), r["mean"]) for r in df.collect())
    rest = [(1, "b", 3, 1.0), (2, "a", 1, None), (2, "a", 2, None)]
    assert table(resample_hourly(m, KEYS)) == [(1, "a", h, v) for h, v in enumerate([4.0, 4.0, 4.0, 4.0, 8.0, 8.0, 8.0])] + rest
    assert table(resample_linear(m, KEYS)) == [(1, "a", h, v) for h, v in enumerate([None, None, 4.0, 6.0, 8.0, None, None])] + rest
    grid = resample_hourly(m, KEYS).groupBy("user_id", "hour").agg(F.max("mean").alias("x"))
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("Generate explode") < plan.index("Exchange") and "Join" not in plan


def test_lagged_correlations_of_many_groups(spark):
    """Each lag's r and n are those of the pairs that both sides have; gaps, short and constant series have none. No rows are copied per lag."""
    import numpy as np

    rng = np.random.default_rng(2)
    x, y = rng.normal(size=60), rng.normal(size=60)
    y[5:] += 2 * x[:-5]
    rows = [(1, k, float(x[k]) if k != 30 else None, float(y[k])) for k in range(60) if k != 40] + [(2, k, 1.5, float(k)) for k in range(40)] + [(3, k, float(k), float(k)) for k in range(5)]
    series = spark.createDataFrame(rows, "user_id long, i long, x double, y double")
    found = lagged_corr(series, ["user_id"], 8)
    got = {(r.user_id, r.lag): (r.n, r.r) for r in found.collect()}
    assert {u for u, _ in got} == {1} and len(got) == 17
    for lag in range(-8, 9):
        pairs = [(x[k], y[k + lag]) for k in range(60) if 0 <= k + lag < 60 and k not in (30, 40) and k + lag != 40]
        assert got[1, lag][0] == len(pairs) and abs(got[1, lag][1] - np.corrcoef(*zip(*pairs))[0, 1]) < 1e-12
    assert max(got, key=lambda k: got[k][1]) == (1, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_vector_search_in_tiles(spark, monkeypatch):
    """Many small tiles give what all pairs give, ties by id; vectors without length, with nulls, or of another length meet nothing."""
    import numpy as np

    monkeypatch.setattr(text, "TILE_QUERIES", 7)
    monkeypatch.setattr(text, "TILE_ROWS", 40)
    x = np.random.default_rng(4).normal(size=(150, 6))
    x[20:26] = x[3]
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(200, [0.0] * 6), (201, None), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = text.vector_search(df.where("vec_id % 5 = 0"), df, 4, 0.3)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in out.orderBy("query_id", "k").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 150, 5):
        s, d = (unit @ unit[q]).round(6), np.linalg.norm(x - x[q], axis=1).round(6)
        assert got[q] == [int(i) for i in sorted(range(150), key=lambda i: (-s[i], d[i], i)) if s[i] >= 0.3][:4]
    assert set(got) == {*range(0, 150, 5)}


def test_text_search_shuffles_only_what_is_found(spark, monkeypatch):
    """Both ways give the same rows; with few queries no words of documents are shuffled."""
    rows = [(k, " ".join(w for i, w in enumerate(["sun", "moon", "sea", "wind", "sea"]) if k >> i & 1)) for k in range(32)] + [(40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "Sea moon"), (2, "wind, wind sun sea"), (3, "absent sea"), (4, ""), (5, None)], "query_id long, query string")
    few = text.text_search(queries, docs, 40)
    assert "keys=[doc_id" not in few._jdf.queryExecution().executedPlan().toString()
    few = sorted(few.collect())
    monkeypatch.setattr(text, "QUERY_ROWS", 0)
    assert few == sorted(text.text_search(queries, docs, 40).collect()) and {r.query_id for r in few} == {1, 2}
