"""Models are fitted, stored, loaded again, and score what they scored."""

import datetime
import random

from pyspark.sql import functions as F

from pulseloom.operators.registry import ModelRegistry


def test_fit_reload_and_score_agree(spark, tmp_path):
    rng = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, 1, kind, start + datetime.timedelta(minutes=97 * i), (10.0 if kind == "a" else 0.0) + (5 if (start + datetime.timedelta(minutes=97 * i)).hour < 12 else -5) + rng.random()) for i in range(400) for kind in ("a", "b/..")]
    rows = [(2 * i + (k == "b/.."), u, k, t, v) for i, u, k, t, v in rows] + [(9_000 + i, 1, "few", start, 1.0) for i in range(20)] + [(9_100, 1, None, start, 1.0), (9_101, 1, "a", start, None)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, metric_type string, ts timestamp_ntz, value double")
    registry = ModelRegistry(spark, str(tmp_path / "models"))
    assert registry.rows().count() == 0 and registry.score(df).count() == 0
    first = {r.metric_type: r for r in registry.train(df, trees=5).collect()}
    assert set(first) == {"a", "b/.."} and all(r.version == 1 and r.n_train + r.n_test == 400 and r.r2 > 0.9 and r.importance["hour"] > 0.9 for r in first.values())
    scores = {r.event_id: (r.version, r.prediction) for r in registry.score(df).collect()}
    assert len(scores) == 800
    # the stored error is that of the stored model
    test = df.join(registry.score(df), ["event_id", "metric_type"]).where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == 0)
    for r in test.groupBy("metric_type").agg(F.avg((F.col("prediction") - F.col("value")) ** 2).alias("mse"), F.count("value").alias("n")).collect():
        assert r.n == first[r.metric_type].n_test and abs(r.mse - first[r.metric_type].mse) < 1e-9
    registry.train(df.where("metric_type = 'a'"), trees=3)
    again = ModelRegistry(spark, str(tmp_path / "models"))  # opened by a later job
    assert {(r.metric_type, r.version, r.trees) for r in again.active().collect()} == {("a", 2, 3), ("b/..", 1, 5)}
    later = {r.event_id: (r.version, r.prediction) for r in again.score(df).collect()}
    assert all(later[i] == scores[i] for i in scores if later[i][0] == 1) and {v for v, _ in later.values()} == {1, 2}
    assert again.train(df.limit(0)).count() == 0
