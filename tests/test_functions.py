"""Printed table values, invariants of models, and streams against batches."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from pulseloom.functions.stats import normal_cdf, t_quantile_975, t_two_sided
from pulseloom.operators import correlations as C, learning as L, outcomes as Y
from pulseloom.operators.aggregates import with_mad
from pulseloom.operators.anomalies import isolation_forest
from pulseloom.operators.relations import nearest
from pulseloom.operators.text import flag_follow_ups, tag_messages, extract_events, events_to_metrics
from pulseloom.sources.payloads import extract_graphs, normalise_days, normalise_series, parse_time
from pulseloom.sources.sinks import upsert


@pytest.mark.parametrize("t,df", [(12.7062, 1), (4.30265, 2), (3.18245, 3), (2.570582, 5), (2.228139, 10), (2.042272, 30), (1.9679, 300)])
def test_t_tail(spark, t, df):
    row = spark.range(1).select(t_two_sided(F.lit(t), F.lit(df)).alias("p"), t_quantile_975(F.lit(df)).alias("q")).first()
    assert abs(row.p - 0.05) < 2e-4
    assert abs(row.q - t) < (0.02 if df > 2 else 1e-3)


def test_normal_cdf(spark):
    row = spark.range(1).select(normal_cdf(F.lit(1.959964)).alias("a"), normal_cdf(F.lit(-1.0)).alias("b")).first()
    assert abs(row.a - 0.975) < 1e-6 and abs(row.b - 0.158655) < 1e-6


def test_fdr_and_kendall(spark):
    df = spark.createDataFrame([("u", 0.01), ("u", 0.04), ("u", 0.03), ("u", 0.20)], "user_id string, p double")
    assert [round(r.p_adjusted, 4) for r in C.fdr(df, ["user_id"]).orderBy("p").collect()] == [0.04, 0.0533, 0.0533, 0.2]
    pairs = spark.createDataFrame([("u", 1, 1.0, 1.0), ("u", 2, 2.0, 3.0), ("u", 3, 3.0, 2.0), ("u", 4, 4.0, 4.0)], "user_id string, k int, x double, y double")
    assert round(C.kendall(pairs, ["user_id"]).first().tau, 4) == 0.6667


def test_wilson(spark):
    low, high = C.wilson(F.lit(8), F.lit(10))
    row = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert (round(row.a, 3), round(row.b, 3)) == (0.490, 0.943)


def test_mad_zero(spark):
    df = spark.createDataFrame([(1, "a", v) for v in (5.0, 5.0, 5.0, 9.0)], "user_id long, metric_type string, value double")
    assert with_mad(df).first().mad == 0


def test_nearest_takes_the_later_of_two(spark):
    make = lambda rows: spark.createDataFrame(rows, "user_id long, event_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    left = make([(1, 1, "2024-01-01 12:00:00", 0.0), (2, 5, "2024-01-01 12:00:00", 0.0)])
    right = make([(1, 2, "2024-01-01 09:00:00", 9.0), (1, 3, "2024-01-01 15:00:00", 15.0), (2, 6, "2024-01-02 12:00:00", 1.0)])
    assert [(r.user_id, r.y) for r in nearest(left, right, 6).collect()] == [(1, 15.0)]


def test_rate_limit(spark):
    rows = [(1, "low", i, f"2024-01-0{1 + h // 24} {h % 24:02d}:00:00") for i, h in enumerate((0, 1, 2, 3, 25, 26))]
    a = spark.createDataFrame(rows, "user_id long, severity string, event_id long, at string").withColumn("created_at", F.col("at").cast("timestamp_ntz"))
    got = {r.event_id: r.passed for r in Y.rate_limit(a, {"low": 3}).collect()}
    assert [got[i] for i in range(6)] == [True, True, True, False, True, True]


def test_upsert_twice_is_once(spark):
    base = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double")
    batch = spark.createDataFrame([(2, 5.0, 1), (2, 6.0, 2), (3, 7.0, 1)], "k long, v double, seq int")
    once = upsert(base, batch, ["k"], "seq")
    twice = upsert(once, batch, ["k"], "seq")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, 1.0), (2, 6.0), (3, 7.0)]
    assert sorted(map(tuple, upsert(base, batch, ["k"], "seq", "ignore").collect())) == [(1, 1.0), (2, 2.0), (3, 7.0)]


PAYLOAD = """{"data":{"metric_data":[
{"type":"hr","object":{"values":[{"timestamp":1725321600,"value":72.0},{"timestamp":1725321900,"value":73.0},{"timestamp":1725322200,"value":72.0}]}},
{"type":"steps","object":{"values":[{"timestamp":1725321600,"value":150},{"timestamp":1725321900,"value":200},{"timestamp":1725322200,"value":"abc"},{"value":3}]}},
{"type":"hba1c","object":{"value":5.4,"day_start_timestamp":1725321600}},{"type":"recovery","object":{"score":"71","day_start_timestamp":1725321600}},{"type":"vo2_max","object":{"value":40.5}},
{"type":"active_minutes","object":{"values":[{"value":10},{"value":"x"},{"value":5}],"day_start_timestamp":1725321600}},{"type":"mystery","object":{"values":[{"timestamp":1725321600,"value":1}]}},{"type":"temp"},
{"type":"Sleep","object":{"hr_graph":{"data":[{"timestamp":1725285600,"value":60.0}]},"hrv_graph":{"data":[{"timestamp":1725285600,"value":50.0}]}}}]}}"""


def test_payload(spark):
    raw = spark.createDataFrame([(1, PAYLOAD), (2, '{"data":{"metric_data":5}}'), (3, "no json"), (4, None)], "user_id long, payload string")
    assert normalise_series(raw).count() == 5 and extract_graphs(raw).count() == 2
    day = normalise_days(raw).first()
    assert day.steps == 350 and round(day.resting_heart_rate, 3) == 72.333
    assert (day.hba1c, day.recovery_score, day.active_minutes, day.vo2_max) == (5.4, 71.0, 15.0, None)


@pytest.mark.parametrize("text,ok", [("2024-01-05T10:00:00.123Z", True), ("2024-01-05T10:00:00Z", True), ("2024-01-05T10:00:00", True), ("2024-01-05 10:00:00", True), ("2024-01-05", True), ("05/01/2024", False), ("", False)])
def test_times(spark, text, ok):
    assert (spark.range(1).select(parse_time(F.lit(text)).alias("t")).first().t is not None) == ok


def test_messages(spark):
    texts = ["supplement zinc 30mg 8pm", "meal lentils 1pm", "exercise rowing 20min 7am", "drink tea 12oz 4pm", "how did I sleep?"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.id, r.metric_type): r.value for r in events_to_metrics(extract_events(df)).collect()}
    assert got == {
        (0, "zinc_intake"): 30.0, (0, "supplement_intake"): 1.0, (1, "meal_timing"): 13.0, (1, "lentils_consumption"): 1.0, (2, "rowing_duration"): 20.0,
        (2, "exercise_duration"): 20.0, (2, "exercise_intensity"): 3.0, (3, "tea_consumption"): 12.0, (3, "caffeine_intake"): 70.5,
    }
    tags = tag_messages(spark.createDataFrame([(1, "Show the trend of HRV for the past 2 weeks"), (2, "Which pulse was the highest yesterday")], "id long, text string")).orderBy("id").collect()
    assert (tags[0].metric, tags[0].aggregation, tags[0].days) == ("hrv", "trend", 14) and (tags[1].metric, tags[1].aggregation, tags[1].days) == ("heart_rate", "max", 1)


def test_follow_ups(spark):
    turns = [("I walked to the lake", False), ("what about the evening then", True), ("please give more details", True), ("how about my pulse", True), ("compared to April it is lower", True), ("same for the steps", True), ("list my naps of May", False)]
    df = spark.createDataFrame([(1, i, "user", t) for i, (t, _) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    assert [r.is_follow_up for r in flag_follow_ups(df).orderBy("turn").collect()] == [x for _, x in turns]


@pytest.fixture(scope="module")
def m(spark):
    from pulseloom.sources.readings import readings

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the test tables are absent")
    return readings(spark, "/root/testdata/sf0.001")


def test_model_invariants(m):
    scores = isolation_forest(m, trees=5)
    assert scores.count() == m.count() and scores.where("score < 0 OR score > 1").count() == 0
    types = ["click", "view"]
    assert L.behaviour_clusters(m, types, 3).count() == L.day_vectors(m, types).count()
    none = m.limit(0)
    for made in (L.behaviour_clusters(none, types), L.state_clusters(none, types), L.motifs(none), L.global_models(none), L.contextual(none), L.forecast_model(none, "ridge"), isolation_forest(none)):
        assert made.count() == 0
    assert L.global_models(m.where("metric_type = 'click'")).count() == 1
    assert L.forecast_model(m, "ridge").where("n > 0 AND rmse > 0").count() == 5
    assert L.forecast_css(m).where("phi IS NULL").count() == 0
    assert L.normality(m).where("p BETWEEN 0 AND 1").count() == 5


def test_imports_without_the_optional_package(tmp_path):
    """With the package for training text and the pipeline gone, the entry still imports and has its other queries."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "pulseloom"), tmp_path / "pulseloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'alr_1_anomaly_alerts' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_sign_sums_against_all_pairs(spark):
    """Ties in rank and value, one row, and a group that is much larger than the others."""
    import random

    rng = random.Random(3)
    rows = [("big", rng.randint(1, 300), float(rng.randint(0, 40))) for _ in range(700)] + [("one", 1, 2.0), ("tied", 1, 1.0), ("tied", 1, 2.0), ("two", 1, 5.0), ("two", 2, 4.0)]
    got = {r.k: (r.s, r.untied) for r in C.sign_sums(spark.createDataFrame(rows, "k string, r int, v double"), ["k"], "r", "v").collect()}
    for key in ("big", "one", "tied", "two"):
        own = [(r, v) for k, r, v in rows if k == key]
        signs = [(b > a) - (b < a) for p, a in own for q, b in own if p < q]
        assert got[key] == (sum(signs), sum(map(abs, signs)))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([("u", f"n{i:03}", f"n{i + 1:03}") for i in range(40)], "user_id string, m1 string, m2 string")
    nodes = spark.createDataFrame([("u", f"n{i:03}") for i in range(41)] + [("u", "z"), ("v", "n001")], "user_id string, node string")
    got = {(r.user_id, r.node): r.component for r in C.small_components(edges, nodes, ["user_id"]).collect()}
    assert got == {**{("u", f"n{i:03}"): "n000" for i in range(41)}, ("u", "z"): "z", ("v", "n001"): "n001"}


def test_ensemble_with_all_methods(m):
    from pulseloom.operators import anomalies as X

    few, every = X.ensemble(m), X.ensemble(m, methods=tuple(X.METHODS))
    assert every.select("event_id").distinct().count() == every.count() >= few.count() > 0
    assert every.where("score < 0 OR score > 1 OR confidence > 1").count() == 0 and every.where("is_anomaly").count() > 0
