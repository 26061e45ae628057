"""Interventions, alerts and reports over all people."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pulseloom.functions.labels import label
from pulseloom.operators import correlations as C
from pulseloom.operators.aggregates import KEYS, r6
from pulseloom.operators.anomalies import details
from pulseloom.operators.relations import before_after, interventions
from pulseloom.operators.trends import linear_trend
from pulseloom.operators.windows import latest
from pulseloom.sources.readings import as_of


def intervention_baseline(m: DataFrame, least: int = 3) -> DataFrame:
    """Mean, sd and count of each target type in the fourteen days before."""
    rows = before_after(m, interventions(m)).where("period = 'before'")
    g = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("sd"))
    return g.where(F.col("n") >= least)


def intervention_effect(m: DataFrame) -> DataFrame:
    """Before and after means, change, pooled t, effect size, slopes of both periods, and whether the change counts (10 %)."""
    rows = before_after(m, interventions(m)).withColumn("present", F.col("period") == "after")
    day = F.unix_micros(F.col("ts").cast("timestamp")) / 8.64e10 - F.unix_micros(F.col("started_at").cast("timestamp")) / 8.64e10
    slope = lambda on: F.regr_slope(F.when(on, F.col("value")), F.when(on, F.col("x")))
    slopes = rows.withColumn("x", day).groupBy(*KEYS, "category").agg(slope(~F.col("present")).alias("slope_before"), slope(F.col("present")).alias("slope_after"))
    t = C.ttest(rows, KEYS).join(slopes, KEYS)
    change = (F.col("mean1") - F.col("mean0")) / F.col("mean0") * 100
    return t.select(*KEYS, "category", F.col("n0").alias("n_before"), F.col("n1").alias("n_after"), F.col("mean0").alias("mean_before"), F.col("mean1").alias("mean_after"), change.alias("change_percent"), "t", "p", "cohens_d", label(F.col("cohens_d"), "effect").alias("effect"), "slope_before", "slope_after", (F.abs(change) >= 10).alias("counts"))


def intervention_scores(m: DataFrame) -> DataFrame:
    """Effectiveness (0 to 100) from effect size and change, and confidence (0 to 100) from counts and the test."""
    e = intervention_effect(m)
    effectiveness = F.least(F.lit(50.0), F.abs("cohens_d") * 50) + F.least(F.lit(30.0), F.abs("change_percent")) + F.when(F.abs("t") >= 2, 20.0).otherwise(0.0)
    confidence = F.least(F.lit(40.0), F.least("n_before", "n_after") * 4.0) + F.when(F.abs("t") >= 2.6, 40.0).when(F.abs("t") >= 2, 30.0).otherwise(10.0) + F.when(F.abs("cohens_d") >= 0.5, 20.0).otherwise(5.0)
    return e.select(*KEYS, "category", effectiveness.alias("effectiveness"), confidence.alias("confidence"))


def intervention_summary(m: DataFrame) -> DataFrame:
    """Per category: success rate (effectiveness of 60 or more), assessment, recommendation and expected weeks."""
    s = intervention_scores(m)
    g = s.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("effectiveness") >= 60).cast("double")).alias("rate"), F.avg("effectiveness").alias("mean"), F.avg("confidence").alias("confidence"))
    verdict = F.when(F.col("mean") >= 60, "effective").when(F.col("mean") >= 40, "mixed").otherwise("ineffective")
    weeks = F.create_map(*[F.lit(x) for x in ("nutrition", 4, "exercise", 6, "sleep", 2, "stress", 3, "supplement", 8)])
    advice = F.when(verdict == "effective", "continue").when(F.col("confidence") < 50, "collect_more_data").when(verdict == "mixed", "adjust").otherwise("stop")
    return g.select("category", "n", r6("rate").alias("success_rate"), r6("mean").alias("mean_effectiveness"), verdict.alias("assessment"), advice.alias("recommendation"), weeks[F.col("category")].alias("expected_weeks"))


def confounding(m: DataFrame) -> DataFrame:
    """How many error events fall in the course of each intervention: low, moderate or high."""
    i = interventions(m)
    e = m.where("metric_type = 'error'").select("user_id", "ts")
    far = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    g = i.join(e, "user_id", "left").groupBy("user_id").agg(F.count_if((F.col("ts") >= F.col("started_at")) & (F.col("ts") <= F.coalesce("ended_at", far))).alias("events"))
    return g.withColumn("risk", F.when(F.col("events") <= 2, "low").when(F.col("events") <= 5, "moderate").otherwise("high"))


def response_consistency(m: DataFrame) -> DataFrame:
    """1 - sd / |mean| of the effect sizes of each category, at least zero; and the same before that (raw), mean and sd."""
    g = intervention_effect(m).groupBy("category").agg(F.avg("cohens_d").alias("mean"), F.stddev_pop("cohens_d").alias("sd"), F.count(F.lit(1)).alias("n"))
    raw = 1 - F.col("sd") / F.abs("mean")
    return g.select("category", "n", F.greatest(F.lit(0.0), raw).alias("consistency"), raw.alias("raw"), F.col("mean").alias("mean_effect"), F.col("sd").alias("sd_effect"))


def batch_alerts(m: DataFrame) -> DataFrame:
    """Alerts from the ensemble's summary: severe anomalies are high, two or more anomalies medium."""
    d = details(m)
    return d.withColumn("severity", F.when(F.col("severe") > 0, "high").when(F.col("anomalies") >= 2, "medium")).where("severity IS NOT NULL").select(*KEYS, "anomalies", "severe", "severity")


def alerts(m: DataFrame) -> DataFrame:
    """Error events as alerts, with severity by value."""
    v = F.col("value")
    severity = F.when(v >= 200, "critical").when(v >= 120, "high").when(v >= 60, "medium").otherwise("low")
    return m.where("metric_type = 'error'").select("event_id", "user_id", F.col("ts").alias("created_at"), severity.alias("severity"), "value", (F.get_json_object("meta", "$.k").cast("int") % 3 == 0).alias("is_resolved"))


def alert_statistics(a: DataFrame) -> DataFrame:
    """Counts and resolution rate by severity, by person and over all, in one pass."""
    g = a.groupingSets([["severity"], ["user_id"], []], "severity", "user_id").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.count_if("is_resolved").alias("resolved"), F.countDistinct(F.to_date("created_at")).alias("days"))
    return g.select("severity", "user_id", "n", "resolved", r6(F.col("resolved") / F.col("n")).alias("resolution_rate"), r6(F.col("n") / F.col("days")).alias("per_day"))


def rate_limit(a: DataFrame, limits: dict[str, int], hours: int = 24) -> DataFrame:
    """Which alerts pass: a window opens with the first alert after the last one has expired, and lets ``limit`` through.

    Windows follow from the events before them, so each key's alerts are gone through in order; only the start and the
    count of the open window are carried along, so a key of many alerts takes no more memory than one of few.
    """
    keys = a.select("user_id", "severity", "event_id")
    rows = a.select("user_id", "severity", "event_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("t"))
    window = hours * 3_600_000_000

    def fold(batches):
        import pyarrow as pa

        key, start, count = None, None, 0
        for batch in batches:
            passed = []
            for user, severity, t in zip(*(batch.column(c).to_pylist() for c in ("user_id", "severity", "t")), strict=True):
                if key != (user, severity) or start is None or (t is not None and t - start >= window):
                    key, start, count = (user, severity), t, 0
                count += 1
                passed.append(count <= limits[severity] if severity in limits else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(passed, pa.bool_())], names=["user_id", "severity", "event_id", "passed"])

    ordered = rows.repartition("user_id", "severity").sortWithinPartitions("user_id", "severity", "t", "event_id")
    return ordered.mapInArrow(fold, keys.withColumn("passed", F.lit(None).cast("boolean")).schema)


def resolve_alerts(a: DataFrame, every: int = 4) -> DataFrame:
    """Alerts after every ``every``-th one has been resolved at the reference moment."""
    done = F.col("event_id") % every == 0
    return a.select("event_id", "user_id", "severity", (F.col("is_resolved") | done).alias("is_resolved"), F.when(done & ~F.col("is_resolved"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).alias("resolved_at"))


def correlation_alerts(sweep: DataFrame, strong: float = 0.7, level: float = 0.2) -> DataFrame:
    """Pairs that stay significant after the false discovery control and are strong."""
    return C.fdr(sweep, ["user_id"]).where((F.col("p_adjusted") <= level) & (F.abs("r") >= strong)).select("user_id", "m1", "m2", "n", "r", F.when(F.col("r") > 0, "rise").otherwise("fall").alias("direction"))


def daily_reports(m: DataFrame, days: int = 7) -> DataFrame:
    """One report row per person with a reading in the last ``days``: series, anomalies, trends, top type, confidence and a short text, in one plan."""
    last = latest(m).groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("series"))
    seen = details(m).groupBy("user_id").agg(F.sum("anomalies").alias("anomalies"), F.sum("severe").alias("severe"))
    up = linear_trend(m).groupBy("user_id").agg(F.count_if(F.col("direction") == "increasing").alias("rising"), F.count_if(F.col("direction") == "decreasing").alias("falling"))
    top = m.groupBy("user_id", "metric_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.min_by("metric_type", F.struct(-F.col("n"), "metric_type")).alias("top_type"), F.sum("n").alias("readings"))
    g = last.join(seen, "user_id", "left").join(up, "user_id", "left").join(top, "user_id").fillna(0, ["anomalies", "severe", "rising", "falling"]).where(F.col("last_ts") >= as_of() - F.expr(f"INTERVAL {days} DAYS"))
    text = F.concat(F.col("readings").cast("string"), F.lit(" readings; "), F.col("anomalies").cast("string"), F.lit(" unusual; most of "), F.col("top_type"))
    return g.select("user_id", F.to_date(F.lit("2024-01-31")).alias("report_date"), "last_ts", "series", "readings", "anomalies", "severe", "rising", "falling", "top_type", r6(F.least(F.lit(1.0), F.col("readings") / 100)).alias("confidence"), F.left(text, F.lit(306)).alias("text"))


def change_card(m: DataFrame, least: float = 5.0, k: int = 2) -> DataFrame:
    """Latest value against the mean: the ``k`` largest changes of each person above ``least`` percent."""
    mean = m.groupBy(*KEYS).agg(F.avg("value").alias("mean"))
    c = latest(m).join(mean, KEYS).withColumn("change", r6((F.col("value") - F.col("mean")) / F.col("mean") * 100)).where(F.abs("change") > least)
    w = Window.partitionBy("user_id").orderBy(F.desc(F.abs("change")), "metric_type")
    return c.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select(*KEYS, "value", r6("mean").alias("mean"), "change", "k")


def top_correlations(sweep: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` pairs of the largest absolute correlation of each person."""
    w = Window.partitionBy("user_id").orderBy(F.desc(F.round(F.abs("r"), 9)), "m1", "m2")
    return sweep.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select("user_id", "m1", "m2", "n", "r", "k")


def circadian_patterns(grid: DataFrame, keys: tuple[str, ...] = ("metric_type",)) -> DataFrame:
    """Per group of an hourly grid: peak, trough, amplitude and consistency of the hours."""
    hours = grid.groupBy(*keys, F.hour("hour").alias("h")).agg(F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("sd"))
    # an hour that comes on one day has no deviation and is behind all others
    least = lambda c: F.min_by("h", F.struct(F.col(c).isNull(), F.round(c, 9), "h"))
    g = hours.groupBy(*keys).agg(F.max_by("h", F.struct(F.round("mean", 9), -F.col("h"))).alias("peak_hour"), least("mean").alias("trough_hour"), (F.max("mean") - F.min("mean")).alias("amplitude"), F.when(F.max("sd") > 1e-9, 1 - F.avg("sd") / F.nullif(F.max("sd"), F.lit(0.0))).alias("consistency"), least("sd").alias("steadiest_hour"))
    return g.select(*keys, "peak_hour", "trough_hour", r6("amplitude").alias("amplitude"), r6("consistency").alias("consistency"), "steadiest_hour")

