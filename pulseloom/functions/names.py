"""Logical metric names, their stored types in two tiers, and event categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Logical name, unit, stored types that count first, and those that count where the first have no readings.
METRICS = (
    ("heart_rate", "bpm", ("heart_rate", "resting_heart_rate", "hr"), ("avg_heart_rate", "sleep_hr")),
    ("resting_heart_rate", "bpm", ("resting_heart_rate", "sleep_rhr", "night_rhr"), ("heart_rate",)),
    ("hrv", "ms", ("hrv", "heart_rate_variability"), ("avg_sleep_hrv", "sleep_hrv")),
    ("avg_sleep_hrv", "ms", ("avg_sleep_hrv", "sleep_hrv"), ("hrv",)),
    ("sleep_score", "score", ("sleep_score",), ("total_sleep_score", "sleep_quality")),
    ("sleep_efficiency", "%", ("sleep_efficiency",), ("sleep_score",)),
    ("total_sleep_seconds", "seconds", ("total_sleep_seconds", "sleep_duration"), ("duration_seconds",)),
    ("time_in_bed_seconds", "seconds", ("time_in_bed_seconds",), ("total_sleep_seconds",)),
    ("deep_sleep", "seconds", ("deep_sleep_seconds", "deep_sleep_minutes"), ("deep_sleep_percentage",)),
    ("light_sleep", "seconds", ("light_sleep_seconds", "light_sleep_minutes"), ("light_sleep_percentage",)),
    ("rem_sleep", "seconds", ("rem_sleep_seconds", "rem_sleep_minutes"), ("rem_sleep_percentage",)),
    ("awake_stage", "seconds", ("awake_seconds", "awake_minutes"), ("awake_percentage",)),
    ("recovery", "score", ("recovery", "recovery_score", "recovery_index"), ("readiness", "wellness_score")),
    ("movement_index", "index", ("movement_index", "activity_score"), ("active_minutes",)),
    ("temperature", "°C", ("temperature", "body_temperature", "temp"), ("skin_temperature",)),
    ("steps", "steps", ("steps", "step_count"), ("daily_steps",)),
    ("active_minutes", "minutes", ("active_minutes", "activity_minutes"), ("movement_minutes",)),
    ("calories_burned", "kcal", ("calories_burned", "calories"), ("energy_expenditure",)),
    ("vo2_max", "ml/kg/min", ("vo2_max", "vo2max"), ("cardio_fitness",)),
    ("stress", "index", ("stress", "stress_index", "stress_score"), ("hrv_stress",)),
    ("glucose", "mg/dL", ("glucose", "blood_glucose"), ("average_glucose",)),
    ("average_glucose", "mg/dL", ("average_glucose", "glucose_average"), ("glucose",)),
    ("glucose_variability", "CV%", ("glucose_variability", "glycemic_variability"), ()),
    ("hba1c", "%", ("hba1c", "a1c"), ()),
    ("time_in_target", "%", ("time_in_target", "time_in_range"), ()),
    ("metabolic_score", "score", ("metabolic_score",), ("glucose_score",)),
)
#: logical, raw, tier, unit
NAMES = tuple((logical, raw, tier, unit) for logical, unit, first, second in METRICS for tier, types in (("primary", first), ("fallback", second)) for raw in types)
SQL = "SELECT * FROM (VALUES " + ", ".join(str(n) for n in NAMES) + ") AS t(logical, raw, tier, unit)"
#: All stored types.
TYPES = tuple(dict.fromkeys(raw for _, raw, _, _ in NAMES))

#: Category and the words that a type of it has, the first one counts; least values of a high and a medium intensity.
CATEGORIES = (
    ("supplement", "supplement|magnesium|vitamin|omega", 300, 100),
    ("nutrition", "meal|food|chicken|calorie|protein|coffee|tea|caffeine|alcohol", 100, 40),
    ("exercise", "exercise|running|walking|workout|steps", 60, 20),
    ("stress", "stress|meditation|mood", 60, 20),
    ("sleep", "sleep|bed|nap", 60, 20),
)


def table(spark) -> DataFrame:
    """The names as a table of a few rows."""
    return spark.createDataFrame(list(NAMES), "logical string, raw string, tier string, unit string")


def resolve(m: DataFrame) -> DataFrame:
    """The logical names of each reading."""
    n = F.broadcast(table(m.sparkSession))  # NAMES has a fixed number of rows
    return m.join(n, m["metric_type"] == n["raw"]).select("event_id", "logical", "tier", "unit")


def with_fallback(m: DataFrame, since: str = "2024-01-26 00:00:00") -> DataFrame:
    """Mean per person and logical name over the primary types; over the fallback types where these have none."""
    n = F.broadcast(table(m.sparkSession))
    rows = m.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz")).join(n, m["metric_type"] == n["raw"])
    mean = lambda t: F.avg(F.when(F.col("tier") == t, F.col("value")))
    g = rows.groupBy("user_id", "logical").agg(mean("primary").alias("p"), mean("fallback").alias("q"))
    return g.select("user_id", "logical", F.round(F.coalesce("p", "q"), 6).alias("value"), F.when(F.col("p").isNull(), "fallback").otherwise("primary").alias("tier"))


def _ladder(value: Column, high: int, medium: int) -> Column:
    return F.when(value >= high, "high").when(value >= medium, "medium").otherwise("low")


def categorise(rows: DataFrame) -> DataFrame:
    """(id, line_no, metric_type, value): the category of each row's type, and the intensity of its value in that category."""
    category, intensity = F.lit("other"), _ladder(F.col("value"), 60, 20)
    for name, words, high, medium in reversed(CATEGORIES):
        test = F.col("metric_type").rlike(words)
        category, intensity = F.when(test, name).otherwise(category), F.when(test, _ladder(F.col("value"), high, medium)).otherwise(intensity)
    return rows.select("id", "line_no", "metric_type", category.alias("category"), intensity.alias("intensity"))


_BAND = "CASE WHEN value >= {} THEN 'high' WHEN value >= {} THEN 'medium' ELSE 'low' END"
CATEGORY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(metric_type, '{words}') THEN '{name}'" for name, words, _, _ in CATEGORIES) + " ELSE 'other' END"
INTENSITY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(metric_type, '{words}') THEN {_BAND.format(high, medium)}" for _, words, high, medium in CATEGORIES) + f" ELSE {_BAND.format(60, 20)} END"
