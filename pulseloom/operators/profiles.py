"""Roll-ups of habits, sleep, delivery, learning and reports."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseloom.functions.stats import corr, rounded_product
from pulseloom.operators.aggregates import KEYS, r6


def multi_scale_corr(pairs: DataFrame, widths: tuple[int, ...] = (1, 3, 7, 14)) -> DataFrame:
    """Correlation of daily x and y per person after means over buckets of each width, aligned to the first day."""
    first = F.min("day").over(Window.partitionBy("user_id"))
    rows = pairs.withColumn("first", first).withColumn("width", F.explode(F.array(*map(F.lit, widths)))).withColumn("bucket", F.floor(F.datediff("day", "first") / F.col("width")))
    b = rows.groupBy("user_id", "width", "bucket").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    g = b.groupBy("user_id", "width").agg(F.count(F.lit(1)).alias("n"), corr("x", "y").alias("r"))
    return g.where("n >= 4 AND r IS NOT NULL AND NOT isnan(r)").select("user_id", "width", "n", r6("r").alias("r"))


def delivery_stats(logs: DataFrame) -> DataFrame:
    """(user_id, created_at, context as JSON with status and error): sent, limited, failed, success rate, commonest error."""
    status = F.get_json_object("context", "$.status")
    error = F.get_json_object("context", "$.error")
    rows = logs.select("user_id", "created_at", status.alias("status"), error.alias("error"))
    g = rows.groupBy("user_id").agg(
        F.count_if(F.col("status") == "sent").alias("sent"), F.count_if(F.col("status") == "rate_limited").alias("limited"), F.count_if(F.col("status") == "failed").alias("failed"),
        r6(F.count_if(F.col("status") == "sent") / F.count(F.lit(1))).alias("success_rate"), F.max(F.when(F.col("status") == "sent", F.col("created_at"))).alias("last_sent"),
    )
    e = rows.where("error IS NOT NULL").groupBy("user_id", "error").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.min_by("error", F.struct(-F.col("n"), "error")).alias("top_error"))
    return g.join(e, "user_id", "left")


def nutrition_summary(meals: DataFrame) -> DataFrame:
    """(user_id, ts, nutrition as JSON): totals, means per meal and per day."""
    j = F.from_json("nutrition", "struct<calories:double,protein:double>")
    rows = meals.select("user_id", F.to_date("ts").alias("day"), j.alias("j")).select("user_id", "day", "j.*")
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("meals"), r6(F.sum("calories")).alias("calories"), r6(F.sum("protein")).alias("protein"), r6(F.avg("calories")).alias("calories_per_meal"), r6(F.sum("calories") / F.countDistinct("day")).alias("calories_per_day"),
    )


def clock(hour: Column) -> Column:
    """A decimal hour as HH:MM."""
    minutes = F.floor(hour * 60 + 1e-9)
    return F.concat(F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def means_in_order(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per person: nights, and mean and spread of ``columns`` as one pass in the order of event_id (if there is one) gives them.

    Means of hours of six digits often end in an exact half at the seventh, which the order of a sum moves up or down.
    Rows come sorted and are folded as they pass, so that no person's rows are gathered.
    """
    kind = rows.schema["user_id"].dataType.simpleString()
    names = [f"{c}_{what}" for c in columns for what in ("mean", "spread")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user = nights = state = None

        def row() -> tuple:
            return user, nights, *(v for n, total, _, squares in state for v in ((total / n, math.sqrt(squares / n)) if n else (None, None)))

        for batch in batches:
            out = []
            for key, *values in zip(*(batch.column(c).to_pylist() for c in ["user_id", *columns]), strict=True):
                if state is None or key != user:
                    if state is not None:
                        out.append(row())
                    user, nights, state = key, 0, [(0, 0.0, 0.0, 0.0) for _ in columns]
                nights += 1
                for k, v in enumerate(values):
                    if v is not None:
                        n, total, mean, squares = state[k]
                        after = mean + (v - mean) / (n + 1)
                        state[k] = n + 1, total + v, after, squares + (v - after) * (v - mean)
            yield table(out, batch.schema.field("user_id").type)
        if state is not None:
            yield table([row()], batch.schema.field("user_id").type)

    def table(out: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        kinds = [key, pa.int64(), *[pa.float64()] * len(names)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["user_id", "nights", *names])

    order = [c for c in ("event_id",) if c in rows.columns]
    dealt = rows.select("user_id", *order, *columns).repartition("user_id").sortWithinPartitions("user_id", *order).select("user_id", *columns)
    return dealt.mapInArrow(fold, f"user_id {kind}, nights long, " + ", ".join(f"{n} double" for n in names))


def sleep_schedule(rows: DataFrame) -> DataFrame:
    """(user_id, bed_hour, wake_hour, event_id if sums have an order): plain means, spreads, and times as text."""
    g = means_in_order(rows, ["bed_hour", "wake_hour"])
    b, w, bs, ws = (rounded_product(F.col(c)) for c in ("bed_hour_mean", "wake_hour_mean", "bed_hour_spread", "wake_hour_spread"))
    return g.select("user_id", "nights", b.alias("bed_mean"), w.alias("wake_mean"), bs.alias("bed_spread"), ws.alias("wake_spread"), clock(b).alias("bed_clock"), clock(w).alias("wake_clock"))


def bedtime_mean(rows: DataFrame) -> DataFrame:
    """(user_id, bed_hour, event_id if sums have an order): mean with hours before noon counted as of the night before, modulo 24."""
    shifted = F.when(F.col("bed_hour") < 12, F.col("bed_hour") + 24).otherwise(F.col("bed_hour"))
    g = means_in_order(rows.withColumn("shifted", shifted), ["shifted"])
    return g.select("user_id", rounded_product(F.pmod(F.col("shifted_mean"), F.lit(24.0))).alias("bed_mean"), "nights")


def stage_card(m: DataFrame, since: str) -> DataFrame:
    """Per person and type: mean over all and since a moment, range, and the last reading."""
    recent = F.col("ts") >= F.lit(since).cast("timestamp_ntz")
    return m.groupBy(*KEYS).agg(r6(F.avg("value")).alias("mean"), r6(F.avg(F.when(recent, F.col("value")))).alias("recent_mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


def habits(m: DataFrame, days: int = 30) -> DataFrame:
    """Per person: meal (purchase) hour, its spread and late count; supplement (signup) days; exercise (view) frequency."""
    h = F.hour("ts") + F.minute("ts") / 60
    on = lambda t, c: F.when(F.col("metric_type") == t, c)
    return m.groupBy("user_id").agg(
        r6(F.avg(on("purchase", h))).alias("meal_hour"), r6(F.stddev_pop(on("purchase", h))).alias("meal_spread"), F.count_if((F.col("metric_type") == "purchase") & (F.hour("ts") >= 20)).alias("late_meals"),
        r6(F.countDistinct(on("signup", F.to_date("ts"))) / days).alias("adherence"), F.count_if(F.col("metric_type") == "view").alias("workouts"), r6(F.count_if(F.col("metric_type") == "view") / days * 7).alias("workouts_per_week"),
    )


#: Least score and name of each stage of learning.
STAGES = ((0.8, "expert", None), (0.6, "advanced", 0.8), (0.4, "developing", 0.6), (0.2, "beginning", 0.4), (0.0, "initial", 0.2))


def learning_status(m: DataFrame) -> DataFrame:
    """Weighted score of data richness, stability, responsiveness and regularity; stage and next milestone."""
    g = m.groupBy("user_id").agg(
        F.least(F.lit(1.0), F.count(F.lit(1)) / 100).alias("richness"), F.greatest(F.lit(0.0), 1 - F.stddev_pop("value") / F.avg("value")).alias("stability"),
        F.least(F.lit(1.0), F.countDistinct("metric_type") / 5).alias("responsiveness"), (F.countDistinct(F.to_date("ts")) / 30).alias("regularity"),
    )
    score = F.round(0.3 * F.col("richness") + 0.3 * F.col("stability") + 0.2 * F.col("responsiveness") + 0.2 * F.col("regularity"), 6)
    stage = nxt = None
    for least, name, following in STAGES:
        test = score >= least
        stage = F.when(test, name) if stage is None else stage.when(test, name)
        nxt = F.when(test, F.lit(following).cast("double")) if nxt is None else nxt.when(test, F.lit(following))
    return g.select("user_id", score.alias("score"), stage.alias("stage"), nxt.alias("next_milestone"))


def intervention_history(scores: DataFrame) -> DataFrame:
    """(user_id, metric_type, category, effectiveness): successes, mean, best category, and a preference score of each person."""
    g = scores.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n"), F.avg("effectiveness").alias("mean"), F.count_if(F.col("effectiveness") >= 60).alias("wins"))
    h = g.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("wins").alias("wins"), F.max_by("category", F.struct(F.round("mean", 6), "category")).alias("best_category"), F.avg("mean").alias("mean"))
    return h.select("user_id", "n", "wins", "best_category", r6("mean").alias("mean_effectiveness"), r6(F.col("wins") / F.col("n")).alias("preference"))


def report_evolution(reports: DataFrame, last: int = 30) -> DataFrame:
    """(user_id, at, id, kind, confidence): of the last reports, kinds, confidence of the newer against the older half, and slope."""
    w = Window.partitionBy("user_id")
    rows = reports.withColumn("k", F.row_number().over(w.orderBy(F.desc("at"), F.desc("id")))).where(F.col("k") <= last)
    rows = rows.withColumn("half", F.ntile(2).over(w.orderBy("at", "id"))).withColumn("i", F.row_number().over(w.orderBy("at", "id")))
    mean = lambda k: F.avg(F.when(F.col("half") == k, F.col("confidence")))
    return rows.groupBy("user_id").agg(F.countDistinct("kind").alias("kinds"), r6(mean(1)).alias("older"), r6(mean(2)).alias("newer"), r6(F.when(F.count(F.lit(1)) > 1, F.regr_slope("confidence", "i"))).alias("slope"))


def rank_recommendations(rows: DataFrame, k: int = 3) -> DataFrame:
    """(user_id, kind, confidence, preference, success): the ``k`` of largest confidence x (1 + preference) x success."""
    score = F.round(F.col("confidence") * (1 + F.col("preference")) * F.col("success"), 6)
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "kind")
    return rows.withColumn("score", score).withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select("user_id", "kind", "score", "k")


def compose_text(parts: DataFrame, most: int = 306) -> DataFrame:
    """(user_id, rank, text): the first three texts in order, joined, cut to ``most`` characters with an ellipsis."""
    g = parts.groupBy("user_id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "text"))), 1, 3), lambda s: s.text), " ").alias("text"))
    return g.select("user_id", F.when(F.length("text") > most, F.concat(F.left("text", F.lit(most - 1)), F.lit("…"))).otherwise(F.col("text")).alias("text"))


def confidence_factors(m: DataFrame) -> DataFrame:
    """Per person: five factors of the confidence in an analysis, their mean, level and advice."""
    g = m.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("metric_type").alias("types"), F.countDistinct(F.to_date("ts")).alias("days"), F.stddev_pop("value").alias("sd"), F.avg("value").alias("mean"))
    parts = [F.least(F.lit(1.0), F.col("n") / 100), F.col("types") / 5, F.least(F.lit(1.0), F.col("days") / 30), F.greatest(F.lit(0.0), 1 - F.col("sd") / F.col("mean") / 2), F.when(F.col("n") >= 30, 1.0).otherwise(F.col("n") / 30)]
    mean = F.round(sum(parts[1:], parts[0]) / 5, 6)
    level = F.when(mean >= 0.8, "high").when(mean >= 0.6, "medium").otherwise("low")
    return g.select("user_id", "n", (F.col("n") >= 30).alias("enough"), mean.alias("confidence"), level.alias("level"), F.when(level == "low", "collect more data").when(level == "medium", "use with care").otherwise("use").alias("advice"))
