"""Grouped statistics over all people at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseloom.functions.stats import t_quantile_975
from pulseloom.sources.readings import as_of

KEYS = ["user_id", "metric_type"]


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def r9(c: Column | str) -> Column:
    return F.round(c, 9)


def _recent(days: int, back: int = 0) -> Column:
    """Whether ts lies in the ``days`` before ``as_of`` less ``back`` days."""
    end = as_of() - F.expr(f"INTERVAL {back} DAYS")
    return (F.col("ts") >= end - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts") < end)


def metric_aggregate(m: DataFrame) -> DataFrame:
    """avg, min, max, sum, count and latest value per person and type."""
    return m.groupBy(*KEYS).agg(
        r6(F.avg("value")).alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        r6(F.sum("value")).alias("sum_value"), F.count("value").alias("n"), F.max_by("value", F.struct("ts", "event_id")).alias("latest"),
    )


def availability(m: DataFrame, days: int = 7) -> DataFrame:
    """Count, first, last, days covered and range per person and type over the last days."""
    return m.where(_recent(days)).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        (F.datediff(F.max("ts"), F.min("ts")) + 1).alias("days_covered"),
        r6(F.avg("value")).alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
    )


def with_mad(m: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Median, and the scaled median absolute deviation, per group: two passes joined on the median."""
    med = m.groupBy(*keys).agg(F.median("value").alias("median"))
    return m.join(med, keys).groupBy(*keys).agg(F.max("median").alias("median"), (F.median(F.abs(F.col("value") - F.col("median"))) * 1.4826).alias("mad"))


def winsorized_mean(m: DataFrame, share: float = 0.05, keys: list[str] = KEYS) -> DataFrame:
    """Mean after the lowest and highest k = floor(share n) values are clamped to the next ones."""
    w = Window.partitionBy(*keys)
    ranked = m.withColumn("k", F.row_number().over(w.orderBy("value", "event_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    ranked = ranked.withColumn("cut", F.floor(F.col("n") * share))
    low = F.max(F.when(F.col("k") == F.col("cut") + 1, F.col("value"))).over(w)
    high = F.max(F.when(F.col("k") == F.col("n") - F.col("cut"), F.col("value"))).over(w)
    clamped = ranked.withColumn("clamped", F.least(F.greatest("value", low), high))
    return clamped.groupBy(*keys).agg(r6(F.avg("clamped")).alias("winsorized_mean"))


def metric_statistics(m: DataFrame) -> DataFrame:
    """Descriptive and robust statistics per person and type; consistency is 1 - sd / |mean|."""
    base = m.groupBy(*KEYS).agg(
        F.count("value").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("sd"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        r6(F.percentile("value", F.lit(0.25))).alias("q1"), r6(F.percentile("value", F.lit(0.75))).alias("q3"),
        r6(F.percentile("value", F.lit(0.75)) - F.percentile("value", F.lit(0.25))).alias("iqr"),
        r6(F.greatest(F.lit(0.0), 1 - F.stddev_samp("value") / F.abs(F.avg("value")))).alias("consistency"),
    )
    robust = with_mad(m).select(*KEYS, r6("median").alias("median"), r6("mad").alias("mad"))
    return base.join(robust, KEYS).join(winsorized_mean(m), KEYS)


def hourly_pattern(m: DataFrame) -> DataFrame:
    """Mean, sd and count per person, type and hour."""
    return m.groupBy(*KEYS, F.hour("ts").alias("hour")).agg(r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("sd"), F.count(F.lit(1)).alias("n"))


def weekly_pattern(m: DataFrame) -> DataFrame:
    """Mean, sd and count per person, type and weekday (0 is Monday)."""
    return m.groupBy(*KEYS, F.weekday("ts").alias("weekday")).agg(r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("sd"), F.count(F.lit(1)).alias("n"))


def circadian_context(m: DataFrame, least: int = 2) -> DataFrame:
    """Per type: peak hour, spread of the hourly means and regularity, over hours with ``least`` readings."""
    hours = m.groupBy("metric_type", F.hour("ts").alias("hour")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return hours.groupBy("metric_type").agg(
        F.max_by("hour", F.struct(F.round("mean", 9), -F.col("hour"))).alias("peak_hour"), F.count(F.lit(1)).alias("hours"),
        r6(F.stddev_pop("mean")).alias("spread"), r6(F.greatest(F.lit(0.0), 1 - F.stddev_pop("mean") / F.abs(F.avg("mean")))).alias("regularity"),
        r6(F.avg(F.greatest(F.lit(0.0), 1 - F.col("sd") / F.abs("mean")))).alias("peak_consistency"),
    )


def daily_pattern(m: DataFrame) -> DataFrame:
    """Per type: hours of the highest and lowest mean, and means of four parts of the day (ends overlap)."""
    hours = m.groupBy("metric_type", F.hour("ts").alias("hour")).agg(F.avg("value").alias("mean"))
    ends = hours.groupBy("metric_type").agg(F.max_by("hour", F.struct(F.round("mean", 9), -F.col("hour"))).alias("peak_hour"), F.min_by("hour", F.struct(F.round("mean", 9), "hour")).alias("lowest_hour"))
    h = F.hour("ts")
    part = lambda test, name: r6(F.avg(F.when(test, F.col("value")))).alias(name)
    parts = m.groupBy("metric_type").agg(part(h.between(6, 12), "morning"), part(h.between(12, 18), "afternoon"), part(h.between(18, 22), "evening"), part((h >= 22) | (h <= 6), "overnight"))
    return ends.join(parts, "metric_type")


def weekend_effect(m: DataFrame) -> DataFrame:
    """Weekday and weekend means per person and type, with difference and percent."""
    end = F.weekday("ts") >= 5
    g = m.groupBy(*KEYS).agg(F.avg(F.when(~end, F.col("value"))).alias("a"), F.avg(F.when(end, F.col("value"))).alias("b"))
    return g.select(*KEYS, r6("a").alias("weekday_mean"), r6("b").alias("weekend_mean"), r6(F.col("b") - F.col("a")).alias("difference"), r6((F.col("b") - F.col("a")) / F.col("a") * 100).alias("percent"))


def period_vs_typical(m: DataFrame) -> DataFrame:
    """The last two days against all before: mean, range, difference in percent."""
    now = _recent(2)
    g = m.groupBy(*KEYS).agg(
        F.avg(F.when(now, F.col("value"))).alias("a"), F.min(F.when(now, F.col("value"))).alias("recent_min"), F.max(F.when(now, F.col("value"))).alias("recent_max"),
        F.avg(F.when(~now, F.col("value"))).alias("b"),
    )
    return g.where(F.col("a").isNotNull()).select(*KEYS, r6("a").alias("recent_mean"), "recent_min", "recent_max", r6("b").alias("typical_mean"), r6((F.col("a") - F.col("b")) / F.col("b") * 100).alias("percent"))


def weekly_averages(m: DataFrame) -> DataFrame:
    """Mean and count per person, type and week (from Monday), and the change from the first to the last week."""
    weeks = m.groupBy(*KEYS, F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*KEYS)
    change = F.max_by("mean", "week").over(w) - F.min_by("mean", "week").over(w)
    return weeks.select(*KEYS, "week", r6("mean").alias("mean"), "n", r6(change).alias("change"))


def trend_card(m: DataFrame, days: int = 15) -> DataFrame:
    """The last ``days`` against the ``days`` before: means, range, sd, and slope over the row number."""
    rows = m.where(_recent(days)).withColumn("k", F.row_number().over(Window.partitionBy(*KEYS).orderBy("ts", "event_id")))
    now = rows.groupBy(*KEYS).agg(r6(F.avg("value")).alias("mean"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), r6(F.stddev_samp("value")).alias("sd"), r6(F.regr_slope("value", "k")).alias("slope"))
    before = m.where(_recent(days, days)).groupBy(*KEYS).agg(r6(F.avg("value")).alias("previous_mean"))
    return now.join(before, KEYS, "left")


def ingestion_audit(m: DataFrame) -> DataFrame:
    """Per type: days, readings per day, nulls, future stamps and repeated keys."""
    key = F.struct("user_id", "metric_type", "ts")
    return m.groupBy("metric_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.to_date("ts")).alias("days"), r6(F.count(F.lit(1)) / F.countDistinct(F.to_date("ts"))).alias("per_day"),
        F.count_if(F.col("value").isNull()).alias("nulls"), F.count_if(F.col("ts") > as_of()).alias("future"), (F.count(F.lit(1)) - F.countDistinct(key)).alias("repeated"),
    )


def type_distribution(m: DataFrame) -> DataFrame:
    """Count and share of each type."""
    return m.groupBy("metric_type").agg(F.count(F.lit(1)).alias("n")).withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


def system_statistics(m: DataFrame) -> DataFrame:
    """Readings and active people over one, seven and thirty days, in one scan."""
    out = []
    for days in (1, 7, 30):
        out += [F.count_if(_recent(days)).alias(f"readings_{days}d"), F.countDistinct(F.when(_recent(days), F.col("user_id"))).alias(f"users_{days}d")]
    return m.agg(*out, F.count(F.lit(1)).alias("readings"))


def series_quality(m: DataFrame) -> DataFrame:
    """Evenness of the gaps (three variants), completeness against a reading an hour, and the median gap in seconds."""
    w = Window.partitionBy(*KEYS).orderBy("ts", "event_id")
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    gaps = m.withColumn("gap", sec("ts") - F.lag(sec("ts")).over(w))
    g = gaps.groupBy(*KEYS).agg(F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"), F.median("gap").alias("mid"), F.count(F.lit(1)).alias("n"), (F.max(sec("ts")) - F.min(sec("ts"))).alias("span"))
    cv = F.col("sd") / F.col("mean")
    return g.where("n >= 3").select(
        *KEYS, r6(F.greatest(F.lit(0.0), 1 - cv / 2)).alias("evenness"), r6(F.greatest(F.lit(0.0), 1 - cv)).alias("strict_evenness"),
        r6(F.greatest(F.lit(0.0), 1 - F.col("sd") / F.col("mid"))).alias("median_evenness"),
        r6(F.least(F.lit(1.0), F.col("n") / (F.col("span") / 3600 + 1))).alias("completeness"), r6("mid").alias("interval_seconds"),
    )


def percentile_of_score(m: DataFrame, least: int = 10) -> DataFrame:
    """Percentile rank of each reading among those of its person and type: mean of the shares below and up to it; 50 for few."""
    w = Window.partitionBy(*KEYS)
    below = F.rank().over(w.orderBy("value")) - 1
    up_to = F.count(F.lit(1)).over(w.orderBy("value").rangeBetween(Window.unboundedPreceding, 0))
    n = F.count(F.lit(1)).over(w)
    return m.select("event_id", *KEYS, "value", F.when(n < least, 50.0).otherwise(r6((below + up_to + 1) * 50 / n)).alias("percentile_rank"))


def user_profile(m: DataFrame) -> DataFrame:
    """Tenure, points per day, engagement band and quality score of each person."""
    g = m.groupBy("user_id").agg(F.min("ts").alias("since"), F.count(F.lit(1)).alias("n"), F.countDistinct("metric_type").alias("types"))
    days = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("since"))
    per_day = F.col("n") / days
    return g.select(
        "user_id", days.alias("tenure_days"), "n", r6(per_day).alias("per_day"), F.when(per_day >= 5, "high").when(per_day >= 2, "medium").otherwise("low").alias("engagement"),
        r6(F.least(F.lit(1.0), F.col("types") / 15.0)).alias("quality"),
    )


def pattern(m: DataFrame, key: Column, name: str) -> DataFrame:
    """Per person and type a map from ``key`` (an hour, a weekday) to mean, sd and number of readings."""
    g = m.where("value IS NOT NULL").groupBy(*KEYS, key.cast("int").alias("key")).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))
    return g.groupBy(*KEYS).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.struct("mean", "sd", "n").alias("value"))))).alias(name))


def baselines(m: DataFrame, least: int = 3, patterns: bool = False) -> DataFrame:
    """Personal baseline per person and type: moments, robust spread, and Student's 95 % interval of the mean.

    With ``patterns`` also the circadian and the weekly pattern, as maps from the
    hour and from the weekday (0 is Monday).
    """
    g = m.groupBy(*KEYS).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.percentile("value", F.lit(0.25)).alias("q1"), F.percentile("value", F.lit(0.75)).alias("q3"),
    ).where(F.col("n") >= least)
    half = t_quantile_975(F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    out = g.join(with_mad(m), KEYS)
    own = ["n", "mean", "sd", "median", "mad", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high")]
    if patterns:
        out = out.join(pattern(m, F.hour("ts"), "circadian_pattern"), KEYS, "left").join(pattern(m, F.weekday("ts"), "weekly_pattern"), KEYS, "left")
        own += ["circadian_pattern", "weekly_pattern"]
    return out.select(*KEYS, *own)


def _known_hours(m: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Hourly means per group of ``keys`` with the hours (``start`` to ``stop``) of the complete grid that each one stands for: up to the next, the first one also for those before it.

    A group whose means are all null has one row of them. People's groups stay with
    the person, so what is made of a person's rows needs no other exchange, and
    the grid itself is never shuffled.
    """
    hours = m.groupBy(*keys, F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("mean"))
    if "user_id" in keys:
        hours = hours.repartition("user_id")
    w, known = Window.partitionBy(*keys), F.col("mean").isNotNull()
    rows = hours.withColumn("a", F.min("hour").over(w)).withColumn("b", F.max("hour").over(w)).withColumn("any", F.max(known).over(w))
    rows = rows.where(known | (~F.col("any") & (F.col("hour") == F.col("a"))))
    o, one = w.orderBy("hour"), F.expr("INTERVAL 1 HOUR")
    rows = rows.withColumn("q_hour", F.lead("hour").over(o)).withColumn("q_mean", F.lead("mean").over(o))
    start = F.when(F.lag("hour").over(o).isNull(), F.col("a")).otherwise(F.col("hour"))
    return rows.withColumn("start", start).withColumn("stop", F.coalesce(F.col("q_hour") - one, F.col("b"))).withColumnRenamed("hour", "p_hour")


def resample_hourly(m: DataFrame, keys: tuple[str, ...] = ("metric_type",)) -> DataFrame:
    """Hourly means per group of ``keys`` (types; with KEYS each person's) on a complete grid of hours, filled forward, then backward."""
    return _known_hours(m, keys).select(*keys, F.explode(F.expr("sequence(start, stop, INTERVAL 1 HOUR)")).alias("hour"), "mean")


def resample_linear(m: DataFrame, keys: tuple[str, ...] = ("metric_type",)) -> DataFrame:
    """Hourly means per group of ``keys`` on a complete grid of hours, with linear interpolation; null where no mean is known before or behind."""
    rows = _known_hours(m, keys).withColumn("hour", F.explode(F.expr("sequence(start, stop, INTERVAL 1 HOUR)")))
    h = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 3.6e9
    between = F.col("mean") + (F.col("q_mean") - F.col("mean")) * (h("hour") - h("p_hour")) / (h("q_hour") - h("p_hour"))
    return rows.select(*keys, "hour", F.when(F.col("hour") == F.col("p_hour"), F.col("mean")).when(F.col("hour") > F.col("p_hour"), between).alias("mean"))


def daily_features(m: DataFrame, least: int = 12) -> DataFrame:
    """Per type and day with ``least`` hours of data: mean, sd, max and min of the hourly means."""
    hours = m.groupBy("metric_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("mean"))
    days = hours.groupBy("metric_type", F.to_date("hour").alias("day")).agg(F.count(F.lit(1)).alias("hours"), r6(F.avg("mean")).alias("mean"), r6(F.stddev_samp("mean")).alias("sd"), r6(F.max("mean")).alias("max_value"), r6(F.min("mean")).alias("min_value"))
    return days.where(F.col("hours") >= least)
