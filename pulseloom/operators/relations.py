"""Joins between series: by day, by nearest time, by interval, by window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseloom.operators.aggregates import KEYS, baselines, r6
from pulseloom.functions.labels import label
from pulseloom.functions.stats import fixed, rounded_product
from pulseloom.operators.windows import latest
from pulseloom.sources.readings import as_of


def of_type(m: DataFrame, metric: str) -> DataFrame:
    return m.where(F.col("metric_type") == metric)


def daily_pairs(m: DataFrame, a: str, b: str) -> DataFrame:
    """Daily means of two types per person where both exist; one pass, no join."""
    g = m.where(F.col("metric_type").isin(a, b)).groupBy("user_id", F.to_date("ts").alias("day"))
    mean = lambda t: F.avg(F.when(F.col("metric_type") == t, F.col("value")))
    return g.agg(mean(a).alias("x"), mean(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")


def raw_pairs(m: DataFrame, a: str, b: str) -> DataFrame:
    """All readings of two types of a person on the same date."""
    side = lambda t, n: of_type(m, t).select("user_id", F.to_date("ts").alias("day"), F.col("event_id").alias(f"{n}_id"), F.col("value").alias(n))
    return side(a, "x").join(side(b, "y"), ["user_id", "day"])


def nearest(left: DataFrame, right: DataFrame, hours: float | None) -> DataFrame:
    """For each left reading the nearest right one of the person within ``hours``; of two as near, the later.

    Both sides are put in one order, and the last right reading before and the
    first one behind are carried along: no join, no pairs.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = left.select("user_id", "event_id", "value", us.alias("t"), F.lit(True).alias("of_left")).unionByName(right.select("user_id", "event_id", "value", us.alias("t"), F.lit(False).alias("of_left")))
    known = F.when(~F.col("of_left"), F.struct("t", "event_id", "value"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    rows = rows.withColumn("p", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy("user_id").orderBy(F.desc("t"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("q", F.last(known, True).over(back)).where("of_left")
    back, ahead = F.col("t") - F.col("p.t"), F.col("q.t") - F.col("t")
    pick = F.when(F.col("p").isNull() | (ahead <= back), F.col("q")).otherwise(F.col("p"))
    out = rows.select("user_id", "event_id", F.col("value").alias("x"), "t", pick.alias("r"))
    gap = F.abs(F.col("t") - F.col("r.t"))
    keep = F.lit(True) if hours is None else gap <= int(hours * 3_600_000_000)
    return out.where(F.col("r").isNotNull() & keep).select("user_id", "event_id", "x", F.col("r.value").alias("y"), r6(gap / 6e7).alias("gap_minutes"))


def exact_pairs(m: DataFrame, a: str, b: str) -> DataFrame:
    """Readings of two types of a person in the same hour stamp (means per hour)."""
    hour = lambda t, n: of_type(m, t).groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(r6(F.avg("value")).alias(n))
    return hour(a, "x").join(hour(b, "y"), ["user_id", "hour"])


def lagged_daily_join(m: DataFrame, factor: str, outcome: str, lags: tuple[int, ...] = (1, 2, 4, 6, 8, 12, 16, 24, 48)) -> DataFrame:
    """Daily sums of a factor against daily means of an outcome shifted back by each lag in hours."""
    f = of_type(m, factor).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("x"))
    o = of_type(m, outcome).withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("day", F.to_date(F.col("ts") - F.make_interval(hours=F.col("lag"))))
    return f.join(o.groupBy("user_id", "lag", "day").agg(F.avg("value").alias("y")), ["user_id", "day"])


def after_event(m: DataFrame, event: str, outcome: str, hours: int = 24) -> DataFrame:
    """Mean outcome within ``hours`` after each event: an equi-join on day buckets and a residual range."""
    e = of_type(m, event).select("event_id", "user_id", F.col("ts").alias("at"))
    days = F.sequence(F.to_date("at"), F.to_date(F.col("at") + F.expr(f"INTERVAL {hours} HOURS")))
    e = e.withColumn("day", F.explode(days))
    o = of_type(m, outcome).select("user_id", "ts", "value", F.to_date("ts").alias("day"))
    near = e.join(o, ["user_id", "day"]).where((F.col("ts") >= F.col("at")) & (F.col("ts") <= F.col("at") + F.expr(f"INTERVAL {hours} HOURS")))
    return near.groupBy("event_id", "user_id").agg(r6(F.avg("value")).alias("mean_after"), F.count(F.lit(1)).alias("n"))


def with_without(m: DataFrame, factor: str, outcome: str) -> DataFrame:
    """Outcome readings, marked by whether their date has the factor."""
    days = of_type(m, factor).select("user_id", F.to_date("ts").alias("day")).distinct().withColumn("present", F.lit(True))
    o = of_type(m, outcome).withColumn("day", F.to_date("ts"))
    return o.join(days, ["user_id", "day"], "left").select("event_id", "user_id", "day", "value", F.coalesce("present", F.lit(False)).alias("present"))


def active_users(m: DataFrame, cutoff: str) -> DataFrame:
    """People with a reading at or after the cutoff."""
    return m.select("user_id").distinct().join(m.where(F.col("ts") >= as_of(cutoff)).select("user_id"), "user_id", "left_semi")


def eligible_users(m: DataFrame, least: int = 100) -> DataFrame:
    """People with ``least`` readings or more."""
    return m.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def interventions(m: DataFrame) -> DataFrame:
    """One intervention per person: from the first signup on or after 2024-01-15 for ten days, open for every fifth."""
    first = of_type(m, "signup").where(F.col("ts") >= as_of("2024-01-15 00:00:00")).groupBy("user_id").agg(F.min("ts").alias("started_at"))
    k = F.col("user_id") % 5
    names = F.array(*[F.lit(x) for x in ("nutrition", "exercise", "sleep", "stress", "supplement")])
    return first.select("user_id", "started_at", F.when(k != 0, F.col("started_at") + F.expr("INTERVAL 10 DAYS")).alias("ended_at"), F.get(names, k.cast("int")).alias("category"), F.array(F.lit("click"), F.lit("purchase")).alias("targets"))


def overlapping(i: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs of interventions of a person that overlap, with the overlap; a null end is open."""
    far = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    a = i.select("user_id", F.col("name").alias("a"), F.col("started_at").alias("a_start"), F.coalesce("ended_at", far).alias("a_end"))
    b = other.select("user_id", F.col("name").alias("b"), F.col("started_at").alias("b_start"), F.coalesce("ended_at", far).alias("b_end"))
    both = a.join(b, "user_id").where((F.col("a") < F.col("b")) & (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end")))
    return both.select("user_id", "a", "b", F.greatest("a_start", "b_start").alias("overlap_start"), F.least("a_end", "b_end").alias("overlap_end"))


def before_after(m: DataFrame, i: DataFrame, days: int = 14) -> DataFrame:
    """Readings of an intervention's target types in the ``days`` before it, and in its course."""
    end = F.coalesce("ended_at", as_of())
    t = i.select("user_id", "started_at", end.alias("ended_at"), "category", F.explode("targets").alias("metric_type"))
    rows = m.join(t, KEYS).where((F.col("ts") >= F.col("started_at") - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts") <= F.col("ended_at")))
    return rows.select("event_id", *KEYS, "category", "started_at", "ts", "value", F.when(F.col("ts") < F.col("started_at"), "before").otherwise("after").alias("period"))


def score_against_baseline(m: DataFrame, base: DataFrame) -> DataFrame:
    """z of each reading against its baseline, and the severity that it has."""
    z = F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd"))
    rows = m.join(base.select(*KEYS, "mean", "sd", "n"), KEYS).withColumn("z", r6(z))
    return rows.select("event_id", *KEYS, "ts", "value", "z", label(F.col("z"), "severity").alias("severity"), F.col("n").alias("baseline_n"), "mean", "sd")


def anomaly_alerts(m: DataFrame, least: float = 2.0) -> DataFrame:
    """Alerts for the latest reading per person and type that is ``least`` deviations off the personal baseline."""
    scored = score_against_baseline(latest(m), baselines(m)).where(F.abs("z") >= least)
    side = F.when(F.col("z") > 0, "above").otherwise("below")
    confidence = F.least(F.lit(0.99), 0.5 + F.abs("z") / 10)
    text = F.format_string("%s is %s its baseline: %s", F.col("metric_type"), side, fixed(F.col("value"), 2))
    return scored.select("event_id", *KEYS, "ts", "value", "z", "severity", rounded_product(confidence).alias("confidence"), text.alias("message"))


def metric_pairs(d: DataFrame, on: list[str]) -> DataFrame:
    """Unordered pairs of types at the same place of ``on`` (columns metric_type, v)."""
    a = d.select(*on, F.col("metric_type").alias("m1"), F.col("v").alias("x"))
    b = d.select(*on, F.col("metric_type").alias("m2"), F.col("v").alias("y"))
    return a.join(b, on).where("m1 < m2")


def attach_outcomes(m: DataFrame, event: str) -> DataFrame:
    """Next-day means of all types, as a map in type order, for each event that has some."""
    e = of_type(m, event).select("event_id", "user_id", F.date_add(F.to_date("ts"), 1).alias("day"))
    o = m.groupBy("user_id", F.to_date("ts").alias("day"), "metric_type").agg(r6(F.avg("value")).alias("v"))
    o = o.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("metric_type", "v"))).alias("outcomes"))
    return e.join(o, ["user_id", "day"]).select("event_id", "user_id", "day", F.array_join(F.transform("outcomes", lambda s: F.concat(s.metric_type, F.lit("="), fixed(s.v, 3))), ",").alias("outcomes"))


def resolve_sender(messages: DataFrame, users: DataFrame) -> DataFrame:
    """The person of each sender address: the primary address wins over the alternates in the JSON preferences."""
    alternates = F.from_json(F.get_json_object("preferences", "$.alternates"), "array<string>")
    known = users.select("id", F.col("address"), F.lit(0).alias("rank")).unionByName(users.select("id", F.explode(alternates).alias("address"), F.lit(1).alias("rank")))
    best = known.groupBy("address").agg(F.min(F.struct("rank", "id")).alias("best"))
    return messages.join(best, "address", "left").select("message_id", "address", F.col("best.id").alias("user_id"))


def day_means(m: DataFrame) -> DataFrame:
    """Daily mean (v) per person and type."""
    return m.groupBy(*KEYS, F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))


def percent(a: Column, b: Column) -> Column:
    return (a - b) / b * 100
