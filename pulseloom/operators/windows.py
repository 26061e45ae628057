"""Ordered windows within each person's series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pulseloom.functions.stats import corr
from pulseloom.operators.aggregates import KEYS, r6


def series():
    """Each person's readings of a type in order of time."""
    return Window.partitionBy(*KEYS).orderBy("ts", "event_id")


def reversed_series():
    """The same, from the newest on: what comes behind a row is what has been seen before it in this order."""
    return Window.partitionBy(*KEYS).orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)


def latest(m: DataFrame) -> DataFrame:
    """The latest reading per person and type, without a sort."""
    return m.groupBy(*KEYS).agg(F.max_by(F.struct("event_id", "ts", "value"), F.struct("ts", "event_id")).alias("x")).select(*KEYS, "x.event_id", "x.ts", "x.value")


def last_n(m: DataFrame, n: int = 3) -> DataFrame:
    """The last n readings per person and type, numbered from the newest."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("ts"), F.desc("event_id"))
    return m.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).select("event_id", *KEYS, "ts", "value", "k")


def gaps(m: DataFrame, hours: float = 25) -> DataFrame:
    """Pairs of consecutive readings more than ``hours`` apart."""
    g = m.withColumn("previous", F.lag("ts").over(series()))
    span = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("previous").cast("timestamp"))) / 3.6e9
    return g.withColumn("gap_hours", r6(span)).where(F.col("gap_hours") > hours).select(*KEYS, "previous", "ts", "gap_hours")


def lag_roll_features(m: DataFrame) -> DataFrame:
    """Lags 1, 2, 3 and 7, and trailing means and deviations over 3 and 7 rows (null until full)."""
    out = [F.lag("value", k).over(series()).alias(f"lag_{k}") for k in (1, 2, 3, 7)]
    for n in (3, 7):
        w = series().rowsBetween(-(n - 1), 0)
        full = F.count("value").over(w) == n
        out += [r6(F.when(full, F.avg("value").over(w))).alias(f"mean_{n}"), r6(F.when(full, F.stddev_samp("value").over(w))).alias(f"sd_{n}")]
    return m.select("event_id", *KEYS, "value", *out)


def rolling_centered(m: DataFrame, n: int = 5) -> DataFrame:
    """Centred mean and deviation over n rows; the ends take the nearest full window."""
    before, after = n // 2, n - n // 2 - 1
    w = series().rowsBetween(-before, after)
    full = F.count("value").over(w) == n
    rows = m.withColumn("mean", F.when(full, F.avg("value").over(w))).withColumn("sd", F.when(full, F.stddev_samp("value").over(w)))
    ahead, behind = series().rowsBetween(Window.unboundedPreceding, 0), reversed_series()
    fill = lambda c: F.coalesce(F.last(c, True).over(ahead), F.last(c, True).over(behind))
    return rows.select("event_id", *KEYS, "ts", "value", fill("mean").alias("mean"), fill("sd").alias("sd"))


def with_others(rows: DataFrame, most: int = 10, part: int = 3) -> DataFrame:
    """``rows`` (of which values aren't null) with k (place), n, w, mean and sd of the other readings of the window of each; mean and sd are null where w is below 3."""
    own = Window.partitionBy(*KEYS)
    rows = rows.withColumn("k", F.row_number().over(series())).withColumn("n", F.count(F.lit(1)).over(own).cast("int"))
    rows = rows.withColumn("w", F.least(F.lit(most), F.floor(F.col("n") / part).cast("int")))
    near = F.collect_list("value").over(series().rowsBetween(1 - most, most - 1))
    start = F.greatest(F.lit(1), F.least(F.col("k") - F.floor(F.col("w") / 2).cast("int"), F.col("n") - F.col("w") + 1))
    first = F.greatest(F.lit(1), F.col("k") - most + 1)  # the row of the first of ``near``
    rows = rows.withColumn("near", near).withColumn("start", start).withColumn("own", F.when(F.col("w") >= 3, F.slice("near", F.col("start") - first + 1, F.col("w"))))
    rows = rows.withColumn("others", F.filter("own", lambda _, i: i != F.col("k") - F.col("start")))
    rows = rows.withColumn("mean", F.aggregate("others", F.lit(0.0), lambda a, x: a + x) / (F.col("w") - 1))
    sd = F.sqrt(F.aggregate("others", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.nullif(F.col("w") - 2, F.lit(0)))
    return rows.withColumn("sd", sd).drop("near", "start", "own", "others")


def others_around(m: DataFrame, most: int = 10, part: int = 3) -> DataFrame:
    """Each reading with the mean and deviation of the other readings of its window, which it can't hide in.

    The window has w = min(``most``, n / ``part``) rows around the reading, or the
    nearest w rows at the ends; series with w below 3 have no rows. Nulls are left out.
    """
    rows = with_others(m.where("value IS NOT NULL"), most, part).where("w >= 3")
    return rows.select("event_id", *KEYS, "ts", "value", "k", "n", "w", "mean", "sd")


def filled(m: DataFrame, every: int = 3) -> DataFrame:
    """Values, of which each ``every``-th is taken as missing, filled forward, then backward."""
    rows = m.withColumn("seen", F.when(F.col("event_id") % every != 0, F.col("value")))
    ahead = F.last("seen", True).over(series().rowsBetween(Window.unboundedPreceding, 0))
    behind = F.last("seen", True).over(reversed_series())
    return rows.select("event_id", *KEYS, F.coalesce(ahead, behind).alias("filled"))


def ma_trend(m: DataFrame, band: float = 0.1) -> DataFrame:
    """Direction of the moving average over the min(7, n / 3) rows before each row, from its first to its last."""
    rows = m.withColumn("k", F.row_number().over(series())).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*KEYS)))
    rows = rows.withColumn("w", F.least(F.lit(7), F.floor(F.col("n") / 3)).cast("int")).where("n >= 6")
    past = [F.lag("value", i).over(series()) for i in range(1, 8)]
    mean = sum((F.when(F.col("w") >= i, past[i - 1]).otherwise(0.0) for i in range(1, 8)), F.lit(0.0)) / F.col("w")
    rows = rows.withColumn("ma", F.when(F.col("k") > F.col("w"), mean))
    g = rows.where(F.col("ma").isNotNull()).groupBy(*KEYS).agg(F.min_by("ma", "k").alias("first"), F.max_by("ma", "k").alias("last"), F.count(F.lit(1)).alias("points"))
    slope = (F.col("last") - F.col("first")) / F.greatest(F.lit(1), F.col("points") - 1)
    return g.select(*KEYS, r6("first").alias("first_ma"), r6("last").alias("last_ma"), r6(slope).alias("slope"), F.when(slope > band, "increasing").when(slope < -band, "decreasing").otherwise("stable").alias("direction"))


def thirds_trend(m: DataFrame) -> DataFrame:
    """Means of the first and last third of each series, and direction beyond 10 %."""
    rows = m.withColumn("k", F.row_number().over(series())).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*KEYS)))
    third = F.floor(F.col("n") / 3)
    g = rows.where("n >= 6").groupBy(*KEYS).agg(F.avg(F.when(F.col("k") <= third, F.col("value"))).alias("a"), F.avg(F.when(F.col("k") > F.col("n") - third, F.col("value"))).alias("b"))
    change = (F.col("b") - F.col("a")) / F.col("a")
    return g.select(*KEYS, r6("a").alias("first_third"), r6("b").alias("last_third"), F.when(change > 0.1, "increasing").when(change < -0.1, "decreasing").otherwise("stable").alias("direction"))


def iqr_outliers(m: DataFrame, k: float = 1.5) -> DataFrame:
    """Readings outside the quartile fences of their person and type."""
    q = m.groupBy(*KEYS).agg(F.percentile("value", F.lit(0.25)).alias("q1"), F.percentile("value", F.lit(0.75)).alias("q3"))
    q = q.select(*KEYS, r6(F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("low"), r6(F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("high"))
    return m.join(q, KEYS).where((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).select("event_id", *KEYS, "value", "low", "high")


def rolling_corr(m: DataFrame, a: str, b: str, w: int = 7, least: int = 5) -> DataFrame:
    """Rolling correlation of two types' daily means per person over rows -w to w - 1: mean, sd, range, stability."""
    days = m.where(F.col("metric_type").isin(a, b)).groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.avg(F.when(F.col("metric_type") == a, F.col("value"))).alias("x"), F.avg(F.when(F.col("metric_type") == b, F.col("value"))).alias("y"),
    ).where("x IS NOT NULL AND y IS NOT NULL")
    win = Window.partitionBy("user_id").orderBy("day").rowsBetween(-w, w - 1)
    rows = days.withColumn("r", F.when(F.count(F.lit(1)).over(win) >= least, corr("x", "y", win))).where("r IS NOT NULL AND NOT isnan(r)")
    g = rows.groupBy("user_id").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.min("r").alias("low"), F.max("r").alias("high"), F.count(F.lit(1)).alias("windows"))
    return g.select("user_id", r6("mean").alias("mean_r"), r6("sd").alias("sd_r"), r6(F.col("high") - F.col("low")).alias("range_r"), "windows", r6(F.greatest(F.lit(0.0), 1 - F.col("sd"))).alias("stability"))


def sessionise(m: DataFrame, minutes: int = 30) -> DataFrame:
    """A session number per person: a new one after ``minutes`` without an event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    idle = F.col("ts") - F.lag("ts").over(w) > F.expr(f"INTERVAL {minutes} MINUTES")
    return m.withColumn("new", F.when(idle | F.lag("ts").over(w).isNull(), 1).otherwise(0)).select("event_id", "user_id", "ts", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("session"))


def integrity_report(m: DataFrame, expected: list[str]) -> DataFrame:
    """Per person: gaps over 25 h, outliers, missing types, and a grade."""
    people = m.select("user_id").distinct()
    g = gaps(m).groupBy("user_id").agg(F.count(F.lit(1)).alias("gaps"))
    o = iqr_outliers(m).groupBy("user_id").agg(F.count(F.lit(1)).alias("outliers"))
    t = m.groupBy("user_id").agg((F.lit(len(expected)) - F.countDistinct(F.when(F.col("metric_type").isin(expected), F.col("metric_type")))).alias("missing_types"))
    rows = people.join(g, "user_id", "left").join(o, "user_id", "left").join(t, "user_id").fillna(0, ["gaps", "outliers"])
    return rows.withColumn("grade", F.when((F.col("missing_types") == 0) & (F.col("outliers") == 0), "good").when(F.col("outliers") <= 3, "fair").otherwise("poor"))
