"""Trends, change flags, autocorrelation and forecasts of each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseloom.functions.labels import label
from pulseloom.functions.stats import t_two_sided
from pulseloom.operators.aggregates import KEYS, r6
from pulseloom.operators.correlations import sign_sums
from pulseloom.operators.windows import others_around, series
from pulseloom.sources.shared import staged


def group():
    """Each person's readings of a type."""
    return Window.partitionBy(*KEYS)


def _days(c: str = "ts") -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 8.64e10


def linear_trend(m: DataFrame, least: int = 5) -> DataFrame:
    """OLS of value on elapsed days: slope a day, week and month, r2, standard error, p, direction and strength."""
    rows = m.withColumn("x", _days() - F.min(_days()).over(group()))
    g = rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept"),
        F.regr_r2("value", "x").alias("r2"), F.regr_sxx("value", "x").alias("sxx"), F.regr_syy("value", "x").alias("syy"),
    ).where((F.col("n") >= least) & (F.col("sxx") > 0) & (F.col("syy") > 0))
    se = F.sqrt((1 - F.col("r2")) * F.col("syy") / (F.col("n") - 2) / F.col("sxx"))
    p = t_two_sided(F.when(se > 0, F.col("slope") / se), F.col("n") - 2)
    direction = F.when(F.col("slope") > 0.01, "increasing").when(F.col("slope") < -0.01, "decreasing").otherwise("stable")
    return g.select(*KEYS, "n", "slope", (F.col("slope") * 7).alias("per_week"), (F.col("slope") * 30).alias("per_month"), "intercept", "r2", se.alias("se"), p.alias("p"), direction.alias("direction"), label(F.sqrt("r2"), "trend").alias("strength"))


def mann_kendall(m: DataFrame, least: int = 4) -> DataFrame:
    """Mann-Kendall S, tau and the normal z of each series against its order."""
    g = sign_sums(m.withColumn("k", F.row_number().over(series())), KEYS, "k", "value")
    n = F.col("n")
    pairs = n * (n - 1) / 2
    z = F.when(F.col("s") > 0, F.col("s") - 1).when(F.col("s") < 0, F.col("s") + 1).otherwise(0.0) / F.sqrt(n * (n - 1) * (2 * n + 5) / 18)
    return g.where((n >= least) & (F.col("untied") > 0)).select(*KEYS, "n", "s", (F.col("s") / F.sqrt(F.col("untied") * pairs)).alias("tau"), z.alias("z"))


def decompose(m: DataFrame, period: int = 7) -> DataFrame:
    """Additive parts of each series' daily means: centred moving average, centred phase means, residual (null at the ends)."""
    days = m.groupBy(*KEYS, F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    w = Window.partitionBy(*KEYS).orderBy("day")
    half = period // 2
    full = F.count("v").over(w.rowsBetween(-half, half)) == period
    rows = days.withColumn("trend", F.when(full, F.avg("v").over(w.rowsBetween(-half, half)))).withColumn("phase", F.row_number().over(w) % period)
    raw = rows.groupBy(*KEYS, "phase").agg(F.avg(F.col("v") - F.col("trend")).alias("raw"))
    seasonal = raw.withColumn("seasonal", F.col("raw") - F.avg("raw").over(Window.partitionBy(*KEYS))).drop("raw")
    rows = rows.join(seasonal, [*KEYS, "phase"])
    return rows.select(*KEYS, "day", "v", "trend", "seasonal", (F.col("v") - F.col("trend") - F.col("seasonal")).alias("residual"))


def seasonal_strength(m: DataFrame, period: int = 7) -> DataFrame:
    """1 - var(residual) / var(seasonal + residual) of each series, at least zero."""
    d = decompose(m, period).where("residual IS NOT NULL")
    g = d.groupBy(*KEYS).agg(F.var_pop("residual").alias("r"), F.var_pop(F.col("seasonal") + F.col("residual")).alias("sr"), F.count(F.lit(1)).alias("days")).where("sr > 1e-12")
    return g.select(*KEYS, "days", F.greatest(F.lit(0.0), 1 - F.col("r") / F.col("sr")).alias("strength"))


def change_points(m: DataFrame, least: int = 3) -> DataFrame:
    """The best single split of each series by squared error: both sides have ``least`` rows; gain as a share of the whole error."""
    w = series().rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("value") - F.avg("value").over(group())
    rows = m.withColumn("v", v).withColumn("k", F.row_number().over(series())).withColumn("n", F.count(F.lit(1)).over(group())).withColumn("spread", F.var_pop("value").over(group()))
    rows = rows.withColumn("s", F.sum("v").over(w)).where((F.col("k") >= least) & (F.col("n") - F.col("k") >= least) & (F.col("spread") > 0))
    # sums of the centred series: the gain of a split after k is s^2 / k + s^2 / (n - k)
    gain = F.col("s") * F.col("s") * (1 / F.col("k") + 1 / (F.col("n") - F.col("k")))
    return rows.select(*KEYS, "k", "n", "ts", gain.alias("gain"), (gain / (F.col("spread") * F.col("n"))).alias("share")).groupBy(*KEYS).agg(F.max_by(F.struct("k", "ts", "share"), F.struct(F.round("gain", 6), -F.col("k"))).alias("b"), F.max("n").alias("n")).select(*KEYS, F.col("b.k").alias("split_after"), F.col("b.ts").alias("split_ts"), "n", F.col("b.share").alias("share"))


def segments(m: DataFrame, least: int = 3, share: float = 0.05) -> DataFrame:
    """All change points of each series by binary segmentation on squared error, and the slope a reading of each segment.

    A segment is split where that lowers its squared error most, if both sides have
    ``least`` readings and the gain is more than ``share`` of the series' whole
    error and more than one variance. So a series has fewer than 1 / ``share``
    splits, and the rounds end by themselves; a round takes only segments that the
    one before has made. Null values are left out; a constant series is one segment.
    """
    rows = m.where("value IS NOT NULL").select(
        *KEYS, "ts", "value", F.row_number().over(series()).alias("k"), F.count(F.lit(1)).over(group()).alias("n"),
        F.var_pop("value").over(group()).alias("spread"), F.lit(1).alias("seg"),
    )
    w = Window.partitionBy(*KEYS, "seg")
    settled = []
    while True:
        v = F.col("value") - F.avg("value").over(w)
        rows = rows.withColumn("v", v).withColumn("a", F.col("k") - F.col("seg") + 1).withColumn("b", F.count(F.lit(1)).over(w) - F.col("a"))
        rows = rows.withColumn("s", F.sum("v").over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
        fits = (F.col("a") >= least) & (F.col("b") >= least) & (F.col("spread") > 1e-12)
        gain = F.when(fits, r6(F.col("s") * F.col("s") * (1 / F.col("a") + 1 / F.nullif("b", F.lit(0))) / F.col("spread")))
        rows = rows.withColumn("gain", gain)
        enough = F.col("gain") > F.greatest(F.lit(1.0), share * F.col("n"))
        cut = -F.max(F.when(enough, F.struct("gain", (-F.col("k")).alias("k")))).over(w)["k"]
        rows = rows.withColumn("cut", cut)
        seg = F.when(F.col("k") > F.col("cut"), F.col("cut") + 1).otherwise(F.col("seg"))
        rows = staged(rows.select(*KEYS, "ts", "value", "k", "n", "spread", seg.alias("seg"), F.col("cut").isNotNull().alias("split")), "segments")
        settled.append(rows.where("NOT split"))
        rows = rows.where("split").drop("split")
        if rows.isEmpty():
            break
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.groupBy(*KEYS, F.col("seg").alias("first_k")).agg(F.max("k").alias("last_k"), F.min("ts").alias("start_ts"), F.avg("value").alias("mean"), F.regr_slope("value", "k").alias("slope"))


def decompose_whole(m: DataFrame) -> DataFrame:
    """Trend, seasonal part and residual of each series for every day from its first to its last reading.

    Days without readings take the value of the day before. The period is 7 for
    14 days and more, else 3 or a third of the readings (2 at least) for 6 days
    and more; shorter series, and those of fewer days than two periods, have no
    rows. The trend is the centred mean over a period (the outer days of an even
    one count half); at both ends it goes on along the line through its nearest
    values, as many as the period has. The seasonal part is the mean of each
    phase of what is left, about zero.
    """
    days = m.where("value IS NOT NULL").groupBy(*KEYS, F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("c"))
    span = days.groupBy(*KEYS).agg(F.min("day").alias("a"), F.max("day").alias("b"), F.sum("c").alias("c"))
    span = span.withColumn("size", F.datediff("b", "a") + 1).withColumn("p", F.when(F.datediff("b", "a") >= 14, 7).when(F.datediff("b", "a") >= 6, F.least(F.lit(3), F.floor(F.col("c") / 3).cast("int"))))
    span = span.where("p >= 2 AND size >= 2 * p")
    own = Window.partitionBy(*KEYS)
    w = own.orderBy("day")
    rows = span.select(*KEYS, "p", "size", F.posexplode(F.sequence("a", "b")).alias("k", "day")).join(days.select(*KEYS, "day", "v"), [*KEYS, "day"], "left")
    rows = rows.withColumn("v", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("h", F.floor(F.col("p") / 2))
    mean = lambda n: F.avg("v").over(w.rowsBetween(-n, n))
    inside = (F.col("k") >= F.col("h")) & (F.col("k") < F.col("size") - F.col("h"))
    rows = rows.withColumn("t", F.when(inside, F.when(F.col("p") == 7, mean(3)).when(F.col("p") == 3, mean(1)).otherwise((F.lag("v").over(w) + 2 * F.col("v") + F.lead("v").over(w)) / 4)))
    front, back = F.col("k") < F.col("h") + F.col("p"), F.col("k") >= F.col("size") - F.col("h") - F.col("p")
    line = lambda near, f: f(F.when(near, F.col("t")), F.when(near & F.col("t").isNotNull(), F.col("k"))).over(own)
    at = lambda near: line(near, F.regr_intercept) + line(near, F.regr_slope) * F.col("k")
    rows = rows.withColumn("start", at(front)).withColumn("finish", at(back))
    rows = rows.withColumn("trend", F.coalesce("t", F.when(F.col("k") < F.col("h"), F.col("start")).otherwise(F.col("finish")))).withColumn("phase", F.col("k") % F.col("p"))
    rows = rows.withColumn("raw", F.avg(F.col("v") - F.col("trend")).over(Window.partitionBy(*KEYS, "phase")))
    phases = F.sum(F.when(F.col("k") < F.col("p"), F.col("raw"))).over(own) / F.col("p")  # each phase once
    rows = rows.withColumn("seasonal", F.col("raw") - phases)
    return rows.select(*KEYS, "day", F.col("p").alias("period"), "v", "trend", "seasonal", (F.col("v") - F.col("trend") - F.col("seasonal")).alias("residual"))


def rolling_change_flags(m: DataFrame, most: int = 5, limit: float = 2.0, least: int = 10) -> DataFrame:
    """Readings more than ``limit`` deviations of the other readings around off their mean, but for a window at both ends of a series."""
    rows = others_around(m, most, 2).where((F.col("sd") > 1e-9) & (F.col("n") >= least) & (F.col("k") > F.col("w")) & (F.col("k") <= F.col("n") - F.col("w")))
    return rows.withColumn("z", r6(F.abs(F.col("value") - F.col("mean")) / F.col("sd"))).where(F.col("z") > limit).select("event_id", *KEYS, "ts", "value", "z")


def acf(m: DataFrame, most: int = 10) -> DataFrame:
    """Autocorrelation of each series' daily means by lag, the 95 % bound, and whether it is beyond."""
    days = m.groupBy(*KEYS, F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    w = Window.partitionBy(*KEYS)
    rows = days.withColumn("k", F.row_number().over(w.orderBy("day"))).withColumn("c", F.col("v") - F.avg("v").over(w)).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("total", F.var_pop("v").over(w) * F.count(F.lit(1)).over(w))
    a = rows.select(*KEYS, "k", "c", "n", "total", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("lag")).withColumn("j", F.col("k") + F.col("lag"))
    b = rows.select(*KEYS, F.col("k").alias("j"), F.col("c").alias("d"))
    g = a.join(b, [*KEYS, "j"]).groupBy(*KEYS, "lag").agg((F.sum(F.col("c") * F.col("d")) / F.max("total")).alias("r"), F.max("n").alias("n")).where(F.col("lag") <= F.col("n") / 2)
    return g.select(*KEYS, "lag", "r", "n", (1.96 / F.sqrt("n")).alias("bound"), (F.abs("r") > 1.96 / F.sqrt("n")).alias("significant"))


def pacf(m: DataFrame, most: int = 10) -> DataFrame:
    """Partial autocorrelations of each series by the Durbin-Levinson recursion over its array of autocorrelations."""
    g = acf(m, most).groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "r"))), lambda s: s.r).alias("r"))

    def step(s: Column, k: Column) -> Column:
        """s.phi has the k - 1 coefficients of the step before; r[k - 1] is the autocorrelation at lag k."""
        up = F.get("r", k - 1) - F.aggregate(F.transform(s.phi, lambda p, i: p * F.get("r", k - 2 - i)), F.lit(0.0), lambda x, y: x + y)
        down = 1 - F.aggregate(F.transform(s.phi, lambda p, i: p * F.get("r", i)), F.lit(0.0), lambda x, y: x + y)
        last = up / down
        phi = F.concat(F.transform(s.phi, lambda p, i: p - last * F.get(s.phi, F.size(s.phi) - 1 - i)), F.array(last))
        return F.struct(phi.alias("phi"), F.concat(s.out, F.array(last)).alias("out"))

    empty = F.array().cast("array<double>")
    out = F.aggregate(F.sequence(F.lit(1), F.size("r")), F.struct(empty.alias("phi"), empty.alias("out")), step, lambda s: s.out)
    return g.select(*KEYS, F.posexplode(out).alias("i", "pacf")).select(*KEYS, (F.col("i") + 1).alias("lag"), "pacf")


def seasonality(m: DataFrame, most: int = 14, shortest: int = 5, height: float = 0.1) -> DataFrame:
    """Peaks of each series' autocorrelation above ``height`` times its largest value: the period is the first from ``shortest`` to half the days, with its strength."""
    w = Window.partitionBy(*KEYS).orderBy("lag")
    rows = acf(m, most).withColumn("before", F.lag("r").over(w)).withColumn("behind", F.lead("r").over(w)).withColumn("top", F.max("r").over(Window.partitionBy(*KEYS)))
    # to nine digits, so that equal heights are equal
    peaks = rows.where(F.expr(f"r > before AND r > behind AND r > 0 AND round(r - {height} * top, 9) > 0 AND lag >= {shortest} AND lag <= n / 2"))
    return peaks.groupBy(*KEYS).agg(F.min("lag").alias("period"), F.min_by("r", "lag").alias("strength"), F.count(F.lit(1)).alias("peaks"))


def forecast_linear(m: DataFrame, h: int = 7, least: int = 5) -> DataFrame:
    """The OLS line of each series' order carried on h steps, with the residual deviation's interval."""
    rows = m.withColumn("k", F.row_number().over(series()))
    g = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("value", "k").alias("b"), F.regr_intercept("value", "k").alias("a"), F.regr_syy("value", "k").alias("syy"), F.regr_r2("value", "k").alias("r2")).where(F.col("n") >= least)
    sd = F.sqrt((1 - F.coalesce("r2", F.lit(0.0))) * F.col("syy") / (F.col("n") - 2))
    g = g.withColumn("half", 1.96 * sd * F.sqrt(1 + 1 / F.col("n"))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h))))
    f = F.col("a") + F.col("b") * (F.col("n") + F.col("step"))
    return g.select(*KEYS, "step", f.alias("forecast"), (f - F.col("half")).alias("low"), (f + F.col("half")).alias("high"))


def forecast_features(m: DataFrame, *more: str) -> DataFrame:
    """Calendar parts, their sines and cosines, and lags for each reading; further columns of it as named."""
    h, d = F.hour("ts"), F.weekday("ts")
    turn = lambda x, n, f: r6(f(x * (6.283185307179586 / n)))
    return m.select(
        "event_id", *KEYS, "value", *more, h.alias("hour"), d.alias("weekday"), F.dayofmonth("ts").alias("day"), F.month("ts").alias("month"),
        turn(h, 24, F.sin).alias("hour_sin"), turn(h, 24, F.cos).alias("hour_cos"), turn(d, 7, F.sin).alias("weekday_sin"), turn(d, 7, F.cos).alias("weekday_cos"),
        *[F.lag("value", k).over(series()).alias(f"lag_{k}") for k in (1, 2, 3, 7)],
    )


def forecast_holt(m: DataFrame, h: int = 7, grid: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9)) -> DataFrame:
    """Level and trend smoothing of each series: the (alpha, beta) of the grid with the least one-step error."""
    s = m.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x.value).alias("v")).where(F.size("v") >= 4)
    g = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for a in grid for b in grid])
    s = s.withColumn("p", F.explode(g)).select(*KEYS, "v", "p.alpha", "p.beta")

    def step(acc: Column, v: Column) -> Column:
        error = v - acc.level - acc.trend
        level = acc.level + acc.trend + F.col("alpha") * error
        return F.struct(level.alias("level"), (acc.trend + F.col("alpha") * F.col("beta") * error).alias("trend"), (acc.sse + error * error).alias("sse"))

    start = F.struct(F.get("v", F.lit(0)).alias("level"), (F.get("v", F.lit(1)) - F.get("v", F.lit(0))).alias("trend"), F.lit(0.0).alias("sse"))
    s = s.withColumn("fit", F.aggregate(F.slice("v", 2, F.size("v") - 1), start, step))
    best = s.groupBy(*KEYS).agg(F.min_by(F.struct("alpha", "beta", "fit"), F.struct(F.round("fit.sse", 4), "alpha", "beta")).alias("b"))
    return best.select(*KEYS, F.col("b.alpha").alias("alpha"), F.col("b.beta").alias("beta"), F.col("b.fit.sse").alias("sse"), F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"), F.col("b.fit.level").alias("level"), F.col("b.fit.trend").alias("trend")).select(*KEYS, "alpha", "beta", "sse", "step", (F.col("level") + F.col("step") * F.col("trend")).alias("forecast"))


def forecast_ensemble(m: DataFrame, h: int = 7) -> DataFrame:
    """Linear and smoothing forecasts, weighted by the inverse of their in-sample errors."""
    rows = m.withColumn("k", F.row_number().over(series()))
    rmse = rows.groupBy(*KEYS).agg(F.sqrt((1 - F.coalesce(F.regr_r2("value", "k"), F.lit(0.0))) * F.regr_syy("value", "k") / F.count(F.lit(1))).alias("rmse"), F.count(F.lit(1)).alias("n"))
    a = forecast_linear(m, h).select(*KEYS, "step", F.col("forecast").alias("f1"))
    b = forecast_holt(m, h).select(*KEYS, "step", F.col("forecast").alias("f2"), "sse")
    j = a.join(b, [*KEYS, "step"]).join(rmse, KEYS).withColumn("w1", 1 / F.greatest("rmse", F.lit(1e-6))).withColumn("w2", 1 / F.greatest(F.sqrt(F.col("sse") / (F.col("n") - 1)), F.lit(1e-6)))
    return j.select(*KEYS, "step", ((F.col("f1") * F.col("w1") + F.col("f2") * F.col("w2")) / (F.col("w1") + F.col("w2"))).alias("forecast"), F.when(F.col("w1") >= F.col("w2"), "linear").otherwise("smoothing").alias("best"))


def forecast_held_out(m: DataFrame, h: int = 7, share: float = 0.8, least: int = 10) -> DataFrame:
    """Linear and smoothing forecasts of each series, weighted by the inverse of their errors on what they weren't fitted to.

    Both are fitted to the first ``share`` of a series of ``least`` readings or
    more and foretell the rest; the forecasts themselves are fitted to all of
    it. ``best`` has the smaller error there, and the grade follows from its
    share of the variance there (excellent from 0.8, good from 0.6, fair from
    0.4, else poor; null where the rest doesn't vary).
    """
    own = Window.partitionBy(*KEYS)
    rows = m.where("value IS NOT NULL").withColumn("k", F.row_number().over(series())).withColumn("n", F.count(F.lit(1)).over(own)).where(F.col("n") >= least).withColumn("n_fit", F.floor(F.col("n") * share))
    fit = rows.where("k <= n_fit")
    line = fit.groupBy(*KEYS).agg(F.regr_slope("value", "k").alias("b"), F.regr_intercept("value", "k").alias("a"))
    two = forecast_holt(fit, 2).groupBy(*KEYS).agg(F.max(F.when(F.col("step") == 1, F.col("forecast"))).alias("f1"), F.max(F.when(F.col("step") == 2, F.col("forecast"))).alias("f2"))
    rest = rows.where("k > n_fit").join(line, KEYS).join(two, KEYS)
    e1 = F.col("value") - F.col("a") - F.col("b") * F.col("k")
    e2 = F.col("value") - F.col("f1") - (F.col("k") - F.col("n_fit") - 1) * (F.col("f2") - F.col("f1"))
    g = rest.groupBy(*KEYS).agg(F.sqrt(F.avg(e1 * e1)).alias("rmse_linear"), F.sqrt(F.avg(e2 * e2)).alias("rmse_smoothing"), F.var_pop("value").alias("spread"))
    best = F.least("rmse_linear", "rmse_smoothing")
    r2 = F.when(F.col("spread") > 1e-12, F.round(1 - best * best / F.col("spread"), 9))
    grade = F.when(r2 >= 0.8, "excellent").when(r2 >= 0.6, "good").when(r2 >= 0.4, "fair").when(r2.isNotNull(), "poor")
    j = g.join(forecast_linear(m, h).select(*KEYS, "step", F.col("forecast").alias("f1")), KEYS).join(forecast_holt(m, h).select(*KEYS, "step", F.col("forecast").alias("f2")), [*KEYS, "step"])
    w1, w2 = 1 / F.greatest("rmse_linear", F.lit(1e-6)), 1 / F.greatest("rmse_smoothing", F.lit(1e-6))
    name = F.when(F.round("rmse_linear", 9) <= F.round("rmse_smoothing", 9), "linear").otherwise("smoothing")
    return j.select(*KEYS, "step", ((F.col("f1") * w1 + F.col("f2") * w2) / (w1 + w2)).alias("forecast"), "rmse_linear", "rmse_smoothing", name.alias("best"), grade.alias("grade"))


def trend_summary(m: DataFrame) -> DataFrame:
    """Per series: the trend of the first method that sees one (regression, then Mann-Kendall, then the change point), and an outlook."""
    a = linear_trend(m).select(*KEYS, "slope", F.when(F.col("se") > 0, F.col("slope") / F.col("se")).alias("t"))
    b = mann_kendall(m).select(*KEYS, "tau", "z")
    c = change_points(m).select(*KEYS, "share")
    j = m.select(*KEYS).distinct().join(a, KEYS, "left").join(b, KEYS, "left").join(c, KEYS, "left")
    by = F.when(F.abs("t") >= 2, "regression").when(F.abs("z") >= 1.96, "mann_kendall").when(F.col("share") >= 0.5, "change_point").otherwise("none")
    sign = F.when(by == "regression", F.signum("slope")).when(by == "mann_kendall", F.signum("tau")).otherwise(0.0)
    direction = F.when(sign > 0, "increasing").when(sign < 0, "decreasing").otherwise("stable")
    outlook = F.when(direction == "increasing", "likely to rise").when(direction == "decreasing", "likely to fall").when(by == "change_point", "has moved to another level").otherwise("no change expected")
    return j.select(*KEYS, by.alias("method"), direction.alias("direction"), (by != "none").alias("significant"), outlook.alias("outlook"))
