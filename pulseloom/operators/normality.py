"""Normality of each series by three tests and their vote."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseloom.functions.stats import normal_cdf, normal_quantile, polynomial
from pulseloom.operators.aggregates import KEYS, r6
from pulseloom.operators.learning import dagostino

#: Fixed values of Royston's approximation (1995), highest power first: the two outer weights in 1 / sqrt(n), and the
#: mean and log deviation of the transformed W for 4 to 11 values in n, and for more in log n.
OUTER = (-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0.0)
SECOND = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)
FEW_SHIFT, FEW_MEAN, FEW_SD = (0.459, -2.273), (-6.714e-4, 0.025054, -0.39978, 0.544), (-0.0020322, 0.062767, -0.77857, 1.3822)
MANY_MEAN, MANY_SD = (0.0038915, -0.083751, -0.31082, -1.5861), (0.0030302, -0.082676, -0.4803)
#: Values of a series for which W is defined.
LEAST, MOST = 3, 5000
#: Fixed value: the limit of A2 at 5 % for a fitted normal, before its correction for the number of values.
A2_LIMIT = 0.787


def shapiro_p(n: Column, w: Column) -> Column:
    """The p value of W for n values; 3 to 5,000."""
    y = F.log(F.greatest(1 - w, F.lit(1e-300)))
    three = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 6 / math.pi * (F.asin(F.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    gamma = polynomial(FEW_SHIFT, n)
    few = 1 - normal_cdf((-F.log(gamma - y) - polynomial(FEW_MEAN, n)) / F.exp(polynomial(FEW_SD, n)))
    many = 1 - normal_cdf((y - polynomial(MANY_MEAN, F.log(n))) / F.exp(polynomial(MANY_SD, F.log(n))))
    return F.when(n == 3, three).when((n <= 11) & (y >= gamma), 0.0).when(n <= 11, few).otherwise(many)


def normality_by_series(m: DataFrame) -> DataFrame:
    """Shapiro-Wilk W and p, Anderson-Darling A2, D'Agostino-Pearson K2, and the vote, of each person's readings of a type.

    Series of 3 to 5,000 values that vary have a row (longer ones are left to
    ``normality``, which sorts no series); K2 needs 20 values. A series is called
    normal if at least half of its tests don't reject at 5 %. Nulls are left out.
    Weights of W are those of Royston: the quantiles of the places, with outer
    ones corrected.
    """
    rows = m.where("value IS NOT NULL AND NOT isnan(value)")
    moments = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"))
    moments = moments.where((F.col("n") >= LEAST) & (F.col("n") <= MOST) & (F.col("sd") > 1e-12))
    placed = rows.join(moments, KEYS).withColumn("i", F.row_number().over(Window.partitionBy(*KEYS).orderBy("value", "event_id")))
    n, i = F.col("n").cast("double"), F.col("i")
    z = (F.col("value") - F.col("mean")) / F.col("sd")
    cdf = F.least(F.greatest(normal_cdf(z), F.lit(1e-12)), F.lit(1 - 1e-12))
    placed = placed.withColumn("q", normal_quantile((i - 0.375) / (n + 0.25))).withColumn("z", z)
    parts = (2 * i - 1) * F.log(cdf) + (2 * (n - i) + 1) * F.log(1 - cdf)
    at = lambda k, c: F.max(F.when(i == k, F.col(c)))
    end = lambda k, c: F.max(F.when(i == F.col("n") + 1 - k, F.col(c)))
    g = placed.groupBy(*KEYS, "n", "g1", "g2").agg(
        F.sum(F.col("q") * F.col("q")).alias("qq"), F.sum(F.col("q") * F.col("z")).alias("qz"), (-F.col("n") - F.sum(parts) / F.col("n")).alias("a2"),
        at(1, "q").alias("q1"), at(2, "q").alias("q2"), (end(1, "z") - at(1, "z")).alias("range1"), (end(2, "z") - at(2, "z")).alias("range2"),
    )
    q1, q2, qq, root = F.col("q1"), F.col("q2"), F.col("qq"), 1 / F.sqrt(n)
    a1 = F.when(n == 3, math.sqrt(0.5)).otherwise(polynomial(OUTER, root) - q1 / F.sqrt(qq))
    a2 = polynomial(SECOND, root) - q2 / F.sqrt(qq)
    # the quantiles between the corrected outer weights are scaled so that all weights have length one
    one = F.sqrt((qq - 2 * q1 * q1) / (1 - 2 * a1 * a1))
    two = F.sqrt((qq - 2 * q1 * q1 - 2 * q2 * q2) / (1 - 2 * a1 * a1 - 2 * a2 * a2))
    inner1, inner2 = F.col("qz") + q1 * F.col("range1"), F.col("qz") + q1 * F.col("range1") + q2 * F.col("range2")
    total = F.when(n == 3, a1 * F.col("range1")).when(n <= 5, a1 * F.col("range1") + inner1 / one).otherwise(a1 * F.col("range1") + a2 * F.col("range2") + inner2 / two)
    g = g.withColumn("w", F.least(F.lit(1.0), total * total / (n - 1)))
    g = g.withColumn("p", shapiro_p(n, F.col("w"))).withColumn("k2", F.when(n >= 20, dagostino(n, F.col("g1"), F.col("g2"))))
    g = g.withColumn("votes", (F.col("p") > 0.05).cast("int") + (F.col("a2") < A2_LIMIT / (1 + 4 / n - 25 / n / n)).cast("int") + F.coalesce((F.exp(-F.col("k2") / 2) > 0.05).cast("int"), F.lit(0)))
    tests = F.when(n >= 20, 3).otherwise(2)
    return g.select(*KEYS, "n", r6("w").alias("w"), r6("p").alias("p"), r6("a2").alias("a2"), r6("k2").alias("k2"), "votes", (F.col("votes") >= tests / 2).alias("is_normal"))
