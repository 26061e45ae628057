"""Tail probabilities and quantiles as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec, functions as F

#: Coefficients of the error function approximation (Abramowitz and Stegun 7.1.26).
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


#: Coefficients of the normal quantile's rational approximations (Acklam), middle and tails, and where the tails begin.
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
QUANTILE_TAIL = 0.02425


def corr(x: str, y: str, over: WindowSpec | None = None) -> Column:
    """Pearson's r of the rows that have both; null where one side doesn't vary, which ``F.corr`` makes an error in ANSI mode."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    placed = lambda c: c if over is None else c.over(over)
    return F.try_divide(placed(F.covar_pop(a, b)), placed(F.stddev_pop(a)) * placed(F.stddev_pop(b)))


def rounded_product(x: Column, digits: int = 6) -> Column:
    """x to so many digits by rounding x times a power of ten, as DuckDB does; ``F.round`` rounds the decimal text of x, which differs near a half."""
    return F.round(x * 10.0**digits) / 10.0**digits


def halves(x: Column) -> tuple[Column, Column]:
    """x as the sum of two numbers of 26 bits at most, whose products are exact."""
    c = 134217729.0 * x
    high = c - (c - x)
    return high, x - high


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c with one rounding, as a fused multiply-add gives it (but for sums whose error lies within 2^-50 of a half of it)."""
    p, (ah, al), (bh, bl) = a * b, halves(a), halves(b)
    s = p + c
    rest = s - p
    error = ((p - (s - rest)) + (c - rest)) + (((ah * bh - p) + ah * bl + al * bh) + al * bl)
    return F.when(F.abs(a) + F.abs(b) + F.abs(s) < 1e150, s + error).otherwise(s)


def fixed(x: Column, digits: int) -> Column:
    """Text of x with so many digits behind the point, rounded by the exact binary value (a half to even), as C and DuckDB do.

    ``format_string`` rounds the shortest decimal text of x instead, so that
    0.0005 and the like, whose binary value is below the half, go up.
    """
    scale = float(10**digits)
    a = F.abs(x)
    # scale * a is p + e exactly: a is split in two halves whose products with scale fit
    c = 134217729.0 * a
    high = c - (c - a)
    p = a * scale
    e = (high * scale - p) + (a - high) * scale
    k = F.floor(p)
    over = (p - k - 0.5) + e
    n = k + F.when((over > 0) | ((over == 0) & (k % 2 == 1)), 1).otherwise(0)
    text = F.concat(F.when(x < 0, "-").otherwise(""), ((n - n % int(scale)) / int(scale)).cast("long").cast("string"), F.lit("."), F.lpad((n % int(scale)).cast("string"), digits, "0"))
    return F.when(a < 1e9, text).otherwise(F.format_string(f"%.{digits}f", x))


def polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    """The polynomial with these coefficients, highest power first."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + float(c)
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile, to about 1e-9."""
    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    middle = polynomial(QUANTILE_A, r) * q / polynomial(QUANTILE_B, r)
    tail = lambda x: polynomial(QUANTILE_C, x) / polynomial(QUANTILE_D, x)
    return F.when(p < QUANTILE_TAIL, tail(F.sqrt(-2 * F.log(p)))).when(p > 1 - QUANTILE_TAIL, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise(middle)


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function, to about 1e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + ERF_P * x)
    poly = t * (ERF[0] + t * (ERF[1] + t * (ERF[2] + t * (ERF[3] + t * ERF[4]))))
    tail = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom: the finite series to 200, then the normal tail."""
    n = df.cast("int")
    theta = F.atan(F.abs(t) / F.sqrt(n))
    cos2 = F.cos(theta) * F.cos(theta)

    def series(first: Column, start: int) -> Column:
        steps = F.filter(F.sequence(F.lit(start), F.greatest(F.lit(start), n - 2)), lambda k: ((k - start) % 2 == 0) & (k <= n - 2))
        return F.aggregate(steps, F.struct(first.alias("term"), first.alias("acc")), lambda s, k: F.struct((s.term * (k - 1) / k * cos2).alias("term"), (s.acc + s.term * (k - 1) / k * cos2).alias("acc")), lambda s: s.acc)

    even = 1 - F.sin(theta) * series(F.lit(1.0), 2)
    odd = 1 - 2 / math.pi * (theta + F.sin(theta) * series(F.cos(theta), 3))
    far = t * (1 - 1 / (4 * df)) / F.sqrt(1 + t * t / (2 * df))
    p = F.when(n > 200, 2 * (1 - normal_cdf(F.abs(far)))).when(n == 1, 1 - 2 * theta / math.pi).when(n % 2 == 0, even).otherwise(odd)
    return F.when((n >= 1) & t.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def normal_two_sided(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def t_quantile_975(df: Column) -> Column:
    """The 0.975 quantile of Student's t by the Cornish-Fisher expansion; exact forms for one and two degrees."""
    z = 1.959963984540054
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    p = 0.975
    two = (2 * p - 1) * math.sqrt(2 / (1 - (2 * p - 1) ** 2))
    return F.when(df == 1, math.tan(math.pi * (p - 0.5))).when(df == 2, two).otherwise(z + g1 / df + g2 / df**2 + g3 / df**3 + g4 / df**4)
