"""Models of each series or person on their own, from mergeable moments.

Moments are summed by grouped aggregates, so no series is gathered anywhere; what
is left per group is a k x k matrix, and an Arrow function solves batches of
those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseloom.functions.stats import fused, rounded_product
from pulseloom.operators.aggregates import KEYS, r6
from pulseloom.operators.learning import FEATURES, forecast_rows


def moments(columns: list[str], sample: bool = False) -> list[Column]:
    """Aggregates of a group: n, the means, and the covariances of all pairs (i <= j) of ``columns``, row by row."""
    cov = F.covar_samp if sample else F.covar_pop
    pairs = [cov(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return [F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in columns]).alias("means"), F.array(*pairs).alias("cov")]


def square(flat: list[np.ndarray], k: int) -> np.ndarray:
    """The symmetric k x k matrices of flattened upper triangles."""
    out = np.zeros((len(flat), k, k))
    i, j = np.triu_indices(k)
    values = np.array([np.asarray(f, float) for f in flat]).reshape(len(flat), len(i))
    out[:, i, j] = out[:, j, i] = values
    return out


def dot(weights: str, columns: list[str]) -> Column:
    """The sum of the entries of an array column times ``columns``."""
    return sum((F.col(weights)[k] * F.col(c) for k, c in enumerate(columns)), F.lit(0.0))


def ridge_by_series(m: DataFrame, features: list[str] = FEATURES, alpha: float = 1.0, share: float = 0.8, least: int = 10) -> DataFrame:
    """Ridge regression of each person's readings of a type on scaled ``features``, by time: the first ``share`` to fit, the rest to test.

    Features are scaled by the mean and deviation of the fit rows (a constant one
    gets weight 0); the intercept isn't penalised. Series of fewer than ``least``
    rows with all features have no row. Rows with a null value are left out.
    Returns sizes, rmse, mae and r2 on the test rows (r2 null where they don't
    vary), the intercept, and a weight per feature in its own unit.
    """
    rows = forecast_rows(m.where("value IS NOT NULL"))
    w = Window.partitionBy(*KEYS)
    rows = rows.withColumn("k", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("size", F.count(F.lit(1)).over(w)).where(F.col("size") >= least)
    rows = rows.withColumn("fits", F.col("k") <= F.floor(F.col("size") * share))
    own, k = [*features, "label"], len(features)
    fit = rows.where("fits").groupBy(*KEYS).agg(*moments(own))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cov = square(batch.column("cov").to_pylist(), k + 1)
            means = np.array(batch.column("means").to_pylist(), float).reshape(-1, k + 1)
            n = batch.column("n").to_numpy().astype(float)
            sd = np.sqrt(np.einsum("bii->bi", cov)[:, :k].clip(0))
            # a deviation that is rounding only is none
            flat = sd <= 1e-9 * np.maximum(1, np.abs(means[:, :k]))
            sd[flat] = 1.0
            scaled = n[:, None, None] * cov[:, :k, :k] / sd[:, :, None] / sd[:, None, :]
            target = n[:, None] * cov[:, :k, k] / sd
            scaled[np.broadcast_to(flat[:, :, None], scaled.shape) | np.broadcast_to(flat[:, None, :], scaled.shape)] = 0.0
            target[flat] = 0.0
            lower = np.linalg.cholesky(scaled + alpha * np.eye(k))
            half = np.linalg.solve(lower, target[:, :, None])
            weights = np.linalg.solve(lower.transpose(0, 2, 1), half)[:, :, 0] / sd
            intercept = means[:, k] - (weights * means[:, :k]).sum(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEYS), batch.column("n"), pa.array(weights.tolist(), pa.list_(pa.float64())), pa.array(intercept)], names=[*KEYS, "n", "weights", "intercept"])

    kinds = ", ".join(f"{c} {fit.schema[c].dataType.simpleString()}" for c in KEYS)
    models = fit.mapInArrow(solve, f"{kinds}, n long, weights array<double>, intercept double")
    e = F.col("label") - F.col("intercept") - dot("weights", features)
    scored = rows.where("NOT fits").join(models, KEYS).withColumn("e", e)
    g = scored.groupBy(*KEYS, F.col("n").alias("n_fit"), "weights", "intercept").agg(
        F.count(F.lit(1)).alias("n_test"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"),
        F.when(F.var_pop("label") > 1e-12, 1 - F.avg(F.col("e") * F.col("e")) / F.var_pop("label")).alias("r2"),
    )
    return g.select(*KEYS, "n_fit", "n_test", r6("rmse").alias("rmse"), r6("mae").alias("mae"), r6("r2").alias("r2"), r6("intercept").alias("intercept"), F.transform("weights", r6).alias("weights"))


def day_means(m: DataFrame, types: list[str]) -> DataFrame:
    """Daily means of each person, a column ``v0``, ``v1`` ... for each of ``types``; days that lack one are left out."""
    wide = m.groupBy("user_id", F.to_date("ts").alias("day")).agg(*[F.avg(F.when(F.col("metric_type") == t, F.col("value"))).alias(f"v{k}") for k, t in enumerate(types)])
    return wide.dropna(subset=[f"v{k}" for k in range(len(types))])


#: Part of the squares that a column was made from below which the squares left of it are rounding: well above the square of 2^-53, and below what readings of a few digits leave.
ROUNDING = 1e-27


def hotelling_by_person(m: DataFrame, types: list[str], limit: float = 0.997, least: int | None = None, spanned: bool = False) -> DataFrame:
    """Hotelling's T2 of each day's means of ``types`` from the person's own centre and covariance, over the person's own limit.

    T2 is n - 1 times the sum of squares of the day's place in the person's days as orthogonal columns, made one after another
    (modified Gram-Schmidt): a covariance would square the condition of days that lie nearly on a line. Directions in
    which a person's days don't vary count for nothing (pseudo-inverse); if ``spanned``, a person with such a direction
    has NaN, as 0 / 0 in SQL. People with fewer than ``least`` days that have all types (one more than types, unless
    given) have no rows. The limit is a percentile of the person's distances; of few distances it often ends in
    an exact half at the seventh digit, so that it is interpolated with one rounding and rounded as in SQL.
    """
    k = len(types)
    least = k + 1 if least is None else least
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = [f"v{i}" for i in range(k)]
    over = lambda columns: {name: c.over(w) for name, c in columns.items()}
    days = day_means(m.where("user_id IS NOT NULL"), types).withColumns(over({"n": F.count(F.lit(1)), **{f"m{i}": F.avg(c) for i, c in enumerate(left)}, **{f"raw{i}": F.sum(F.col(c) * F.col(c)) for i, c in enumerate(left)}})).where(F.col("n") >= least)
    days = days.withColumns({c: F.col(c) - F.col(f"m{i}") for i, c in enumerate(left)})
    for i, c in enumerate(left):
        days = days.withColumns(over({f"s{j}": F.sum(F.col(c) * F.col(left[j])) for j in range(i, k)}))
        none = F.col(f"s{i}") <= ROUNDING * F.col(f"raw{i}")
        share = lambda x, of=f"s{i}", none=none: F.when(none, 0.0).otherwise(x / F.when(~none, F.col(of)))
        rest = {}
        for j in range(i + 1, k):
            slope = share(F.col(f"s{j}"))
            rest |= {left[j]: F.col(left[j]) - slope * F.col(c), f"raw{j}": F.col(f"raw{j}") + slope * slope * F.col(f"raw{i}")}
        days = days.withColumns({f"square{i}": share(F.col(c) * F.col(c)), f"none{i}": none, **rest})
    t2 = (F.col("n") - 1) * sum((F.col(f"square{i}") for i in range(k)), F.lit(0.0))
    if spanned:
        t2 = F.when(F.greatest(*[F.col(f"none{i}") for i in range(k)], F.lit(False)), float("nan")).otherwise(t2)
    scored = days.select("user_id", "day", "n", rounded_product(t2).alias("t2"))
    at = (F.col("n") - 1) * F.lit(limit)
    scored = scored.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("t2", "day")) - 1)
    whole = Window.partitionBy("user_id")
    scored = scored.withColumns({"low": F.max(F.when(F.col("k") == F.floor(at), F.col("t2"))).over(whole), "high": F.max(F.when(F.col("k") == F.ceil(at), F.col("t2"))).over(whole)})
    part = at - F.floor(at)
    found = F.when(part == 0, F.col("low")).otherwise(fused(F.col("low"), 1 - part, F.col("high") * part))
    j = scored.withColumn("limit", rounded_product(found))
    return j.select("user_id", "day", F.col("n").alias("days"), "t2", rounded_product(F.sqrt(F.greatest("t2", F.lit(0.0)))).alias("distance"), "limit", (F.col("t2") > F.col("limit")).alias("is_anomaly"))
