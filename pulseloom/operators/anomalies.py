"""Anomaly scores by several methods, and their ensemble."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseloom.operators.aggregates import KEYS, r6, r9, with_mad
from pulseloom.operators.windows import others_around, series, with_others


def group():
    """Each person's readings of a type."""
    return Window.partitionBy(*KEYS)


def zscore(m: DataFrame, least: int = 5) -> DataFrame:
    """tanh(|z| / 3) per reading, for series of ``least`` readings or more that vary."""
    rows = m.withColumn("mu", F.avg("value").over(group())).withColumn("sd", F.stddev_samp("value").over(group())).withColumn("n", F.count(F.lit(1)).over(group()))
    rows = rows.where((F.col("n") >= least) & (F.col("sd") > 0))
    return rows.select("event_id", *KEYS, F.tanh(F.abs(F.col("value") - F.col("mu")) / F.col("sd") / 3).alias("score"))


def modified_z(m: DataFrame, least: int = 5) -> DataFrame:
    """tanh of 0.6745 |x - median| / MAD over 3.5; zero where the MAD is."""
    base = with_mad(m).withColumn("raw_mad", F.col("mad") / 1.4826)
    n = m.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    rows = m.join(base, KEYS).join(n, KEYS).where(F.col("n") >= least)
    z = F.when(F.col("raw_mad") > 0, 0.6745 * F.abs(F.col("value") - F.col("median")) / F.col("raw_mad")).otherwise(0.0)
    return rows.select("event_id", *KEYS, F.tanh(z / 3.5).alias("score"))


def spc(m: DataFrame, most: int = 10, part: int = 3, sigmas: float = 3.0) -> DataFrame:
    """Distance from the control limits, ``sigmas`` deviations of the other readings around from their mean, as tanh(excess / 3).

    A reading inside the limits has score 0. Series too short for a window (of a
    third of their readings, 3 at least) are judged by their z-scores, as a whole.
    """
    rows = others_around(m, most, part).where("sd > 1e-9")
    d = r9(F.abs(F.col("value") - F.col("mean")) / F.col("sd")) - sigmas
    long = rows.select("event_id", *KEYS, F.tanh(F.greatest(d, F.lit(0.0)) / 3).alias("score"), (d > 0).alias("out_of_control"))
    n = F.count("value").over(group())
    short = zscore(m.withColumn("size", n).where(F.col("size") < 3 * part).drop("size"))
    return long.unionByName(short.withColumn("out_of_control", F.col("score") > float(math.tanh(sigmas / 3))))


def with_lof(rows: DataFrame, most: int = 20, least: int = 5) -> DataFrame:
    """``rows`` (with n, the size of the series) with ``lof``, the local outlier factor of each value in its series; null for series of k readings or fewer.

    k is a tenth of the series, at least ``least`` and at most ``most``. In one
    dimension the k nearest lie within k places in value order, so three windows
    over that order give distances, densities and the factor, without a join.
    """
    w = Window.partitionBy(*KEYS).orderBy("value", "event_id")
    k = F.least(F.lit(most), F.greatest(F.lit(least), F.floor(F.col("n") / 10))).cast("int")
    rows = rows.withColumn("nn", k).withColumn("at", F.row_number().over(w)).withColumn("lof_of", F.col("n") > F.col("nn"))

    def nearest(extra: str | None) -> Column:
        """The nn nearest others (d, id, x) by distance and id; x is their ``extra``."""
        entry = F.struct("value", "event_id", *([F.col(extra).alias("x")] if extra else []))
        seen = F.collect_list(entry).over(w.rowsBetween(-most, most))
        own = F.least("at", F.lit(most + 1))  # the place of the row itself in what is seen
        near = F.slice(seen, F.greatest(F.lit(1), own - F.col("nn")), F.col("nn") + F.least(own, F.col("nn") + 1))
        d = lambda s: F.struct(F.abs(s.value - F.col("value")).alias("d"), s.event_id.alias("id"), *([s.x.alias("x")] if extra else []))
        return F.slice(F.array_sort(F.transform(F.filter(near, lambda s: s.event_id != F.col("event_id")), d)), 1, F.col("nn"))

    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, s: a + f(s))
    rows = rows.withColumn("k_distance", F.when(F.col("lof_of"), F.get(nearest(None), F.col("nn") - 1).d))
    rows = rows.withColumn("density", F.when(F.col("lof_of"), F.col("nn") / F.greatest(total(nearest("k_distance"), lambda s: F.greatest(s.d, s.x)), F.lit(1e-10))))
    return rows.withColumn("lof", F.when(F.col("lof_of"), total(nearest("density"), lambda s: s.x) / F.col("nn") / F.col("density"))).drop("nn", "at", "lof_of", "k_distance", "density")


def lof(m: DataFrame) -> DataFrame:
    """Local outlier factor of the values of each series of more readings than neighbours."""
    rows = with_lof(m.where("value IS NOT NULL").withColumn("n", F.count(F.lit(1)).over(group())))
    return rows.where("lof IS NOT NULL").select("event_id", *KEYS, "lof")


def envelope_centers(m: DataFrame, share: float = 0.5) -> DataFrame:
    """The robust centre and spread of each series: of the h consecutive values (in order) of least variance, h = floor(n share) + 1."""
    w = Window.partitionBy(*KEYS).orderBy("value", "event_id")
    rows = m.withColumn("k", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(group())).where("n >= 5").withColumn("h", F.floor(F.col("n") * share).cast("int") + 1)
    s = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumn("s1", F.sum("value").over(s)).withColumn("s2", F.sum(F.col("value") * F.col("value")).over(s))
    before = sums.select(*KEYS, (F.col("k") + F.col("h")).alias("k"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    ends = sums.where("k >= h").join(before, [*KEYS, "k"], "left").fillna(0.0, ["b1", "b2"])
    mean = (F.col("s1") - F.col("b1")) / F.col("h")
    var = F.greatest((F.col("s2") - F.col("b2")) / F.col("h") - mean * mean, F.lit(0.0))
    best = ends.select(*KEYS, "k", mean.alias("center"), var.alias("spread")).groupBy(*KEYS).agg(F.min_by(F.struct("center", "spread"), F.struct(F.round("spread", 6), "k")).alias("b"))
    return best.select(*KEYS, "b.center", "b.spread")


def envelope(m: DataFrame, share: float = 0.5) -> DataFrame:
    """Distance of each value from its series' robust centre, in robust deviations."""
    d = F.abs(F.col("value") - F.col("center")) / F.sqrt("spread")
    return m.join(envelope_centers(m, share).where("spread > 1e-6"), KEYS).select("event_id", *KEYS, d.alias("distance"))


def with_residual(rows: DataFrame, most: int = 7, part: int = 3) -> DataFrame:
    """``rows`` (with k and n) with ``residual``: what is left when the mean of each phase is taken off; the period is n / ``part``, at most ``most``; null below 2."""
    rows = rows.withColumn("period", F.least(F.lit(most), F.floor(F.col("n") / part).cast("int"))).withColumn("phase", F.when(F.col("period") >= 2, F.col("k") % F.col("period")))
    return rows.withColumn("residual", F.when(F.col("period") >= 2, F.col("value") - F.avg("value").over(Window.partitionBy(*KEYS, "phase")))).drop("period", "phase")


def seasonal(m: DataFrame, most: int = 7, part: int = 3) -> DataFrame:
    """tanh of the residual (over its deviation, over three) after the mean of each phase of the series is taken off."""
    rows = m.where("value IS NOT NULL").withColumn("k", F.row_number().over(series())).withColumn("n", F.count(F.lit(1)).over(group()))
    rows = with_residual(rows, most, part).where("residual IS NOT NULL").withColumn("sd", F.stddev_pop("residual").over(group())).where("sd > 1e-9")
    return rows.select("event_id", *KEYS, F.tanh(F.abs(F.col("residual")) / F.col("sd") / 3).alias("score"))


#: The methods of the ensemble and what each gives per reading; the forest is left to those who ask for it.
METHODS = {
    "zscore": lambda m: zscore(m),
    "mad": lambda m: modified_z(m),
    "spc": lambda m: spc(m),
    "seasonal": lambda m: seasonal(m),
    "lof": lambda m: lof(m).withColumnRenamed("lof", "score"),
    "envelope": lambda m: envelope(m).withColumnRenamed("distance", "score"),
    "forest": lambda m: isolation_forest(m).join(m.select("event_id", "user_id"), "event_id"),
}
PLAIN = ("zscore", "mad", "spc", "seasonal", "lof", "envelope")


def method_columns(m: DataFrame) -> DataFrame:
    """A column of scores for each method of PLAIN, null where it gives none: all from one exchange by series, in order of time, then of value."""
    rows = m.where("value IS NOT NULL").select("event_id", *KEYS, "ts", "value")
    rows = with_others(rows)
    mu, spread = F.avg("value").over(group()), F.stddev_samp("value").over(group())
    rows = rows.withColumn("mu", mu).withColumn("spread", spread).withColumn("median", F.percentile("value", F.lit(0.5)).over(group()))
    rows = rows.withColumn("raw_mad", F.percentile(F.abs(F.col("value") - F.col("median")), F.lit(0.5)).over(group()))
    enough = F.col("n") >= 5
    zscore_ = F.when(enough & (F.col("spread") > 0), F.tanh(F.abs(F.col("value") - F.col("mu")) / F.col("spread") / 3))
    z = F.when(F.col("raw_mad") > 0, 0.6745 * F.abs(F.col("value") - F.col("median")) / F.col("raw_mad")).otherwise(0.0)
    beyond = r9(F.abs(F.col("value") - F.col("mean")) / F.col("sd")) - 3.0
    rows = rows.withColumn("zscore", zscore_).withColumn("mad", F.when(enough, F.tanh(z / 3.5)))
    rows = rows.withColumn("spc", F.when(F.col("n") < 9, F.col("zscore")).when(F.col("sd") > 1e-9, F.tanh(F.greatest(beyond, F.lit(0.0)) / 3)))
    rows = with_residual(rows).withColumn("residual_sd", F.stddev_pop("residual").over(group()))
    rows = rows.withColumn("seasonal", F.when(F.col("residual_sd") > 1e-9, F.tanh(F.abs("residual") / F.col("residual_sd") / 3)))
    rows = with_lof(rows.select("event_id", *KEYS, "value", "n", "zscore", "mad", "spc", "seasonal"))
    best = envelope_centers(m.where("value IS NOT NULL"))
    rows = rows.join(best.where("spread > 1e-6"), KEYS, "left").withColumn("envelope", F.abs(F.col("value") - F.col("center")) / F.sqrt("spread"))
    return rows.select("event_id", *KEYS, *PLAIN)


def ensemble(m: DataFrame, contamination: float = 0.1, methods: tuple[str, ...] = PLAIN) -> DataFrame:
    """Mean of the methods' scores (to four digits), each scaled to 0..1 per series; flagged above the series' percentile.

    Null values are left out, and so are readings to which no method gives a score.
    """
    rows = method_columns(m)
    for name in methods:
        if name not in PLAIN:
            rows = rows.join(METHODS[name](m).select("event_id", F.col("score").alias(name)), "event_id", "left")
    rows = rows.select("event_id", *KEYS, *[F.round(name, 4).alias(name) for name in methods])
    scaled = []
    for name in methods:
        low, high = F.min(name).over(group()), F.max(name).over(group())
        scaled.append(F.when(F.col(name).isNotNull(), F.when(high > low, (F.col(name) - low) / (high - low)).otherwise(0.0)))
    g = rows.withColumn("scaled", F.array_compact(F.array(*scaled))).where(F.size("scaled") > 0)
    g = g.select("event_id", *KEYS, (F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x) / F.size("scaled")).alias("score"), F.size("scaled").alias("methods"), F.size(F.filter("scaled", lambda x: x > 0.8)).alias("votes"))
    g = g.withColumn("threshold", F.round(F.percentile("score", F.lit(1 - contamination)).over(group()), 9))
    flag = F.round("score", 9) > F.col("threshold")
    confidence = F.least(F.lit(1.0), F.col("votes") / F.col("methods") + 0.3 * F.tanh(2 * F.col("score")))
    return g.select("event_id", *KEYS, "score", "threshold", flag.alias("is_anomaly"), confidence.alias("confidence"), (flag & (F.col("votes") >= F.greatest(F.lit(2.0), 0.7 * F.col("methods")))).alias("severe"))


def details(m: DataFrame) -> DataFrame:
    """Per series: readings, anomalies, severe ones, mean and top score."""
    return ensemble(m).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("anomalies"), F.count_if("severe").alias("severe"), r6(F.avg("score")).alias("mean_score"), r6(F.max("score")).alias("top_score"))


def simultaneous(m: DataFrame) -> DataFrame:
    """Days on which a person has anomalies of two types or more."""
    hits = ensemble(m).where("is_anomaly").select("event_id").join(m, "event_id")
    g = hits.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_join(F.array_sort(F.collect_set("metric_type")), ",").alias("types"), F.countDistinct("metric_type").alias("n_types"))
    return g.where("n_types >= 2")


def pattern_report(m: DataFrame) -> DataFrame:
    """Anomalies per type and hour, and how many follow another within three places of the series."""
    rows = m.withColumn("k", F.row_number().over(series()))
    hits = ensemble(m).where("is_anomaly").select("event_id").join(rows, "event_id")
    near = F.col("k") - F.lag("k").over(series()) <= 3
    return hits.withColumn("near", F.coalesce(near, F.lit(False))).groupBy("metric_type", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_if("near").alias("clustered"), r6(F.avg("value")).alias("mean_value"), F.max("value").alias("max_value"))


def isolation_forest(m: DataFrame, trees: int = 100, sample: int = 256, seed: int = 7) -> DataFrame:
    """Isolation scores of (hour, value) points of a type: bounded samples grow the trees, every reading is scored.

    A tree is a chain of random splits kept as an array of nodes; it needs
    ``sample`` rows of a type, so all trees are small whatever the input.
    """
    import numpy as np
    import pandas as pd

    def c(n: float) -> float:
        return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else (1.0 if n == 2 else 0.0)

    total = F.broadcast(m.groupBy("metric_type").agg(F.count(F.lit(1)).alias("total")))  # a row per type
    rows = m.select("metric_type", F.hour("ts").cast("double").alias("h"), F.col("value").alias("v"), F.xxhash64(F.lit(seed), "event_id").alias("u")).join(total, "metric_type")
    # by the hash, about four times the sample of each tree goes on to the exact choice; only the trees that take a row are made
    takes = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("u", t), F.lit(1_000_000)) * F.col("total") <= 4_000_000.0 * sample)
    picked = rows.select("metric_type", "h", "v", "u", F.explode(takes).alias("tree")).withColumn("u", F.xxhash64("u", "tree"))
    picked = picked.withColumn("k", F.row_number().over(Window.partitionBy("metric_type", "tree").orderBy("u"))).where(F.col("k") <= sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed + int(pdf["tree"].iloc[0]))
        x = pdf.sort_values("u")[["h", "v"]].to_numpy()
        nodes: list[list[float]] = []

        def split(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1.0, 0.0, depth + c(len(rows)), 0.0])
            spread = rows.max(0) - rows.min(0) if len(rows) > 1 else np.zeros(2)
            if len(rows) > 1 and depth < 8 and spread.any():
                f = int(rng.choice(np.flatnonzero(spread)))
                cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
                left = split(rows[rows[:, f] <= cut], depth + 1)
                right = split(rows[rows[:, f] > cut], depth + 1)
                nodes[at] = [float(f), cut, float(left), float(right)]
            return at

        split(x, 0)
        return pd.DataFrame({"metric_type": [pdf["metric_type"].iloc[0]], "size": [len(x)], "nodes": [np.array(nodes).ravel().tolist()]})

    forest = picked.groupBy("metric_type", "tree").applyInPandas(grow, "metric_type string, size int, nodes array<double>")
    # at most ``trees`` trees of 511 nodes per type: a type with data is a name, of which there are few
    grown: dict[str, tuple[int, list]] = {}
    for r in forest.collect():
        size, nodes = grown.get(r.metric_type, (0, []))
        grown[r.metric_type] = max(size, r["size"]), [*nodes, np.array(r.nodes).reshape(-1, 4)]
    shared = m.sparkSession.sparkContext.broadcast(grown)

    def score(batches):
        grown = shared.value
        for pdf in batches:
            out = np.zeros(len(pdf))
            x = pdf[["h", "v"]].to_numpy()
            for name, own in pdf.groupby("metric_type").indices.items():
                size, forest = grown[name]
                norm = max(c(size), 1e-9)
                depth = np.zeros(len(own))
                for nodes in forest:
                    at = np.zeros(len(own), int)
                    while True:
                        inner = nodes[at, 0] >= 0
                        if not inner.any():
                            break
                        f = np.maximum(nodes[at, 0], 0).astype(int)
                        go = np.where(x[own, f] <= nodes[at, 1], nodes[at, 2], nodes[at, 3]).astype(int)
                        at = np.where(inner, go, at)
                    depth += nodes[at, 2]
                out[own] = 2 ** (-depth / len(forest) / norm)
            yield pdf[["event_id", "metric_type"]].assign(score=out)

    rows = m.select("event_id", "metric_type", F.hour("ts").cast("double").alias("h"), F.col("value").alias("v")).where("metric_type IS NOT NULL")
    return rows.mapInPandas(score, "event_id long, metric_type string, score double")
