"""Models over all people at once: forecasts, clusters, and multivariate scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseloom.functions.stats import normal_cdf
from pulseloom.operators.aggregates import KEYS, r6
from pulseloom.operators.density import dbscan
from pulseloom.operators.trends import forecast_features
from pulseloom.operators.windows import series
from pulseloom.sources.shared import staged

FEATURES = ["hour", "weekday", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "lag_1", "lag_2", "lag_3"]


def forecast_rows(m: DataFrame) -> DataFrame:
    """The rows of ``forecast_features`` that have all three lags, with their time, and the value as label."""
    return forecast_features(m, "ts").dropna(subset=["lag_1", "lag_2", "lag_3"]).withColumn("label", F.col("value"))


def _split(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feature rows with all lags, by time: the first four fifths of each series, and the rest.

    They are written once, behind one exchange by series, since a model reads them
    many times; files for every core, as the rounds of a model cost more than reading.
    """
    dealt = m.repartition(4 * m.sparkSession.sparkContext.defaultParallelism, *KEYS)
    rows = forecast_rows(dealt).withColumn("place", F.percent_rank().over(series()))
    rows = staged(rows.select("metric_type", "label", *FEATURES, "place"), "features")
    return rows.where("place < 0.8"), rows.where("place >= 0.8")


def _assembled(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol=out).transform(df)


def _quality(scored: DataFrame, model: str) -> DataFrame:
    e = F.col("prediction") - F.col("label")
    g = scored.groupBy("metric_type").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop("label") * F.count(F.lit(1)))).alias("r2"))
    return g.select("metric_type", F.lit(model).alias("model"), "n", r6("rmse").alias("rmse"), r6("mae").alias("mae"), r6("r2").alias("r2"))


def forecast_model(m: DataFrame, kind: str, trees: int = 100, rounds: int = 100) -> DataFrame:
    """One pooled model (ridge, forest or boosting) on lags and the clock; its errors on the last fifth of each series, by type."""
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    train, test = (_assembled(df, FEATURES, "raw") for df in _split(m))
    if train.isEmpty():
        return _quality(test.withColumn("prediction", F.lit(None).cast("double")), kind).limit(0)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    learner = {
        "ridge": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.0),
        "forest": lambda: RandomForestRegressor(numTrees=trees, maxDepth=10, seed=7),
        "boosting": lambda: GBTRegressor(maxIter=rounds, maxDepth=6, stepSize=0.1, seed=7),
    }[kind]()
    return _quality(learner.fit(scaler.transform(train)).transform(scaler.transform(test)), kind)


def global_models(m: DataFrame) -> DataFrame:
    """A forest on hour and weekday for all types (one-hot): error, r2 and sizes by type, as registry rows; an empty table gives none."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    from pyspark.ml.regression import RandomForestRegressor

    rows = m.where("metric_type IS NOT NULL").select("metric_type", F.hour("ts").cast("double").alias("hour"), F.weekday("ts").cast("double").alias("weekday"), F.col("value").alias("label"), (F.pmod(F.xxhash64("event_id"), F.lit(5)) == 0).alias("test"))
    if rows.where("NOT test").isEmpty():
        return _quality(rows.withColumn("prediction", F.lit(None).cast("double")), "forest_by_clock").limit(0)
    rows = StringIndexer(inputCol="metric_type", outputCol="type_index", stringOrderType="alphabetAsc").fit(rows).transform(rows)
    if rows.select("metric_type").distinct().count() > 1:
        rows = OneHotEncoder(inputCol="type_index", outputCol="type_code", dropLast=False).fit(rows).transform(rows)
    else:
        rows = rows.withColumn("type_code", F.col("type_index"))
    rows = _assembled(rows, ["hour", "weekday", "type_code"])
    model = RandomForestRegressor(numTrees=20, maxDepth=6, seed=7).fit(rows.where("NOT test"))
    return _quality(model.transform(rows.where("test")), "forest_by_clock")


def forecast_css(m: DataFrame, grid: tuple[float, ...] = (-0.6, -0.3, 0.0, 0.3, 0.6)) -> DataFrame:
    """ARIMA(1,1,1) by the least conditional sum of squares over a grid of (phi, theta); next step and AIC."""
    s = m.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x.value).alias("v")).where(F.size("v") >= 5)
    s = s.withColumn("d", F.transform(F.sequence(F.lit(1), F.size("v") - 1), lambda i: F.get("v", i) - F.get("v", i - 1)))
    s = s.withColumn("p", F.explode(F.array(*[F.struct(F.lit(a).alias("phi"), F.lit(b).alias("theta")) for a in grid for b in grid]))).select(*KEYS, "v", "d", "p.phi", "p.theta")

    def step(acc: Column, x: Column) -> Column:
        e = x - F.col("phi") * acc.before - F.col("theta") * acc.error
        return F.struct(x.alias("before"), e.alias("error"), (acc.sse + e * e).alias("sse"))

    start = F.struct(F.get("d", F.lit(0)).alias("before"), F.lit(0.0).alias("error"), F.lit(0.0).alias("sse"))
    s = s.withColumn("fit", F.aggregate(F.slice("d", 2, F.size("d") - 1), start, step)).withColumn("n", F.size("d") - 1)
    best = s.groupBy(*KEYS).agg(F.min_by(F.struct("phi", "theta", "fit", "n", F.element_at("v", -1).alias("last")), F.struct(F.round("fit.sse", 4), "phi", "theta")).alias("b"))
    ahead = F.col("b.last") + F.col("b.phi") * F.col("b.fit.before") + F.col("b.theta") * F.col("b.fit.error")
    aic = F.col("b.n") * F.log(F.greatest(F.col("b.fit.sse") / F.col("b.n"), F.lit(1e-12))) + 4
    return best.select(*KEYS, F.col("b.phi").alias("phi"), F.col("b.theta").alias("theta"), r6("b.fit.sse").alias("sse"), r6(ahead).alias("forecast"), r6(aic).alias("aic"))


def day_vectors(m: DataFrame, types: list[str]) -> DataFrame:
    """Daily mean of each of ``types`` per person, as features centred on the person; missing types are at the person's mean."""
    days = m.groupBy("user_id", F.to_date("ts").alias("day")).pivot("metric_type", types).agg(F.avg("value"))
    own = Window.partitionBy("user_id")
    return days.select("user_id", "day", *[F.coalesce(F.col(t) - F.avg(t).over(own), F.lit(0.0)).alias(t) for t in types])


def behaviour_clusters(m: DataFrame, types: list[str], most: int = 8) -> DataFrame:
    """k-means of scaled day vectors, k by the elbow: the first that gains less than half of what the one before gained ends the search.

    ``most`` clusters at the most, three where no gain falls by half, one for
    fewer than four days. An empty table gives no rows.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler

    rows = _assembled(day_vectors(m, types), types, "raw")
    n = rows.count()
    if n < 4:
        return rows.select("user_id", "day", *types, F.lit(0).alias("cluster"))
    rows = StandardScaler(inputCol="raw", outputCol="features").fit(rows).transform(rows).persist()
    spread = rows.agg(*[F.var_samp(t).alias(t) for t in types]).first()
    costs, models, k = [float((n - 1) * sum(spread[t] > 0 for t in types))], {}, 0  # each feature that varies has variance 1
    most = min(most, n // 2)
    for k in range(2, most + 1):
        models[k] = KMeans(k=k, seed=7, maxIter=15).fit(rows)
        costs.append(models[k].summary.trainingCost)
        if len(costs) > 2 and costs[-2] - costs[-1] < 0.5 * (costs[-3] - costs[-2]):
            k -= 1
            break
    else:
        k = min(3, most)
    rows.unpersist()
    return models[k].transform(rows).select("user_id", "day", *types, F.col("prediction").alias("cluster"))


def cluster_profile(clusters: DataFrame) -> DataFrame:
    """Size, share and centre of each cluster and feature, and whether it is off the whole by more than a deviation."""
    types = [c for c in clusters.columns if c not in ("user_id", "day", "cluster")]
    long = clusters.unpivot(["user_id", "day", "cluster"], types, "feature", "v")
    whole = long.groupBy("feature").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"), F.count(F.lit(1)).alias("total"))
    g = long.groupBy("cluster", "feature").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("center"), F.stddev_pop("v").alias("spread"))
    j = g.join(F.broadcast(whole), "feature")  # a row per feature
    return j.select("cluster", "feature", "n", r6(F.col("n") / F.col("total")).alias("share"), r6("center").alias("center"), r6("spread").alias("spread"), (F.abs(F.col("center") - F.col("mu")) > F.col("sd")).alias("stands_out"))


def density_days(m: DataFrame, types: list[str], eps: float = 0.5, least: int = 5) -> DataFrame:
    """Density clusters of each person's days by the daily means of ``types``, scaled over all days; -1 is noise."""
    days = day_vectors(m, types)
    # one row; a type that never varies is 0 on all days
    spread = days.agg(*[F.coalesce(F.nullif(F.stddev_pop(t), F.lit(0.0)), F.lit(1.0)).alias(f"sd_{k}") for k, t in enumerate(types)])
    scaled = days.join(F.broadcast(spread)).select("user_id", "day", _day_id().alias("id"), *[(F.col(t) / F.col(f"sd_{k}")).alias(f"z_{k}") for k, t in enumerate(types)])
    found = dbscan(scaled, [f"z_{k}" for k in range(len(types))], eps, least, id_col="id")
    return scaled.select("user_id", "day", "id").join(found, "id").select("user_id", "day", "core", "cluster")


def _day_id() -> Column:
    """A number for each person and day."""
    return F.col("user_id") * 1_000_000 + F.datediff("day", F.lit("1970-01-01").cast("date"))


def state_clusters(m: DataFrame, types: list[str]) -> DataFrame:
    """The best (by silhouette) of k-means and bisecting k-means on day vectors, for two to four clusters, and of density clusters: sizes.

    Density clusters count where at least half of the days are in some; their
    silhouette is that of those days, and -1 is noise. Where nothing falls into
    two clusters, all is one; an empty table gives no rows.
    """
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    rows = _assembled(day_vectors(m, types), types).persist()
    best = (0.0, "none", rows.withColumn("prediction", F.lit(0)))
    if rows.isEmpty():
        rows.unpersist()
        return _sizes(*best)
    for kind, make in (("kmeans", KMeans), ("bisecting", BisectingKMeans)):
        for k in (2, 3, 4):
            done = make(k=k, seed=7, maxIter=10).fit(rows).transform(rows)
            if done.select("prediction").distinct().count() < 2:
                continue
            score = ClusteringEvaluator().evaluate(done)
            if best[1] == "none" or score > best[0]:
                best = (score, kind, done)
    labels = density_days(m, types).select("user_id", "day", "cluster")
    dense = rows.join(labels, ["user_id", "day"]).withColumn("prediction", F.col("cluster").cast("double"))
    inside = dense.where("prediction >= 0")
    if 2 * inside.count() >= rows.count() and inside.select("prediction").distinct().count() > 1:
        score = ClusteringEvaluator().evaluate(inside)
        if best[1] == "none" or score > best[0]:
            best = (score, "density", dense)
    rows.unpersist()
    return _sizes(*best)


def _sizes(score: float, kind: str, done: DataFrame) -> DataFrame:
    return done.groupBy(F.col("prediction").cast("long").alias("cluster")).agg(F.count(F.lit(1)).alias("n")).withColumn("method", F.lit(kind)).withColumn("silhouette", F.lit(round(score, 6)))


def dbscan_1d(m: DataFrame, eps: float = 5.0, least: int = 3) -> DataFrame:
    """Density clusters of the values of each series; in one dimension they are runs of core points at most eps apart."""
    near = F.expr(f"count(1) OVER (PARTITION BY {', '.join(KEYS)} ORDER BY value RANGE BETWEEN {eps:.6f}D PRECEDING AND {eps:.6f}D FOLLOWING)")
    rows = m.withColumn("near", near).withColumn("core", F.col("near") >= least)
    o = Window.partitionBy(*KEYS).orderBy("value", "event_id")
    last = F.last(F.when(F.col("core"), F.col("value")), True).over(o.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.when(F.col("core") & (last.isNull() | (F.col("value") - last > eps)), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("fresh").over(o)).withColumn("back", last)
    back = Window.partitionBy(*KEYS).orderBy(F.desc("value"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.last(F.when(F.col("core"), F.struct("value", "run")), True).over(back)
    rows = rows.withColumn("ahead", ahead)
    cluster = F.when(F.col("core"), F.col("run")).when(F.col("value") - F.col("back") <= eps, F.col("run")).when(F.col("ahead.value") - F.col("value") <= eps, F.col("ahead.run")).otherwise(-1)
    return rows.select("event_id", *KEYS, "value", "core", cluster.cast("long").alias("cluster"))


def motifs(m: DataFrame, length: int = 4, k: int = 3) -> DataFrame:
    """k-means of the scaled windows of ``length`` readings of each series: how often each shape comes, and its mean. A series that doesn't vary is flat at 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    own = Window.partitionBy(*KEYS)
    sd, gap = F.stddev_pop("value").over(own), F.col("value") - F.avg("value").over(own)
    z = F.when(sd > 0, gap / sd).when(sd == 0, 0.0 * gap)
    rows = m.withColumn("z", z).withColumn("shape", F.collect_list("z").over(series().rowsBetween(0, length - 1))).where(F.size("shape") == length)
    rows = rows.select("metric_type", "shape", array_to_vector("shape").alias("features"))
    if rows.isEmpty():
        return rows.groupBy("metric_type", F.lit(0).alias("motif")).agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg(F.get("shape", F.lit(i)))).alias(f"at_{i}") for i in range(length)])
    done = KMeans(k=k, seed=7, maxIter=10).fit(rows).transform(rows)
    return done.groupBy("metric_type", F.col("prediction").alias("motif")).agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg(F.get("shape", F.lit(i)))).alias(f"at_{i}") for i in range(length)])


def mahalanobis(m: DataFrame, a: str, b: str) -> DataFrame:
    """Distance of each day's means of two types from the person-free centre, by the closed form of two dimensions."""
    rows = m.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg(F.when(F.col("metric_type") == a, F.col("value"))).alias("x"), F.avg(F.when(F.col("metric_type") == b, F.col("value"))).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    c = rows.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("vxy"))
    j = rows.join(F.broadcast(c.withColumn("one", F.lit(1))), F.col("one") == 1)  # one row
    dx, dy, det = F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.col("vx") * F.col("vy") - F.col("vxy") * F.col("vxy")
    t2 = (F.col("vy") * dx * dx - 2 * F.col("vxy") * dx * dy + F.col("vx") * dy * dy) / det
    return j.where(det > 0).select("user_id", "day", r6(t2).alias("t2"), r6(F.exp(-t2 / 2)).alias("p"), (F.round(t2, 6) > 11.618286).alias("is_anomaly"))


def contextual(m: DataFrame) -> DataFrame:
    """Residual of each value from a forest on the clock and lags, over the 95th percentile of its type."""
    from pyspark.ml.regression import RandomForestRegressor

    rows = forecast_features(m).dropna(subset=["lag_1", "lag_2", "lag_3"]).withColumn("label", F.col("value"))
    rows = _assembled(rows, FEATURES)
    if rows.isEmpty():
        return rows.select("event_id", *KEYS, F.lit(0.0).alias("score"), F.lit(False).alias("is_anomaly"))
    scored = RandomForestRegressor(numTrees=100, maxDepth=6, seed=7).fit(rows).transform(rows).withColumn("residual", F.abs(F.col("prediction") - F.col("label")))
    limit = scored.groupBy("metric_type").agg(F.percentile("residual", F.lit(0.95)).alias("limit"))
    return scored.join(F.broadcast(limit), "metric_type").select("event_id", *KEYS, r6(F.least(F.lit(1.0), F.col("residual") / F.col("limit"))).alias("score"), (F.col("residual") > F.col("limit")).alias("is_anomaly"))


def dagostino(n: Column, g1: Column, g2: Column) -> Column:
    """The omnibus K2 of n values of skewness g1 and excess kurtosis g2."""
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (b2 - 1))
    a = F.sqrt(2 / (w2 - 1))
    z1 = 1 / F.sqrt(F.log(F.sqrt(w2))) * F.log(y / a + F.sqrt(y * y / (a * a) + 1))
    mean, var = -6 / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 - mean) / F.sqrt(var)
    beta = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    h = 6 + 8 / beta * (2 / beta + F.sqrt(1 + 4 / (beta * beta)))
    z2 = ((1 - 2 / (9 * h)) - F.cbrt((1 - 2 / h) / (1 + x * F.sqrt(2 / (h - 4))))) / F.sqrt(2 / (9 * h))
    return z1 * z1 + z2 * z2


def normality(m: DataFrame, buckets: int = 1024) -> DataFrame:
    """D'Agostino-Pearson K2 and Anderson-Darling A2 of each type's values, and whether both see normal values at 5 %.

    Equal values are counted first, then numbered within ``buckets`` ranges of the
    fitted normal, whose sizes give the number before each: no task sorts a type.
    Nulls are left out; types of fewer than 20 values have no row.
    """
    rows = m.where("value IS NOT NULL")
    moments = rows.groupBy("metric_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2")
    ).where("n >= 20 AND sd > 0")
    z = (F.col("value") - F.col("mean")) / F.col("sd")
    cdf = F.least(F.greatest(normal_cdf(z), F.lit(1e-12)), F.lit(1 - 1e-12))
    counts = rows.groupBy("metric_type", "value").agg(F.count(F.lit(1)).alias("c")).join(moments, "metric_type").withColumn("cdf", cdf).withColumn("bucket", F.floor(F.col("cdf") * buckets))
    sizes = counts.groupBy("metric_type", "bucket").agg(F.sum("c").alias("size"))
    sizes = sizes.withColumn("start", F.sum("size").over(Window.partitionBy("metric_type").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).drop("size")
    inside = Window.partitionBy("metric_type", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("until", F.sum("c").over(inside)).join(sizes, ["metric_type", "bucket"])
    before = F.col("start") + F.col("until") - F.col("c")
    # sums of 2i - 1 and 2(n - i) + 1 over the c numbers that equal values take
    parts = F.col("c") * (2 * before + F.col("c")) * F.log("cdf") + F.col("c") * (2 * F.col("n") - 2 * before - F.col("c")) * F.log(1 - F.col("cdf"))
    g = placed.groupBy("metric_type", "n", "g1", "g2").agg((-F.col("n") - F.sum(parts) / F.col("n")).alias("a2"))
    n, k2 = F.col("n").cast("double"), dagostino(F.col("n").cast("double"), F.col("g1"), F.col("g2"))
    return g.select("metric_type", "n", r6(k2).alias("k2"), r6(F.exp(-k2 / 2)).alias("p"), r6("a2").alias("a2"), ((F.exp(-k2 / 2) > 0.05) & (F.col("a2") * (1 + 0.75 / n + 2.25 / n / n) < 0.752)).alias("is_normal"))


def pattern_summary(clusters: DataFrame, associations: DataFrame) -> DataFrame:
    """Patterns of both kinds with a confidence and whether it is enough to store."""
    a = clusters.groupBy("cluster").agg(F.max("share").alias("confidence")).select(F.lit("behaviour").alias("kind"), F.col("cluster").cast("string").alias("pattern"), "confidence")
    b = associations.select(F.lit("association").alias("kind"), F.concat_ws("~", "m1", "m2").alias("pattern"), F.abs("r").alias("confidence"))
    return a.unionByName(b).withColumn("stored", F.col("confidence") >= F.when(F.col("kind") == "behaviour", 0.3).otherwise(0.6))

