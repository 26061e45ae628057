"""A registry of models: one per metric type, stored with its version, errors and importance, and scored from the store."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseloom.operators.aggregates import r6

#: Clock features of a reading.
CLOCK = ["hour", "weekday"]
#: Types that are given a model at the most: the loop over them runs on the driver.
MOST_TYPES = 200
ROW = "metric_type string, version int, path string, algorithm string, trees int, n_train long, n_test long, rmse double, mse double, r2 double, importance map<string,double>"


def clock_rows(m: DataFrame) -> DataFrame:
    """Readings with the features of CLOCK, and whether they are in the test fifth (by a hash of the event)."""
    return m.where("metric_type IS NOT NULL AND value IS NOT NULL").select(
        "event_id", "metric_type", F.hour("ts").cast("double").alias("hour"), F.weekday("ts").cast("double").alias("weekday"), F.col("value").alias("label"), (F.pmod(F.xxhash64("event_id"), F.lit(5)) == 0).alias("test")
    )


def _assemble(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=CLOCK, outputCol="features").transform(rows)


class ModelRegistry:
    """Stored models and the table of their rows below ``location``; a model's folder is never written twice."""

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")

    def rows(self) -> DataFrame:
        """All rows, of all versions; none before the first training."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.location}/rows")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(ROW).parquet(f"{self.location}/rows") if there else self.spark.createDataFrame([], ROW)

    def active(self) -> DataFrame:
        """The newest row of each type."""
        return self.rows().groupBy("metric_type").agg(F.max_by(F.struct(*[f.split()[0] for f in ROW.split(", ")[1:]]), "version").alias("r")).select("metric_type", "r.*")

    def train(self, m: DataFrame, trees: int = 50, depth: int = 10, least: int = 100) -> DataFrame:
        """Fit, store and enter a new version of the model of each type with ``least`` readings; returns the new rows.

        A model's row is entered when its folder is complete, so a failed run
        leaves no row behind; the next one takes the same version again.
        """
        from pyspark.ml.regression import RandomForestRegressor

        rows = clock_rows(m)
        types = [r.metric_type for r in rows.groupBy("metric_type").count().where(F.col("count") >= least).orderBy("metric_type").limit(MOST_TYPES + 1).collect()]
        if len(types) > MOST_TYPES:
            raise ValueError(f"more than {MOST_TYPES} metric types")
        known = {r.metric_type: r.version for r in self.rows().groupBy("metric_type").agg(F.max("version").alias("version")).collect()}
        made = []
        for name in types:
            own = _assemble(rows.where(F.col("metric_type") == name)).persist()
            model = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=7).fit(own.where("NOT test"))
            version = known.get(name, 0) + 1
            path = f"{self.location}/models/{hash_text(name):08x}-{len(name)}/version-{version}-{uuid.uuid4().hex}"
            model.write().overwrite().save(path)
            e = F.col("prediction") - F.col("label")
            s = model.transform(own).groupBy().agg(
                F.count_if(~F.col("test")).alias("n_train"), F.count_if("test").alias("n_test"), F.avg(F.when(F.col("test"), e * e)).alias("mse"), F.var_pop(F.when(F.col("test"), F.col("label"))).alias("spread")
            ).first()
            own.unpersist()
            r2 = 1 - s.mse / s.spread if s.spread else None
            importance = dict(zip(CLOCK, model.featureImportances.toArray().tolist(), strict=True))
            made.append((name, version, path, "random_forest", trees, s.n_train, s.n_test, s.mse**0.5 if s.mse is not None else None, s.mse, r2, importance))
        fresh = self.spark.createDataFrame(made, ROW).coalesce(1)
        fresh.write.mode("append").parquet(f"{self.location}/rows")
        return self.spark.createDataFrame(made, ROW)

    def score(self, m: DataFrame) -> DataFrame:
        """(event_id, metric_type, version, prediction) of the readings whose type has a model, by its active version."""
        from pyspark.ml.regression import RandomForestRegressionModel

        rows, out = _assemble(clock_rows(m)), None
        for r in self.active().orderBy("metric_type").limit(MOST_TYPES).collect():
            one = RandomForestRegressionModel.load(r.path).transform(rows.where(F.col("metric_type") == r.metric_type)).select("event_id", "metric_type", F.lit(r.version).alias("version"), "prediction")
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "event_id long, metric_type string, version int, prediction double")


def hash_text(text: str) -> int:
    """A number for a name that is fit for a path, the same in every process."""
    return zlib.crc32(text.encode())


def registry_report(rows: DataFrame) -> DataFrame:
    """Rows of the registry as a flat table."""
    return rows.select("metric_type", "version", "algorithm", "trees", "n_train", "n_test", r6("rmse").alias("rmse"), r6("r2").alias("r2"), *[r6(F.col("importance")[c]).alias(f"importance_{c}") for c in CLOCK])
