"""Baselines kept up to date from what each batch brings, without reading earlier readings again.

The state is a table of partials per person and type: count, mean, sum of squared
deviations, least, largest, and a quantile sketch; all merge. Each batch writes a
new version of the table and then moves a pointer file to it in one step, so
readers see whole versions, and a batch that runs again finds itself applied.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseloom.operators.aggregates import KEYS
from pulseloom.sources.shared import shared_path

#: Accuracy of the sketches: quantiles are exact up to about so many readings of a series.
SKETCH_K = 200


def partials(m: DataFrame) -> DataFrame:
    """The state of the readings of a batch; rows with a null value count for nothing."""
    rows = m.where("value IS NOT NULL AND NOT isnan(value)")
    return rows.groupBy(*KEYS).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.kll_sketch_agg_double("value", F.lit(SKETCH_K)).alias("sketch"),
    )


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """The state of the readings of both sides."""
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in KEYS], "full")

    def either(c: str, of_both: Column) -> Column:
        return F.when(F.col("x.n").isNull(), F.col(f"y.{c}")).when(F.col("y.n").isNull(), F.col(f"x.{c}")).otherwise(of_both).alias(c)

    n, gap = F.col("x.n") + F.col("y.n"), F.col("y.mean") - F.col("x.mean")
    return both.select(
        *[F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in KEYS],
        either("n", n),
        either("mean", F.col("x.mean") + gap * F.col("y.n") / n),
        either("m2", F.col("x.m2") + F.col("y.m2") + gap * gap * F.col("x.n") * F.col("y.n") / n),
        either("low", F.least("x.low", "y.low")),
        either("high", F.greatest("x.high", "y.high")),
        either("sketch", F.kll_sketch_merge_double("x.sketch", "y.sketch")),
    )


def as_baselines(state: DataFrame, least: int = 3) -> DataFrame:
    """Baselines of series of ``least`` readings or more: moments, range and quartiles (values that were read)."""
    q = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    return state.where(F.col("n") >= least).select(*KEYS, "n", "mean", F.sqrt(F.col("m2") / (F.col("n") - 1)).alias("sd"), "low", "high", q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"))


class BaselineState:
    """Versions of the state below ``location``, and the pointer to the current one."""

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")

    def _files(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.location}/current")
        return jvm, path, path.getFileSystem(conf), conf

    def pointer(self) -> dict | None:
        """{"batch": the last batch applied, "version": its folder}; None before the first."""
        jvm, path, fs, _ = self._files()
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point(self, to: dict) -> None:
        """Write the pointer beside and rename it over the old one, which readers see before or after."""
        jvm, path, fs, conf = self._files()
        fresh = jvm.org.apache.hadoop.fs.Path(f"{self.location}/.next-{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        try:
            out.write(bytearray(json.dumps(to).encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf) if path.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, path, options)

    def table(self) -> DataFrame | None:
        at = self.pointer()
        return self.spark.read.parquet(f"{self.location}/{at['version']}") if at else None

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Merge a batch into the state. Batches come in order of their ids; one that has been applied changes nothing."""
        at = self.pointer()
        if at and batch_id <= at["batch"]:
            return
        fresh = partials(batch)
        state = merged(self.spark.read.parquet(f"{self.location}/{at['version']}"), fresh) if at else fresh
        version = f"version-{batch_id:012d}-{uuid.uuid4().hex}"
        state.write.parquet(f"{self.location}/{version}")
        self._point({"batch": batch_id, "version": version})
        self._drop_old(keep={version, at["version"] if at else version})

    def _drop_old(self, keep: set[str]) -> None:
        """Versions that are neither current nor the one before, which a reader may still hold."""
        _, path, fs, _ = self._files()
        for found in fs.listStatus(path.getParent()):
            name = found.getPath().getName()
            if name.startswith("version-") and name not in keep:
                fs.delete(found.getPath(), True)


def keep_baselines(stream: DataFrame, location: str) -> BaselineState:
    """Run a stream of readings over what is available, a merge for each micro-batch."""
    state = BaselineState(stream.sparkSession, f"{location}/state")
    stream.writeStream.foreachBatch(state.apply).option("checkpointLocation", f"{location}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return state


def readings_in_parts(spark: SparkSession, sf_dir: str, parts: int = 4) -> DataFrame:
    """The table ``events`` as a stream of several files in order of time, one of them a batch."""
    path = shared_path(spark, "event_parts")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("event_type").alias("metric_type"), "ts", "value")
    rows.repartitionByRange(parts, "ts").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
