"""Structured Streaming jobs over readings. Each takes a stream and gives one; ``drain`` runs it over what there is."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseloom.operators.aggregates import baselines
from pulseloom.operators.relations import score_against_baseline
from pulseloom.sources.readings import readings
from pulseloom.sources.shared import shared_path


def reading_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``events`` as a stream of files; times as timestamps, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return raw.select("event_id", "user_id", F.col("event_type").alias("metric_type"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("props").alias("meta"))


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is available into Parquet and read that.

    A batch that runs again after a failure overwrites its own folder.
    """
    spark = stream.sparkSession
    path = shared_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data/*")


def ingest(stream: DataFrame, late: str = "6 hours") -> DataFrame:
    """Readings without repeats of an event within the time that late data may take."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _window(stream: DataFrame, length: str, slide: str | None, late: str):
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length, slide) if slide else F.window("ts", length), "metric_type")


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("start_ts"), F.col("window.end").cast("timestamp_ntz").alias("end_ts"), *[c for c in df.columns if c != "window"])


def recent_activity(stream: DataFrame, exact: bool = True) -> DataFrame:
    """Readings and people per type over the last hour, every five minutes.

    Counted exactly, the state of an open window holds its people; else it is a
    sketch of a fixed size, with an error of about 2 %.
    """
    people = F.size(F.collect_set("user_id")) if exact else F.approx_count_distinct("user_id", 0.02)
    return _flat(_window(stream, "1 hour", "5 minutes", "1 hour").agg(F.count(F.lit(1)).alias("n"), people.alias("people")))


def tumbling_stats(stream: DataFrame, length: str = "1 day") -> DataFrame:
    """Count and range per type and window."""
    return _flat(_window(stream, length, None, "6 hours").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")))


def score_stream(stream: DataFrame, base: DataFrame, least: float = 2.0) -> DataFrame:
    """Readings that are ``least`` deviations off the stored baseline."""
    scored = score_against_baseline(stream, base).drop("mean", "sd")
    return scored.where(F.abs("z") >= least).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def session_stream(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each person."""
    g = stream.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start_ts"), F.col("session_window.end").cast("timestamp_ntz").alias("end_ts"), "n")


def rate_limit_stream(stream: DataFrame, limits: dict[str, int], hours: int = 24) -> DataFrame:
    """(user_id, severity, event_id, ts): which events pass; the window of a key opens anew with the first event after it ends."""
    span = hours * 3_600_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        passed = []
        for t in rows["t"]:
            if start is None or t - start >= span:
                start, count = int(t), 0
            count += 1
            passed.append(count <= limits[key[1]])
        state.update((start, count))
        yield pd.DataFrame({"user_id": key[0], "severity": key[1], "event_id": rows["event_id"], "passed": passed})

    keyed = stream.select("user_id", "severity", "event_id", F.unix_micros("ts").alias("t"))
    return keyed.groupBy("user_id", "severity").applyInPandasWithState(step, "user_id long, severity string, event_id long, passed boolean", "start long, count int", "append", "NoTimeout")


def refresh_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic job that makes the stored baselines anew when data has come: a run over what is available."""
    path = shared_path(spark, "baselines")

    def write(batch: DataFrame, batch_id: int) -> None:
        baselines(readings(batch.sparkSession, sf_dir)).write.mode("overwrite").parquet(f"{path}/data")

    reading_stream(spark, sf_dir).select("event_id").writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/data")

