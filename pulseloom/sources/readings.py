"""Readings: one long table (event_id, user_id, metric_type, ts, value, meta) over all people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseloom.sources.tables import table

#: The moment that windows such as "the last 7 days" count back from.
AS_OF = "2024-01-31 00:00:00"


def as_of(when: str = AS_OF) -> Column:
    return F.lit(when).cast("timestamp_ntz")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``events`` as readings."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("metric_type"), "ts", "value", F.col("props").alias("meta"))


def scan(m: DataFrame, user: int | None = None, types: list[str] | None = None, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """Readings of a person, of types, of a time range (both ends included) with a value; newest first where limited."""
    m = m.where(F.col("value").isNotNull())
    if user is not None:
        m = m.where(F.col("user_id") == user)
    if types:
        m = m.where(F.col("metric_type").isin(types))
    if start:
        m = m.where(F.col("ts") >= as_of(start))
    if end:
        m = m.where(F.col("ts") <= as_of(end))
    return m.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit) if limit else m
