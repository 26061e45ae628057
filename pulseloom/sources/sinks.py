"""Upserts, retention, removal, export and audits of stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: str, mode: str = "update") -> DataFrame:
    """``target`` after a batch: of repeated keys in the batch the last by ``order`` counts.

    ``update`` puts the batch's row in place of an old one, ``ignore`` keeps the
    old one. Applying a batch twice is the same as once.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    new = batch.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    new = new.select(*target.columns)
    if mode == "ignore":
        return target.unionByName(new.join(target.select(*keys), keys, "left_anti").select(*target.columns))
    return target.join(new.select(*keys), keys, "left_anti").select(*target.columns).unionByName(new)


def retain(rows: DataFrame, cutoff: str, resolved: str = "is_resolved", ts: str = "created_at") -> DataFrame:
    """Rows that stay: those from the cutoff on, and older ones that aren't resolved."""
    return rows.where(~(F.col(resolved) & (F.col(ts) < F.lit(cutoff).cast("timestamp_ntz"))))


def purge_users(table: DataFrame, ids: DataFrame) -> DataFrame:
    """A table without the rows of the given people."""
    return table.join(ids, "user_id", "left_anti")


def chunk_ranges(ranges: DataFrame, days: int, most: int) -> DataFrame:
    """(user_id, start, end) dates to chunks of ``days``, over the last ``most`` days at the most."""
    first = F.greatest("start", F.date_sub("end", most))
    rows = ranges.select("user_id", "end", F.explode(F.sequence(first, F.date_sub("end", 1), F.expr(f"INTERVAL {days} DAYS"))).alias("chunk_start"))
    return rows.select("user_id", "chunk_start", F.least(F.date_add("chunk_start", days), F.col("end")).alias("chunk_end"))


def json_safe(rows: DataFrame) -> DataFrame:
    """Non-finite numbers become null and times ISO text, so that the rows can go into JSON."""
    out = []
    for c, t in rows.dtypes:
        if t in ("double", "float"):
            out.append(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c))
        elif t.startswith("timestamp"):
            out.append(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c))
        else:
            out.append(F.col(c))
    return rows.select(*out)


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of tables."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def export_users(readings: DataFrame, alerts: DataFrame) -> DataFrame:
    """One nested JSON object per person: counts by type, and alerts in order of time."""
    r = readings.groupBy("user_id", "metric_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("metric_type", "n"))).alias("readings"))
    at = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    a = alerts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(at.alias("created_at"), "event_id", "severity"))).alias("alerts"))
    none = F.array().cast("array<struct<created_at:string,event_id:bigint,severity:string>>")
    return r.join(a, "user_id", "left").select("user_id", F.to_json(F.struct("user_id", "readings", F.coalesce("alerts", none).alias("alerts"))).alias("document"))


def export_records(readings: DataFrame, alerts: DataFrame, reports: DataFrame, interventions: DataFrame) -> DataFrame:
    """(user_id, section, document): all that there is of each person, a JSON object per record of the sections profile, metrics, alerts, reports and interventions.

    A person's records are rows, not one object, so a person of many readings is
    gathered nowhere; written by ``write_export`` they are a folder of lines per
    person. Rows without a person are left out; fields without a value are null.
    """
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)

    def section(rows: DataFrame, name: str, *fields) -> DataFrame:
        document = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
        return rows.where("user_id IS NOT NULL").select("user_id", F.lit(name).alias("section"), document.alias("document"))

    profile = readings.groupBy("user_id").agg(F.min("ts").alias("onboarded_at"), F.count(F.lit(1)).alias("readings"), F.array_sort(F.collect_set("metric_type")).alias("types"))
    parts = [
        section(profile, "profile", "user_id", iso("onboarded_at"), "readings", "types"),
        section(readings, "metrics", "event_id", "metric_type", "value", iso("ts")),
        section(alerts, "alerts", "event_id", "severity", iso("created_at"), "is_resolved"),
        section(reports, "reports", F.col("report_date").cast("string").alias("report_date"), "text", "confidence"),
        section(interventions, "interventions", "category", iso("started_at"), iso("ended_at")),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_export(records: DataFrame, path: str) -> None:
    """Records as JSON lines, a folder per person and section."""
    records.repartition("user_id", "section").write.mode("overwrite").partitionBy("user_id", "section").text(path)


def write_partitioned(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Readings as Parquet, a folder per date, sorted by person within files."""
    rows.withColumn("date", F.to_date(ts)).repartition("date").sortWithinPartitions("user_id", ts).write.mode("overwrite").partitionBy("date").parquet(path)
