"""Nested device payloads to long readings, and checks of incoming records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

VALUE = "struct<timestamp:bigint,value:string>"
GRAPH = f"struct<data:array<{VALUE}>>"
PAYLOAD = (
    "struct<data:struct<metric_data:array<struct<type:string,object:struct<values:array<" + VALUE + ">,value:string,score:string,avg:string,day_start_timestamp:bigint,"
    f"hr_graph:{GRAPH},hrv_graph:{GRAPH},temp_graph:{GRAPH},movement_graph:{GRAPH}>>>>>"
)
#: Payload type to metric type and unit.
TYPES = {"hr": ("heart_rate", "bpm"), "hrv": ("hrv", "ms"), "temp": ("skin_temperature", "celsius"), "steps": ("steps", "count"), "spo2": ("blood_oxygen", "percent"), "glucose": ("glucose", "mg/dl"), "motion": ("movement", "count")}
#: Payload type to the field of the day's record that its single value fills; active minutes may come as a list, and are summed.
DAYS = {
    "active_minutes": "active_minutes", "recovery": "recovery_score", "recovery_index": "recovery_score", "glucose": "average_glucose", "average_glucose": "average_glucose", "glucose_variability": "glucose_variability",
    "metabolic_score": "metabolic_score", "hba1c": "hba1c", "time_in_target": "time_in_target", "movement_index": "movement_index", "vo2_max": "vo2_max", "avg_sleep_hrv": "avg_sleep_hrv", "sleep_score": "sleep_score",
}
DAY_FIELDS = tuple(dict.fromkeys(DAYS.values()))
GRAPHS = {"hr_graph": ("heart_rate", "bpm"), "hrv_graph": ("hrv", "ms"), "temp_graph": ("skin_temperature", "celsius"), "movement_graph": ("movement", "count")}


def _map(values: dict[str, tuple[str, str]], k: int) -> Column:
    return F.create_map(*[F.lit(x) for name, v in values.items() for x in (name, v[k])])


def entries(raw: DataFrame) -> DataFrame:
    """(user_id, type, object) of each entry of the payloads (user_id, payload); what can't be parsed gives none."""
    parsed = raw.select("user_id", F.from_json("payload", PAYLOAD).alias("p"))
    return parsed.select("user_id", F.explode("p.data.metric_data").alias("e")).select("user_id", "e.type", "e.object")


def _series(rows: DataFrame, metric: Column, unit: Column) -> DataFrame:
    out = rows.select("user_id", metric.alias("metric_type"), F.timestamp_seconds("v.timestamp").cast("timestamp_ntz").alias("ts"), F.col("v.value").try_cast("double").alias("value"), unit.alias("unit"))
    return out.where("metric_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")


def normalise_series(raw: DataFrame) -> DataFrame:
    """Series rows of the known types; entries without value or time, or with a value that is no number, are left out."""
    rows = entries(raw).select("user_id", "type", F.explode("object.values").alias("v"))
    return _series(rows, _map(TYPES, 0)[F.lower("type")], _map(TYPES, 1)[F.lower("type")])


def normalise_days(raw: DataFrame) -> DataFrame:
    """One row per person and day: mean heart rate, temperature and variability, sum of steps, and the single values of DAYS."""
    e = entries(raw).withColumn("kind", F.lower("type"))
    number = lambda c: F.col(c).try_cast("double")
    summed = F.aggregate(F.transform("object.values", lambda v: F.coalesce(v.value.try_cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    value = F.coalesce(number("object.score"), number("object.value"), F.when((F.col("kind") == "active_minutes") & (F.size("object.values") > 0), summed))
    field = F.create_map(*[F.lit(x) for kv in DAYS.items() for x in kv])[F.col("kind")]
    one = lambda at, field, value: F.struct(F.to_date(F.timestamp_seconds(at)).alias("day"), field.alias("field"), value.alias("value"))
    single = one(F.col("object.day_start_timestamp"), field, value)
    # a payload is parsed once: an entry gives its single value and those of its series
    readings = F.transform("object.values", lambda v: one(v.timestamp, F.concat(F.lit("series of "), _map(TYPES, 0)[F.col("kind")]), v.value.try_cast("double")))
    rows = e.select("user_id", F.explode(F.concat(F.array(single), F.coalesce(readings, F.array().cast("array<struct<day:date,field:string,value:double>>")))).alias("r"))
    rows = rows.select("user_id", "r.*").where("field IS NOT NULL AND day IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
    of = lambda f: F.when(F.col("field") == f, F.col("value"))
    mean = lambda t: F.round(F.avg(of(f"series of {t}")), 6)
    return rows.groupBy("user_id", "day").agg(
        mean("heart_rate").alias("resting_heart_rate"), mean("hrv").alias("hrv"), mean("skin_temperature").alias("skin_temperature"), F.round(F.sum(of("series of steps")), 6).alias("steps"),
        *[F.round(F.max(of(f)), 6).alias(f) for f in DAY_FIELDS],
    )


def extract_graphs(raw: DataFrame) -> DataFrame:
    """Series rows of the graphs of sleep entries."""
    graphs = F.array(*[F.struct(F.lit(g).alias("g"), F.col(f"object.{g}.data").alias("data")) for g in GRAPHS])
    rows = entries(raw).where(F.lower("type") == "sleep").select("user_id", F.explode(graphs).alias("x")).select("user_id", "x.g", F.explode("x.data").alias("v"))
    return _series(rows, _map(GRAPHS, 0)[F.col("g")], _map(GRAPHS, 1)[F.col("g")])


def normalise_legacy(raw: DataFrame) -> DataFrame:
    """Payloads with other spellings, as one object or a list of them, to series rows."""
    item = "struct<type:string,metric:string,name:string,value:string,val:string,timestamp:bigint,ts:bigint,time:bigint>"
    as_list = F.when(F.ltrim("payload").startswith("["), F.from_json("payload", f"array<{item}>")).otherwise(F.array(F.from_json("payload", item)))
    x = raw.select("user_id", F.explode(as_list).alias("i"))
    kind = F.lower(F.coalesce("i.type", "i.metric", "i.name"))
    v = F.struct(F.coalesce("i.timestamp", "i.ts", "i.time").alias("timestamp"), F.coalesce("i.value", "i.val").alias("value")).alias("v")
    return _series(x.select("user_id", kind.alias("kind"), v), _map(TYPES, 0)[F.col("kind")], _map(TYPES, 1)[F.col("kind")])


#: Spellings of the keys of a reading, first come first.
SPELLINGS = {"kind": ("type", "metric", "name"), "value": ("value", "val"), "timestamp": ("timestamp", "ts", "time")}


def normalise_variant(raw: DataFrame, depth: int = 3) -> DataFrame:
    """Payloads (user_id, payload) with other spellings to series rows, whatever their shape: an object, a list, lists in lists to ``depth``.

    Values may be numbers or text. What is no JSON gives no row, and neither does
    an item of another kind, without a known type, or without value or time.
    """
    whole = "array<variant>"
    items = raw.select("user_id", F.try_parse_json("payload").alias("i")).where("i IS NOT NULL")
    for _ in range(depth):  # a list gives its items, anything else itself
        items = items.select("user_id", F.explode(F.coalesce(F.try_variant_get("i", "$", whole), F.array("i"))).alias("i"))
    of = lambda name, kind: F.coalesce(*[F.try_variant_get("i", f"$.{k}", kind) for k in SPELLINGS[name]])
    v = F.struct(of("timestamp", "bigint").alias("timestamp"), of("value", "string").alias("value")).alias("v")
    x = items.select("user_id", F.lower(of("kind", "string")).alias("kind"), v)
    return _series(x, _map(TYPES, 0)[F.col("kind")], _map(TYPES, 1)[F.col("kind")])


def to_long(records: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Wide records (user_id, ts, fields) to a row per field that has a value, with unit and provenance."""
    items = F.filter(F.array(*[F.struct(F.lit(c).alias("metric_type"), F.col(c).cast("double").alias("value"), F.lit(u).alias("unit")) for c, u in fields.items()]), lambda s: s.value.isNotNull())
    rows = records.select("user_id", "ts", F.explode(items).alias("x"))
    return rows.select("user_id", "ts", "x.metric_type", "x.value", "x.unit", F.to_json(F.struct(F.lit("wide").alias("source"), F.col("x.metric_type").alias("field"))).alias("meta"))


def derive_sleep(records: DataFrame) -> DataFrame:
    """Deep and REM shares, bed time and wake time as decimal hours from (bed_ts, total, deep, rem minutes)."""
    hour = lambda c: F.round(F.hour(c) + F.minute(c) / 60, 6)
    share = lambda c: F.when(F.col("total") > 0, F.round(F.col(c) / F.col("total") * 100, 6))
    wake = F.col("bed_ts") + F.make_interval(mins=F.floor("total").cast("int"))
    return records.select("user_id", "bed_ts", share("deep").alias("deep_percent"), share("rem").alias("rem_percent"), hour("bed_ts").alias("bed_hour"), hour(wake).alias("wake_hour"))


def explode_stages(records: DataFrame) -> DataFrame:
    """Stages (array of stage, minutes, started) to duration and start rows per stage."""
    s = records.select("user_id", F.explode("stages").alias("s"))
    two = F.array(
        F.struct(F.concat("s.stage", F.lit("_sleep_duration")).alias("metric_type"), F.col("s.minutes").cast("double").alias("value")),
        F.struct(F.concat("s.stage", F.lit("_sleep_start_time")).alias("metric_type"), F.round(F.hour("s.started") + F.minute("s.started") / 60, 6).alias("value")),
    )
    return s.select("user_id", F.col("s.started").alias("ts"), F.explode(two).alias("x")).select("user_id", "ts", "x.metric_type", "x.value")


#: Accepted forms of a time as text.
TIME_FORMS = ("yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def parse_time(text: Column) -> Column:
    """A time in one of the accepted forms; null for others."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMS]).cast("timestamp_ntz")


def validate(records: DataFrame) -> DataFrame:
    """Records (record_id, user_id, metric_type, value, timestamp as text) with their errors, sorted."""
    number = F.col("value").try_cast("double")
    checks = F.array(
        F.when(F.col("user_id").isNull(), "missing user_id"), F.when(F.coalesce(F.trim("metric_type"), F.lit("")) == "", "blank metric_type"),
        F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), "value is no finite number"), F.when(parse_time(F.col("timestamp")).isNull(), "timestamp can't be read"),
    )
    errors = F.array_compact(checks)
    return records.select("record_id", F.array_join(errors, "; ").alias("errors"), (F.size(errors) == 0).alias("valid"))


def json_fill_rate(docs: DataFrame, column: str) -> DataFrame:
    """Per group and key of a flat JSON object: how many rows have a value."""
    pairs = docs.select("metric_type", F.explode(F.from_json(column, "map<string,string>")).alias("key", "v"))
    total = docs.groupBy("metric_type").agg(F.count(F.lit(1)).alias("rows"))
    g = pairs.groupBy("metric_type", "key").agg(F.count_if(F.col("v").isNotNull()).alias("filled"))
    return g.join(total, "metric_type").withColumn("rate", F.round(F.col("filled") / F.col("rows"), 6))
