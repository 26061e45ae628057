"""Queries of sources, sinks, sets and name look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom.functions import names
from pulseloom.operators import outcomes as Y
from pulseloom.operators import text as X
from pulseloom.plans.notes import METRIC_ROWS, messages
from pulseloom.plans.outcomes import ALERTS
from pulseloom.operators.relations import interventions
from pulseloom.plans import registry
from pulseloom.plans.registry import register, register_tables
from pulseloom.plans.relational import INTERVENTIONS
from pulseloom.sources import payloads as S, sinks as K
from pulseloom.sources.readings import readings
from pulseloom.sources.tables import table

#: How the event types stand for payload types.
AS_TYPE = {"click": "hr", "view": "hrv", "purchase": "steps", "error": "temp"}
NAMES = "CASE metric_type WHEN 'click' THEN 'heart_rate' WHEN 'view' THEN 'hrv' WHEN 'purchase' THEN 'steps' WHEN 'error' THEN 'skin_temperature' END"
UNITS = "CASE metric_type WHEN 'click' THEN 'bpm' WHEN 'view' THEN 'ms' WHEN 'purchase' THEN 'count' WHEN 'error' THEN 'celsius' END"


#: Payload types that fill a field of the day; of two that fill the same one the last has the larger value.
SINGLE = tuple(t for t in S.DAYS if t not in ("glucose",))


GRAPH_NAMES = tuple(S.GRAPHS)


def payload(m):
    """Device payloads made of a person's events of a day: four value lists, signups as a sleep graph, and the single values of the day, made of the largest one."""
    kind = F.create_map(*[F.lit(x) for kv in AS_TYPE.items() for x in kv])
    v = F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), F.when(F.col("event_id") % 97 == 0, "abc").otherwise(F.col("value").cast("string")).alias("value"))
    which = F.when(F.col("metric_type") == "signup", F.pmod("event_id", F.lit(4))).alias("graph")
    g = m.groupBy("user_id", F.to_date("ts").alias("day"), "metric_type", which).agg(F.collect_list(v).alias("values"), F.max("value").alias("top"))
    # signups make the graphs of a sleep entry, one of the four by the number of the event
    graph = lambda k: F.when((F.col("metric_type") == "signup") & (F.col("graph") == k), F.struct(F.col("values").alias("data"))).alias(GRAPH_NAMES[k])
    none = F.lit(None)
    obj = F.struct(F.when(F.col("metric_type") != "signup", F.col("values")).alias("values"), *[graph(k) for k in range(4)], none.cast("string").alias("value"), none.cast("string").alias("score"), none.cast("bigint").alias("day_start_timestamp"))
    g = g.select("user_id", "day", F.struct(F.coalesce(kind[F.col("metric_type")], F.lit("Sleep")).alias("type"), obj.alias("object")).alias("e"), "top")
    g = g.groupBy("user_id", "day").agg(F.collect_list("e").alias("metric_data"), F.max("top").alias("top"))
    at = F.unix_seconds(F.col("day").cast("timestamp"))

    def single(i, t):
        v = (F.col("top") + i).cast("string")
        o = F.struct(none.cast(g.schema["metric_data"].dataType.elementType["object"].dataType["values"].dataType).alias("values"), *[none.cast(g.schema["metric_data"].dataType.elementType["object"].dataType[c].dataType).alias(c) for c in GRAPH_NAMES], F.when(F.lit(t != "recovery"), v).alias("value"), F.when(F.lit(t == "recovery"), v).alias("score"), at.alias("day_start_timestamp"))
        return F.struct(F.lit(t).alias("type"), o.alias("object"))

    g = g.withColumn("metric_data", F.concat("metric_data", F.array(*[single(i, t) for i, t in enumerate(SINGLE)])))
    return g.select("user_id", F.to_json(F.struct(F.struct("metric_data").alias("data"))).alias("payload"))


def legacy(m):
    """Payloads of one reading each, with other spellings, every second one as a list."""
    kind = F.create_map(*[F.lit(x) for kv in AS_TYPE.items() for x in kv])
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    one = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.upper(kind[F.col("metric_type")]).alias("metric"), F.col("value").alias("val"), at.alias("ts")))).otherwise(F.to_json(F.struct(kind[F.col("metric_type")].alias("type"), "value", at.alias("timestamp"))))
    return m.where("metric_type <> 'signup'").select("user_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), one, F.lit("]"))).otherwise(one).alias("payload"))


SEC = "date_trunc('second', ts)"
register("src_2_normalise_series", lambda m: S.normalise_series(payload(m)), f"SELECT user_id, {NAMES} AS metric_type, {SEC} AS ts, value, {UNITS} AS unit FROM m WHERE metric_type <> 'signup' AND event_id % 97 <> 0")
register("src_2_normalise_days", lambda m: S.normalise_days(payload(m)), """
SELECT user_id, ts::DATE AS day, round(avg(value) FILTER (metric_type = 'click'), 6) AS resting_heart_rate, round(avg(value) FILTER (metric_type = 'view'), 6) AS hrv, round(avg(value) FILTER (metric_type = 'error'), 6) AS skin_temperature,
round(sum(value) FILTER (metric_type = 'purchase'), 6) AS steps, """.replace("value) FILTER (metric_type", "value) FILTER (event_id % 97 <> 0 AND metric_type") + ", ".join(f"round(max(value) + {max(i for i, t in enumerate(SINGLE) if S.DAYS[t] == f)}, 6) AS {f}" for f in S.DAY_FIELDS) + " FROM m GROUP BY 1, 2")
register("src_3_extract_graphs", lambda m: S.extract_graphs(payload(m)), f"SELECT user_id, CASE event_id % 4 WHEN 0 THEN 'heart_rate' WHEN 1 THEN 'hrv' WHEN 2 THEN 'skin_temperature' ELSE 'movement' END AS metric_type, {SEC} AS ts, value, CASE event_id % 4 WHEN 0 THEN 'bpm' WHEN 1 THEN 'ms' WHEN 2 THEN 'celsius' ELSE 'count' END AS unit FROM m WHERE metric_type = 'signup' AND event_id % 97 <> 0")
register("src_4_normalise_legacy", lambda m: S.normalise_legacy(legacy(m)), f"SELECT user_id, {NAMES} AS metric_type, {SEC} AS ts, value, {UNITS} AS unit FROM m WHERE metric_type <> 'signup'")


def shapes(m):
    """The payloads of ``legacy`` in several shapes: some in further lists, some with other things beside them, some cut short."""
    rows = legacy(m.where("event_id % 11 <> 0")).select("user_id", "payload", F.pmod(F.xxhash64("payload"), F.lit(3)).alias("k"))
    nested = F.when(F.col("k") == 0, F.concat(F.lit("[[7, null, "), "payload", F.lit("], \"x\"]"))).when(F.col("k") == 1, F.concat(F.lit("["), "payload", F.lit("]"))).otherwise(F.col("payload"))
    broken = legacy(m.where("event_id % 11 = 0")).select("user_id", F.expr("left(payload, length(payload) - 2)").alias("payload"))
    return rows.select("user_id", nested.alias("payload")).unionByName(broken)


register("src_4_normalise_variant", lambda m: S.normalise_variant(shapes(m)), f"SELECT user_id, {NAMES} AS metric_type, {SEC} AS ts, value, {UNITS} AS unit FROM m WHERE metric_type <> 'signup' AND event_id % 11 <> 0")
WIDE = "w AS (SELECT user_id, date_trunc('day', ts) AS ts, max(value) FILTER (metric_type = 'click') AS hrv, max(value) FILTER (metric_type = 'view') AS steps, max(value) FILTER (metric_type = 'error') AS spo2 FROM m GROUP BY ALL)"


def wide(m):
    pick = lambda t, n: F.max(F.when(F.col("metric_type") == t, F.col("value"))).alias(n)
    return m.groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(pick("click", "hrv"), pick("view", "steps"), pick("error", "spo2"))


register("src_5_to_long", lambda m: S.to_long(wide(m), {"hrv": "ms", "steps": "count", "spo2": "percent"}), "WITH " + WIDE + ", l AS (" + " UNION ALL ".join(
    f"SELECT user_id, ts, '{c}' AS metric_type, {c} AS value, '{u}' AS unit, '{{\"source\":\"wide\",\"field\":\"{c}\"}}' AS meta FROM w WHERE {c} IS NOT NULL" for c, u in (("hrv", "ms"), ("steps", "count"), ("spo2", "percent"))) + ") SELECT * FROM l")
register("src_6_derive_sleep", lambda m: S.derive_sleep(m.select("user_id", F.col("ts").alias("bed_ts"), (F.floor("value") + 1).alias("total"), (F.floor("value") * 0.2).alias("deep"), (F.floor("value") * 0.25).alias("rem"))), """
SELECT user_id, ts AS bed_ts, round(floor(value) * 0.2 / (floor(value) + 1) * 100, 6) AS deep_percent, round(floor(value) * 0.25 / (floor(value) + 1) * 100, 6) AS rem_percent, round(hour(ts) + minute(ts) / 60, 6) AS bed_hour,
round(hour(ts + to_minutes((floor(value) + 1)::INT)) + minute(ts + to_minutes((floor(value) + 1)::INT)) / 60, 6) AS wake_hour FROM m""")
register("src_7_explode_stages", lambda m: S.explode_stages(m.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_list(F.struct(F.col("metric_type").alias("stage"), F.col("value").alias("minutes"), F.col("ts").alias("started"))).alias("stages"))), """
SELECT user_id, ts, metric_type || '_sleep_duration' AS metric_type, value FROM m UNION ALL SELECT user_id, ts, metric_type || '_sleep_start_time', round(hour(ts) + minute(ts) / 60, 6) FROM m""")


def _records(m):
    k = F.col("event_id")
    text = F.when(k % 5 == 0, "05/01/2024").when(k % 5 == 1, F.date_format("ts", "yyyy-MM-dd")).when(k % 5 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return m.select(k.alias("record_id"), F.when(k % 11 != 0, F.col("user_id")).alias("user_id"), F.when(k % 13 != 0, F.col("metric_type")).otherwise(" ").alias("metric_type"), F.when(k % 7 != 0, F.col("value").cast("string")).otherwise("n/a").alias("value"), text.alias("timestamp"))


register("src_8_validate", lambda m: S.validate(_records(m)), """
WITH e AS (SELECT event_id AS record_id, concat_ws('; ', CASE WHEN event_id % 11 = 0 THEN 'missing user_id' END, CASE WHEN event_id % 13 = 0 THEN 'blank metric_type' END, CASE WHEN event_id % 7 = 0 THEN 'value is no finite number' END,
CASE WHEN event_id % 5 = 0 THEN 'timestamp can''t be read' END) AS errors FROM m) SELECT record_id, errors, errors = '' AS valid FROM e""")
register("agg_33_json_fill_rate", lambda m: S.json_fill_rate(m, "meta"), """
WITH t AS (SELECT metric_type, count(*) AS rows FROM m GROUP BY ALL), p AS (SELECT metric_type, unnest(json_keys(meta)) AS key, meta FROM m), g AS (SELECT metric_type, key, count(json_extract_string(meta, key)) AS filled FROM p GROUP BY ALL)
SELECT metric_type, key, filled, rows, round(filled / rows, 6) AS rate FROM g JOIN t USING (metric_type)""")


def _base(m):
    return m.where("event_id % 2 = 0").select("event_id", "user_id", "metric_type", "ts", "value")


def _batch(m):
    b = m.where("event_id % 3 = 0")
    one = b.select("event_id", "user_id", "metric_type", "ts", (F.col("value") + 1).alias("value"), F.lit(1).alias("seq"))
    return one.unionByName(b.select("event_id", "user_id", "metric_type", "ts", (F.col("value") + 2).alias("value"), F.lit(2).alias("seq")))


KEY = ["user_id", "metric_type", "ts", "event_id"]
register("snk_1_upsert_update", lambda m: K.upsert(_base(m), _batch(m), KEY, "seq").withColumn("value", F.round("value", 6)), "SELECT event_id, user_id, metric_type, ts, round(CASE WHEN event_id % 3 = 0 THEN value + 2 ELSE value END, 6) AS value FROM m WHERE event_id % 2 = 0 OR event_id % 3 = 0")
register("snk_1_upsert_ignore", lambda m: K.upsert(_base(m), _batch(m), KEY, "seq", "ignore").withColumn("value", F.round("value", 6)), "SELECT event_id, user_id, metric_type, ts, round(CASE WHEN event_id % 2 <> 0 THEN value + 2 ELSE value END, 6) AS value FROM m WHERE event_id % 2 = 0 OR event_id % 3 = 0")


def _stored_baselines(m):
    old = m.groupBy("user_id", "metric_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))
    new = m.where("ts >= '2024-01-20'").groupBy("user_id", "metric_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))
    return K.upsert(old, new, ["user_id", "metric_type"], "n")


register("snk_2_upsert_baselines", _stored_baselines, """
WITH o AS (SELECT user_id, metric_type, round(avg(value), 6) AS mean, count(*) AS n FROM m GROUP BY ALL), w AS (SELECT user_id, metric_type, round(avg(value), 6) AS mean, count(*) AS n FROM m WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY ALL)
SELECT user_id, metric_type, coalesce(w.mean, o.mean) AS mean, coalesce(w.n, o.n) AS n FROM o LEFT JOIN w USING (user_id, metric_type)""")
register("snk_3_export_users", lambda m: K.export_users(m, Y.alerts(m)), f"""
WITH {ALERTS}, r AS (SELECT user_id, list({{'metric_type': metric_type, 'n': n}} ORDER BY metric_type) AS readings FROM (SELECT user_id, metric_type, count(*) AS n FROM m GROUP BY ALL) GROUP BY user_id),
a AS (SELECT user_id, list({{'created_at': strftime(created_at, '%Y-%m-%dT%H:%M:%S'), 'event_id': event_id, 'severity': severity}} ORDER BY strftime(created_at, '%Y-%m-%dT%H:%M:%S'), event_id) AS alerts FROM al GROUP BY user_id)
SELECT user_id, to_json({{'user_id': user_id, 'readings': readings, 'alerts': coalesce(alerts, [])}})::VARCHAR AS document FROM r LEFT JOIN a USING (user_id)""")
#: What the oracle of the daily reports is made of: its relations, and the rest of its select.
REPORT = registry.ORACLES["rpt_1_daily_reports"].removeprefix(f"WITH RECURSIVE {registry.READINGS}, ").split("\nSELECT user_id, DATE")
ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%S')"
register("snk_3_export_records", lambda m: K.export_records(m, Y.alerts(m), Y.daily_reports(m), interventions(m)), f"""
WITH {ALERTS}, {INTERVENTIONS}, {REPORT[0]}, rp AS (SELECT user_id, DATE{REPORT[1]}),
pr AS (SELECT user_id, min(ts) AS onboarded_at, count(*) AS readings, list_sort(list(DISTINCT metric_type)) AS types FROM m GROUP BY user_id)
SELECT user_id, 'profile' AS section, to_json({{'user_id': user_id, 'onboarded_at': {ISO.format(c="onboarded_at")}, 'readings': readings, 'types': types}})::VARCHAR AS document FROM pr
UNION ALL SELECT user_id, 'metrics', to_json({{'event_id': event_id, 'metric_type': metric_type, 'value': value, 'ts': {ISO.format(c="ts")}}})::VARCHAR FROM m
UNION ALL SELECT user_id, 'alerts', to_json({{'event_id': event_id, 'severity': severity, 'created_at': {ISO.format(c="created_at")}, 'is_resolved': is_resolved}})::VARCHAR FROM al
UNION ALL SELECT user_id, 'reports', to_json({{'report_date': report_date::VARCHAR, 'text': text, 'confidence': confidence}})::VARCHAR FROM rp
UNION ALL SELECT user_id, 'interventions', to_json({{'category': category, 'started_at': {ISO.format(c="started_at")}, 'ended_at': {ISO.format(c="ended_at")}}})::VARCHAR FROM iv""")
register("snk_4_retain", lambda m: K.retain(Y.alerts(m), "2024-01-15 00:00:00"), f"WITH {ALERTS} SELECT * FROM al WHERE NOT (is_resolved AND created_at < TIMESTAMP '2024-01-15')")
register("snk_5_purge_users", lambda m: K.purge_users(m, m.where("user_id % 10 = 3").select("user_id").distinct()).drop("meta"), "SELECT event_id, user_id, metric_type, ts, value FROM m WHERE user_id % 10 <> 3")
register("snk_6_chunk_ranges", lambda m: K.chunk_ranges(m.groupBy("user_id").agg(F.to_date(F.min("ts")).alias("start"), F.date_add(F.to_date(F.max("ts")), 1).alias("end")), 7, 21), """
WITH r AS (SELECT user_id, min(ts)::DATE AS s, max(ts)::DATE + 1 AS e FROM m GROUP BY ALL), c AS (SELECT user_id, e, unnest(generate_series(greatest(s, e - 21)::TIMESTAMP, (e - 1)::TIMESTAMP, INTERVAL 7 DAY))::DATE AS chunk_start FROM r)
SELECT user_id, chunk_start, least(chunk_start + 7, e) AS chunk_end FROM c""")
register("snk_7_json_safe", lambda m: K.json_safe(m.select("event_id", "ts", F.when(F.col("event_id") % 9 == 0, float("nan")).when(F.col("event_id") % 10 == 0, float("inf")).otherwise(F.col("value")).alias("value"))), """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, CASE WHEN event_id % 9 = 0 OR event_id % 10 = 0 THEN NULL ELSE value END AS value FROM m""")
register_tables("snk_8_table_stats", lambda s, d: K.table_stats({t: table(s, d, t) for t in ("events", "documents", "conversations", "embeddings")}), "SELECT name, rows FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in ("events", "documents", "conversations", "embeddings")) + ")")

register("set_1_union_alerts", lambda m: Y.alerts(m).select("user_id", F.lit("alert").alias("kind")).unionByName(m.select("user_id", F.lit("reading").alias("kind"))).distinct(), """
SELECT DISTINCT user_id, 'alert' AS kind FROM m WHERE metric_type = 'error' UNION SELECT DISTINCT user_id, 'reading' FROM m""")
EXPECTED = ["click", "view", "purchase", "error", "signup", "heart_rate", "hrv"]
register("set_2_missing_types", lambda m: m.where("ts >= '2024-01-24'").select("user_id").distinct().withColumn("metric_type", F.explode(F.array(*map(F.lit, EXPECTED)))).exceptAll(m.where("ts >= '2024-01-24'").select("user_id", "metric_type").distinct()), f"""
SELECT user_id, t AS metric_type FROM (SELECT DISTINCT user_id FROM m WHERE ts >= TIMESTAMP '2024-01-24') CROSS JOIN (SELECT unnest({EXPECTED}) AS t) EXCEPT SELECT user_id, metric_type FROM m WHERE ts >= TIMESTAMP '2024-01-24'""")
register("set_3_common_dates", lambda m: m.where("metric_type = 'click'").select("user_id", F.to_date("ts").alias("day")).intersect(m.where("metric_type = 'view'").select("user_id", F.to_date("ts").alias("day"))), """
SELECT user_id, ts::DATE AS day FROM m WHERE metric_type = 'click' INTERSECT SELECT user_id, ts::DATE FROM m WHERE metric_type = 'view'""")



def _stored(m):
    """Readings under the names of stored types, dealt out by their number; a few have a name that no metric knows."""
    types = [*names.TYPES, "unknown"]
    return m.withColumn("metric_type", F.get(F.array(*map(F.lit, types)), F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(len(types))).cast("int")))


STORED = "st AS (SELECT event_id, user_id, ts, value, [" + ", ".join(f"'{t}'" for t in names.TYPES) + f", 'unknown'][(event_id * 7 + user_id) % {len(names.TYPES) + 1} + 1] AS metric_type FROM m)"
register("prj_1_resolve_metric", lambda m: names.resolve(_stored(m)), f"WITH n AS ({names.SQL}), {STORED} SELECT event_id, logical, tier, unit FROM st JOIN n ON n.raw = st.metric_type")
register("prj_2_agg_with_fallback", lambda m: names.with_fallback(_stored(m)), f"""
WITH n AS ({names.SQL}), {STORED}, g AS (SELECT user_id, logical, avg(value) FILTER (tier = 'primary') AS p, avg(value) FILTER (tier = 'fallback') AS q FROM (SELECT * FROM st WHERE ts >= TIMESTAMP '2024-01-26') x JOIN n ON n.raw = x.metric_type GROUP BY ALL)
SELECT user_id, logical, round(coalesce(p, q), 6) AS value, CASE WHEN p IS NULL THEN 'fallback' ELSE 'primary' END AS tier FROM g""")
register("prj_4_lifestyle_rows", lambda m: m.where(F.col("metric_type").like("%up%") | F.col("metric_type").isin("purchase") | F.get_json_object("meta", "$.k").isin("1", "2")).select("event_id", "user_id", "metric_type"), """
SELECT event_id, user_id, metric_type FROM m WHERE metric_type LIKE '%up%' OR metric_type IN ('purchase') OR (meta->>'$.k') IN ('1', '2')""")
register_tables("prj_5_categorise", lambda s, d: names.categorise(X.events_to_metrics(X.extract_events(messages(s, d)))), f"WITH {METRIC_ROWS}, r AS (SELECT id, line_no, metric_type, round(value::DOUBLE, 6) AS value FROM x) SELECT id, line_no, metric_type, {names.CATEGORY_SQL} AS category, {names.INTENSITY_SQL} AS intensity FROM r")
register_tables("prj_9_recent_readings", lambda s, d: readings(s, d).where("ts >= '2024-01-29'").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "ts"), "SELECT event_id, user_id, ts FROM m WHERE ts >= TIMESTAMP '2024-01-29' ORDER BY ts DESC, event_id DESC LIMIT 50")
