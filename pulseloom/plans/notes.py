"""Queries of notes, messages and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom.operators import text as X
from pulseloom.operators.outcomes import intervention_scores
from pulseloom.operators.relations import interventions
from pulseloom.operators.text_index import TextIndex
from pulseloom.operators.vector_index import HyperplaneIndex
from pulseloom.plans.outcomes import SCORES
from pulseloom.plans.registry import register, register_tables
from pulseloom.sources.readings import as_of, readings
from pulseloom.sources.shared import shared_path
from pulseloom.sources.tables import table

VQ = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0)"
VS = VQ + """, s AS (SELECT query_id, vec_id, round(list_dot_product(q, embedding::DOUBLE[]) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS similarity, round(list_distance(q, embedding::DOUBLE[]), 6) AS distance FROM embeddings CROSS JOIN q)"""
register_tables("txt_1_vector_search", lambda s, d: X.vector_search(table(s, d, "embeddings").where("vec_id % 50 = 0"), table(s, d, "embeddings"), 10, 0.2), f"""
WITH {VS} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, distance, vec_id) AS k FROM s WHERE similarity >= 0.2 QUALIFY k <= 10""")


def _approximate(s, d):
    vectors = table(s, d, "embeddings")
    return HyperplaneIndex.build(vectors, shared_path(s, "hyperplanes")).search(vectors.where("vec_id % 50 = 0"), 10, 0.2)


register_tables("txt_1_vector_search_approximate", _approximate)


def _context(s, d):
    """The three best notes of each query, with their tags."""
    hits = X.vector_search(table(s, d, "embeddings").where("vec_id % 50 = 0"), table(s, d, "embeddings"), 3, 0.1)
    notes = table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return hits.join(notes, "vec_id").select("query_id", "vec_id", "similarity", F.array_join(X.rule_tags(F.coalesce("text", F.lit(""))), ",").alias("tags"))


TAGS_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(text, '')), '{p}') THEN '{t}' END" for t, p in X.TAGS) + "], lambda x: x IS NOT NULL)[1:7]"
register_tables("txt_2_historical_context", _context, f"""
WITH {VS}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, distance, vec_id) AS k FROM s WHERE similarity >= 0.1 QUALIFY k <= 3), t AS (SELECT doc_id AS vec_id, {TAGS_SQL} AS tags FROM documents)
SELECT query_id, vec_id, similarity, array_to_string(tags, ',') AS tags FROM h JOIN t USING (vec_id)""")
register_tables("txt_3_text_search", lambda s, d: X.text_search(table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), table(s, d, "documents"), 5), """
WITH q AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM benchmark),
qw AS (SELECT query_id, len(w) AS n, unnest(w) AS word FROM q), d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, len(w) AS length, unnest(w) AS word FROM d), c AS (SELECT doc_id, length, word, count(*) AS tf FROM t GROUP BY ALL),
g AS (SELECT query_id, doc_id, length, n, count(*) AS f, sum(tf)::BIGINT AS tf FROM c JOIN qw USING (word) GROUP BY ALL HAVING count(*) = n)
SELECT query_id, doc_id, tf, round(tf / sqrt(length), 6) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY round(tf / sqrt(length), 6) DESC, doc_id) AS k FROM g QUALIFY k <= 5""")


def _indexed(s, d):
    """Documents with their language and source as tags, in two batches; the items are the queries."""
    docs = table(s, d, "documents").select("doc_id", "text", F.array("lang", "source").alias("tags"))
    index = TextIndex(s, shared_path(s, "text_index"))
    index.add(docs.where("doc_id % 2 = 0"))
    index.add(docs.where("doc_id % 2 = 1"))
    return index.search(table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 5)


TERMS = "list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
register_tables("txt_3_text_index", _indexed, f"""
WITH q AS (SELECT item_id AS query_id, list_distinct({TERMS.format(c="coalesce(text, '')")}) AS w FROM benchmark), qw AS (SELECT query_id, len(w) AS n, unnest(w) AS word FROM q),
d AS (SELECT doc_id, {TERMS.format(c="concat_ws(' ', coalesce(text, ''), concat_ws(' ', lang, source))")} AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
h AS (SELECT query_id, doc_id, n, word, p FROM t JOIN qw USING (word)), a AS (SELECT query_id, doc_id FROM h GROUP BY query_id, doc_id HAVING count(DISTINCT word) = max(n)), x AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY p) AS i FROM h JOIN a USING (query_id, doc_id)),
l AS (SELECT e.query_id, e.doc_id, e.n, e.p, e.i, b.word, max(b.p) AS last, max(b.i) AS last_i FROM x e JOIN x b ON e.query_id = b.query_id AND e.doc_id = b.doc_id AND b.p <= e.p GROUP BY ALL),
c AS (SELECT query_id, doc_id, p, i, min(last) AS s, min(last_i) AS s_i FROM l GROUP BY query_id, doc_id, n, p, i HAVING count(*) = n), f AS (SELECT query_id, doc_id, s, min(p) AS e, min(i) AS e_i, min(s_i) AS s_i FROM c GROUP BY query_id, doc_id, s),
g AS (SELECT query_id, doc_id, count(*) AS covers, round(sum(0.1::DOUBLE / (1 + (e - s) - (e_i - s_i))), 6) AS rank FROM f GROUP BY query_id, doc_id) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, doc_id) AS k FROM g QUALIFY k <= 5""")
register_tables("txt_4_prepare_and_tag", lambda s, d: table(s, d, "documents").select("doc_id", F.md5(X.prepare(F.coalesce("text", F.lit("")))).alias("prepared"), F.array_join(X.rule_tags(F.coalesce("text", F.lit(""))), ",").alias("tags")), f"""
SELECT doc_id, md5(left(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g')), 8000)) AS prepared, array_to_string({TAGS_SQL}, ',') AS tags FROM documents""")
register("txt_5_recent_events", lambda m: m.where("ts >= '2024-01-28'").select("user_id", "event_id", "ts"), "SELECT user_id, event_id, ts FROM m WHERE ts >= TIMESTAMP '2024-01-28'")

#: How a reading is written down as a line of a note: what stands before and behind its whole value, by type and by the number of its event.
LINES = {
    "click": (("exercise running ", "min "), ("tired after a walk of ", "min, happy mood at "), ("what was my highest pulse past ", " day at ")),
    "view": (("drink coffee ", "oz "), ("drink tea ", "oz at "), ("show me the lowest hrv last ", " week at ")),
    "purchase": (("meal chicken ", " calories 20g protein 35g carbs "), ("ate dinner of ", " calories 12g fat score 7 at "), ("meal salad ", " calories 31g protein 48g carbs 9g fat score: 8 ")),
    "signup": (("supplement magnesium ", "mg "), ("stressed, trend of steps this month ", " at "), ("supplement vitamin ", "mcg ")),
    "error": (("average heart rate vs sleep last ", " days at "), ("total steps compared to recovery score ", " yesterday at "), ("heart rate correlation with temperature past ", " month at ")),
}


def messages(s, d):
    """(id, text, ts): the turns of conversations, whole, and the notes of each person and day, a line per reading."""
    turns = table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    number = F.pmod("event_id", F.lit(3)).cast("int")
    part = lambda k: F.create_map(*[x for t, v in LINES.items() for x in (F.lit(t), F.array(*[F.lit(line[k]) for line in v]))])[F.col("metric_type")][number]
    line = F.concat(part(0), F.floor("value").cast("string"), part(1), F.lower(F.date_format("ts", "h:mma")))
    days = readings(s, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("line")))).alias("x"), F.max("ts").alias("ts"))
    notes = days.select(F.concat(F.lit("u"), F.concat_ws("-", F.col("user_id").cast("string"), F.col("day").cast("string"))).alias("id"), F.array_join(F.transform("x", lambda i: i.line), "\n").alias("text"), "ts")
    return turns.unionByName(notes)


LINE = "CASE " + " ".join(f"WHEN metric_type = '{t}' AND event_id % 3 = {k} THEN '{a}' || floor(value)::BIGINT || '{b}'" for t, v in LINES.items() for k, (a, b) in enumerate(v)) + " END || lower(strftime(ts, '%-I:%M%p'))"
MSG = f"""msg AS (SELECT conv_id || '-' || turn AS id, coalesce(text, '') AS text, NULL::TIMESTAMP AS ts FROM conversations
UNION ALL SELECT 'u' || user_id || '-' || ts::DATE, string_agg({LINE}, chr(10) ORDER BY ts, event_id), max(ts) FROM m GROUP BY user_id, ts::DATE)"""


def _note_context(s, d):
    """The three best notes of each query among the notes of persons and days, with tags, and whether a successful intervention was under way.

    The vector of a note is that of the number of its person and day.
    """
    number = F.col("user_id") * 30 + F.datediff("day", F.lit("2024-01-01").cast("date"))
    notes = messages(s, d).where("ts IS NOT NULL").withColumn("user_id", F.regexp_extract("id", "^u(\\d+)-", 1).cast("long")).withColumn("day", F.to_date("ts"))
    notes = notes.select(number.alias("vec_id"), "user_id", "day", F.array_join(X.rule_tags(F.col("text")), ",").alias("tags"))
    m = readings(s, d)
    worked = intervention_scores(m).groupBy("user_id").agg(F.max("effectiveness").alias("effectiveness")).where("effectiveness >= 60")
    during = interventions(m).join(worked, "user_id").select("user_id", F.to_date("started_at").alias("a"), F.to_date(F.coalesce("ended_at", as_of())).alias("b"))
    vectors = table(s, d, "embeddings")
    hits = X.vector_search(vectors.where("vec_id % 50 = 0"), vectors.join(notes.select("vec_id"), "vec_id"), 3, 0.1)
    out = hits.join(notes, "vec_id").join(during, "user_id", "left")
    return out.select("query_id", "vec_id", "similarity", "tags", F.coalesce(F.col("day").between(F.col("a"), F.col("b")), F.lit(False)).alias("successful"))


register_tables("txt_2_note_context", _note_context, f"""
WITH {SCORES}, {MSG}, {VS}, nt AS (SELECT regexp_extract(id, '^u(\\d+)-', 1)::BIGINT AS user_id, ts::DATE AS day, text FROM msg WHERE ts IS NOT NULL), nv AS (SELECT user_id * 30 + (day - DATE '2024-01-01') AS vec_id, user_id, day, array_to_string({TAGS_SQL}, ',') AS tags FROM nt),
h AS (SELECT s.*, nv.user_id, day, tags, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, distance, s.vec_id) AS k FROM s JOIN nv USING (vec_id) WHERE similarity >= 0.1 QUALIFY k <= 3),
wk AS (SELECT user_id FROM es GROUP BY user_id HAVING max(effectiveness) >= 60), du AS (SELECT iv.user_id, started_at::DATE AS a, coalesce(ended_at, TIMESTAMP '2024-01-31')::DATE AS b FROM iv JOIN wk USING (user_id))
SELECT query_id, vec_id, similarity, tags, coalesce(day BETWEEN a AND b, false) AS successful FROM h LEFT JOIN du USING (user_id)""")
register_tables("txt_4_tag_notes", lambda s, d: messages(s, d).where("ts IS NOT NULL").select("id", F.md5(X.prepare(F.col("text"))).alias("prepared"), F.array_join(X.rule_tags(F.col("text")), ",").alias("tags")), f"""
WITH {MSG} SELECT id, md5(left(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), 8000)) AS prepared, array_to_string({TAGS_SQL}, ',') AS tags FROM msg WHERE ts IS NOT NULL""")
METRIC = "CASE " + " ".join(f"WHEN contains({{t}}, '{a}') THEN '{m}'" for a, m in sorted(X.ALIASES, key=lambda x: (-len(x[0]), x[0]))) + " END"
AGG = "CASE " + " ".join(f"WHEN regexp_matches(t, '\\b({p})\\b') THEN '{n}'" for p, n in X.AGGREGATIONS) + " ELSE 'avg' END"
register_tables("msg_1_tag_messages", lambda s, d: X.tag_messages(messages(s, d)), f"""
WITH {MSG}, l AS (SELECT id, lower(text) AS t FROM msg), n AS (SELECT *, try_cast(regexp_extract(t, '(?:last|past) (\\d+) (day|week|month)', 1) AS INT) AS k, regexp_extract(t, '(?:last|past) (\\d+) (day|week|month)', 2) AS u,
{METRIC.format(t='t')} AS metric, {AGG} AS aggregation, CASE WHEN regexp_matches(t, '\\?|^(what|how|why|when|show|tell)\\b') THEN 'question' WHEN regexp_matches(t, '^(supplement|meal|drink|exercise)\\b') THEN 'event' ELSE 'chat' END AS intent FROM l)
SELECT id, metric, aggregation, CASE WHEN k IS NOT NULL THEN k * CASE u WHEN 'week' THEN 7 WHEN 'month' THEN 30 ELSE 1 END WHEN regexp_matches(t, '\\byesterday\\b') THEN 1 WHEN regexp_matches(t, '\\bthis week\\b') THEN 7 WHEN regexp_matches(t, '\\bthis month\\b') THEN 30 ELSE 7 END AS days,
CASE WHEN regexp_matches(t, '\\b(correlation|relationship|versus|vs)\\b') THEN 'correlation' WHEN aggregation = 'trend' THEN 'trend' WHEN regexp_matches(t, '\\b(compare|compared)\\b') THEN 'comparison' ELSE 'single' END AS query_type, intent,
round(0.2 + CASE WHEN metric IS NOT NULL THEN 0.4 ELSE 0 END + CASE WHEN k IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN intent = 'question' THEN 0.2 ELSE 0 END, 6)::DOUBLE AS confidence FROM n""")
KIND = "^(supplement|meal|exercise|drink)\\s+(\\S+)"
DOSE = "(\\d+(?:\\.\\d+)?)\\s*(mg|mcg|g|oz|ml|min|h)\\b"
CLOCK = "\\b(\\d{1,2})(?::(\\d{2}))?\\s*(am|pm)\\b"
EVENTS = MSG + f""", li AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM msg), lo AS (SELECT id, line_no::INT AS line_no, trim(lower(line)) AS line FROM li),
ev AS (SELECT id, line_no, regexp_extract(line, '{KIND}', 1) AS kind, regexp_extract(line, '{KIND}', 2) AS item, try_cast(regexp_extract(line, '{DOSE}', 1) AS DOUBLE) AS dose, nullif(regexp_extract(line, '{DOSE}', 2), '') AS unit,
round(try_cast(regexp_extract(line, '{CLOCK}', 1) AS DOUBLE) % 12 + CASE WHEN regexp_extract(line, '{CLOCK}', 3) = 'pm' THEN 12 ELSE 0 END + coalesce(try_cast(regexp_extract(line, '{CLOCK}', 2) AS DOUBLE), 0) / 60, 6) AS hour FROM lo WHERE NOT contains(line, '?') AND regexp_matches(line, '{KIND}'))"""
register_tables("msg_2_extract_events", lambda s, d: X.extract_events(messages(s, d)), f"WITH {EVENTS} SELECT * FROM ev")
METRIC_ROWS = EVENTS + """, x AS (SELECT id, line_no, item || '_intake' AS metric_type, coalesce(dose, 1) AS value FROM ev WHERE kind = 'supplement' UNION ALL SELECT id, line_no, 'supplement_intake', 1 FROM ev WHERE kind = 'supplement'
UNION ALL SELECT id, line_no, 'meal_timing', hour FROM ev WHERE kind = 'meal' AND hour IS NOT NULL UNION ALL SELECT id, line_no, item || '_consumption', 1 FROM ev WHERE kind = 'meal'
UNION ALL SELECT id, line_no, item || '_duration', dose FROM ev WHERE kind = 'exercise' AND dose IS NOT NULL UNION ALL SELECT id, line_no, 'exercise_duration', dose FROM ev WHERE kind = 'exercise' AND dose IS NOT NULL
UNION ALL SELECT id, line_no, 'exercise_intensity', 3 FROM ev WHERE kind = 'exercise' UNION ALL SELECT id, line_no, item || '_consumption', coalesce(dose, 1) FROM ev WHERE kind = 'drink'
UNION ALL SELECT id, line_no, 'caffeine_intake', CASE item WHEN 'coffee' THEN 95.0 WHEN 'tea' THEN 47.0 WHEN 'espresso' THEN 500.0 ELSE 24.0 END * CASE WHEN unit = 'oz' THEN dose / 8 ELSE 1 END FROM ev WHERE kind = 'drink' AND item IN ('coffee', 'tea', 'espresso', 'cola'))"""
register_tables("msg_3_events_to_metrics", lambda s, d: X.events_to_metrics(X.extract_events(messages(s, d))), f"WITH {METRIC_ROWS} SELECT id, line_no, metric_type, round(value::DOUBLE, 6) AS value FROM x")
FOLLOWS = f"""SELECT conv_id, turn, lag(turn) OVER w IS NOT NULL AND regexp_matches(lower(coalesce(text, '')), '{X.FOLLOW_UP}') AS is_follow_up, lag(turn) OVER w AS parent_turn, lag(role) OVER w AS parent_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
register_tables("msg_4_flag_follow_ups", lambda s, d: X.flag_follow_ups(table(s, d, "conversations")), FOLLOWS)
register_tables("jon_15_thread", lambda s, d: X.flag_follow_ups(table(s, d, "conversations")).where("parent_turn IS NOT NULL").groupBy("conv_id").agg(F.count(F.lit(1)).alias("links"), F.count_if("is_follow_up").alias("follow_ups"), F.max("turn").alias("last_turn")),
                f"WITH t AS ({FOLLOWS}) SELECT conv_id, count(*) AS links, count(*) FILTER (is_follow_up) AS follow_ups, max(turn) AS last_turn FROM t WHERE parent_turn IS NOT NULL GROUP BY conv_id")
register_tables("msg_5_metric_pair", lambda s, d: messages(s, d).select("id", X.metric_pair(F.col("text")).alias("pair")), f"""
WITH {MSG}, p AS (SELECT id, unnest(string_split_regex(lower(text), '\\b(?:and|with|versus|vs|to)\\b')) AS part, generate_subscripts(string_split_regex(lower(text), '\\b(?:and|with|versus|vs|to)\\b'), 1) AS i FROM msg),
e AS (SELECT id, {METRIC.format(t='part')} AS metric, i FROM p), f AS (SELECT id, metric, min(i) AS i FROM e WHERE metric IS NOT NULL GROUP BY id, metric), g AS (SELECT id, list(metric ORDER BY i) AS l FROM f GROUP BY id)
SELECT msg.id, CASE WHEN len(l) >= 2 THEN array_to_string(l[1:2], ',') END AS pair FROM msg LEFT JOIN g USING (id)""")
NUM = "try_cast(regexp_extract(lower(text), '{p}', 1) AS DOUBLE) AS {n}"
register_tables("msg_6_extract_nutrition", lambda s, d: X.extract_nutrition(messages(s, d)), f"WITH {MSG} SELECT id, " + ", ".join(NUM.format(p=p, n=n) for p, n in (
    ("(\\d+(?:\\.\\d+)?) calories", "calories"), ("(\\d+(?:\\.\\d+)?) ?g protein", "protein"), ("(\\d+(?:\\.\\d+)?) ?g carbs", "carbs"), ("(\\d+(?:\\.\\d+)?) ?g fat", "fat"), ("score:? (\\d+(?:\\.\\d+)?)", "score"))) + " FROM msg")


register_tables("msg_7_message_insights", lambda s, d: X.message_insights(messages(s, d)), f"""
WITH {MSG}, k AS (SELECT id, CASE WHEN regexp_matches(lower(text), '\\bmeal\\b') THEN 'meal' WHEN regexp_matches(lower(text), '\\b(coffee|caffeine)\\b') THEN 'caffeine' WHEN regexp_matches(lower(text), '\\bexercise\\b') THEN 'exercise' ELSE 'other' END AS kind, hour(ts) AS h FROM msg)
SELECT id, kind, CASE WHEN kind = 'meal' AND h >= 20 THEN 'late meal' WHEN kind = 'caffeine' AND h >= 14 THEN 'late caffeine' WHEN kind = 'exercise' AND h >= 19 THEN 'late exercise' END AS insight FROM k""")
