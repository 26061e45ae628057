"""Notes and messages: similarity search, full text search, tags, events and threads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseloom.sources.shared import staged

#: The most queries of a text search that are broadcast.
QUERY_ROWS = 1_000
#: Queries and rows of a tile of the vector search.
TILE_QUERIES, TILE_ROWS = 2_048, 16_384


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one has no length."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.when(norm > 0, dot / norm)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def vector_search(queries: DataFrame, corpus: DataFrame, k: int, threshold: float) -> DataFrame:
    """The ``k`` most similar corpus rows of each query, at ``threshold`` or above; ties by distance, then id.

    Every query meets every row, in tiles of some thousand rows each: a tile is a
    matrix product that gives the best of each query only, so no pairs are
    shuffled. The copies that tiles need are a vector per TILE_QUERIES queries.
    """
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    ready = lambda df: df.where(whole).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("dim"))
    q, c = ready(queries.select("vec_id", "embedding")), ready(corpus.select("vec_id", "embedding"))
    many, rows = q.count(), c.count()
    blocks, parts = max(1, -(-many // TILE_QUERIES)), max(1, -(-rows // TILE_ROWS))
    deal = lambda of, n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(of)
    copies = lambda of, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(of)
    q = q.select("id", "v", "dim", deal("block", blocks), copies("part", parts))
    c = c.select("id", "v", "dim", deal("part", parts), copies("block", blocks))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if len(left) and len(right):
            (a, ids_a), (b, ids_b) = (((t.column("v").combine_chunks().flatten().to_numpy()).reshape(len(t), -1), t.column("id").to_numpy()) for t in (left, right))
            na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
            a, ids_a, na, b, ids_b, nb = a[na != 0], ids_a[na != 0], na[na != 0], b[nb != 0], ids_b[nb != 0], nb[nb != 0]
            for at in range(0, len(a), 64):
                some = slice(at, at + 64)
                s = (a[some] @ b.T) / (na[some, None] * nb)
                order = np.where(np.isnan(s), np.inf, s)  # Spark's order: NaN is above all numbers
                least = np.full((len(s), 1), threshold - 1e-6)
                if len(b) > k:  # all that may round to the k-th best stay
                    least = np.maximum(least, np.partition(order, len(b) - k, axis=1)[:, len(b) - k, None] - 2e-6)
                i, j = np.nonzero(order >= least)
                for o, x in zip(out, (ids_a[some][i], ids_b[j], s[i, j], np.sqrt(((a[some][i] - b[j]) ** 2).sum(1))), strict=True):
                    o.append(x)
        ids, values = (lambda o: pa.array(np.concatenate(o or [[]]), pa.int64())), (lambda o: pa.array(np.concatenate(o or [[]]), pa.float64(), from_pandas=False))
        return pa.table({"query_id": ids(out[0]), "vec_id": ids(out[1]), "similarity": values(out[2]), "distance": values(out[3])})

    keys = ["block", "part", "dim"]
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, similarity double, distance double")
    scored = found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.round("distance", 6).alias("distance"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "distance", "vec_id")
    return scored.where(F.col("similarity") >= threshold).withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)


def text_search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Documents that hold all words of a query, ranked by how often they hold them for their length; (query_id, query) and (doc_id, text).

    A stated set of queries (QUERY_ROWS at the most) is broadcast, and each
    document meets the queries whose rarest word it holds, where it lies: only
    what is found is shuffled. Larger sets meet in an equi-join of the words.
    """
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    q = queries.select("query_id", F.array_distinct(words(F.col("query"))).alias("asked")).where(F.size("asked") > 0)
    d = docs.select("doc_id", words(F.col("text")).alias("w"))
    if q.limit(QUERY_ROWS + 1).count() <= QUERY_ROWS:
        one = lambda rows: F.broadcast(rows.agg(F.collect_set("word").alias("all")))
        of_query = q.select("query_id", F.explode("asked").alias("word"))
        df = d.crossJoin(one(of_query)).select(F.explode(F.array_intersect("w", "all")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        # a query with a word that no document holds finds nothing, by any word
        rare = of_query.join(df, "word", "left").groupBy("query_id").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
        rare = staged(rare.join(q, "query_id"), "rare")
        seeds = d.crossJoin(one(rare)).select("doc_id", "w", F.explode(F.array_intersect("w", "all")).alias("word"))
        hits = seeds.join(F.broadcast(rare), "word").where(F.size(F.array_except("asked", "w")) == 0)
        g = hits.select("query_id", "doc_id", F.size("w").alias("length"), F.size(F.filter("w", lambda x: F.array_contains("asked", x))).cast("long").alias("tf"))
    else:
        q = q.select("query_id", F.size("asked").alias("n_words"), F.explode("asked").alias("word"))
        d = d.withColumn("length", F.size("w")).select("doc_id", "length", F.explode("w").alias("word"))
        hits = d.groupBy("doc_id", "length", "word").agg(F.count(F.lit(1)).alias("tf")).join(q, "word")
        g = hits.groupBy("query_id", "doc_id", "length", "n_words").agg(F.count(F.lit(1)).alias("found"), F.sum("tf").alias("tf")).where("found = n_words")
    g = g.withColumn("rank", F.round(F.col("tf") / F.sqrt("length"), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("rank"), "doc_id")
    return g.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select("query_id", "doc_id", "tf", "rank", "k")


def prepare(text: Column, most: int = 8000) -> Column:
    """Trimmed text with single spaces, cut to ``most`` characters (the limit of the embedding service)."""
    return F.left(F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " ")), F.lit(most))


#: Tag and the words that give it.
TAGS = (
    ("sleep", r"\b(sleep|slept|bedtime|nap|tired)\b"), ("exercise", r"\b(run|running|walk|gym|exercise|workout)\b"), ("nutrition", r"\b(meal|ate|food|dinner|lunch|breakfast)\b"), ("stress", r"\b(stress|stressed|anxious)\b"),
    ("supplement", r"\b(magnesium|vitamin|supplement)\b"), ("heart", r"\b(heart|pulse|hrv)\b"), ("mood", r"\b(mood|happy|sad)\b"), ("caffeine", r"\b(coffee|caffeine|tea|espresso)\b"),
)


def rule_tags(text: Column, most: int = 7) -> Column:
    """Tags whose pattern the text has, in the order of TAGS, ``most`` at the most."""
    return F.slice(F.array_compact(F.array(*[F.when(F.lower(text).rlike(p), t) for t, p in TAGS])), 1, most)


#: Fixed values of the message tags: aliases of metrics (the longest that occurs counts), aggregations and question words.
ALIASES = (("heart rate", "heart_rate"), ("pulse", "heart_rate"), ("hrv", "hrv"), ("recovery score", "recovery"), ("recovery", "recovery"), ("sleep", "sleep"), ("steps", "steps"), ("temperature", "temperature"), ("glucose", "glucose"))
AGGREGATIONS = (("average|mean|avg", "avg"), ("highest|max|peak", "max"), ("lowest|min", "min"), ("total|sum", "sum"), ("trend", "trend"), ("latest|last|current", "latest"))


def _first(text: Column, ladder, otherwise: str) -> Column:
    out = None
    for pattern, name in ladder:
        out = F.when(text.rlike(rf"\b({pattern})\b"), name) if out is None else out.when(text.rlike(rf"\b({pattern})\b"), name)
    return out.otherwise(otherwise)


def metric_of(text: Column) -> Column:
    """The metric of the longest alias in the text; null without one."""
    found = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(a)), F.struct(F.lit(-len(a)).alias("n"), F.lit(a).alias("a"), F.lit(m).alias("m"))) for a, m in ALIASES]))
    return F.when(F.size(found) > 0, F.get(F.array_sort(found), F.lit(0)).m)


def tag_messages(df: DataFrame) -> DataFrame:
    """(id, text) to metric, aggregation, days, query type, intent and confidence."""
    t = F.lower(F.coalesce("text", F.lit("")))
    number = F.regexp_extract(t, r"(?:last|past) (\d+) (day|week|month)", 1).try_cast("int")
    unit = F.regexp_extract(t, r"(?:last|past) (\d+) (day|week|month)", 2)
    days = F.when(number.isNotNull(), number * F.when(unit == "week", 7).when(unit == "month", 30).otherwise(1)).when(t.rlike(r"\byesterday\b"), 1).when(t.rlike(r"\bthis week\b"), 7).when(t.rlike(r"\bthis month\b"), 30).otherwise(7)
    metric, agg = metric_of(t), _first(t, AGGREGATIONS, "avg")
    kind = F.when(t.rlike(r"\b(correlation|relationship|versus|vs)\b"), "correlation").when(agg == "trend", "trend").when(t.rlike(r"\b(compare|compared)\b"), "comparison").otherwise("single")
    intent = F.when(t.rlike(r"\?|^(what|how|why|when|show|tell)\b"), "question").when(t.rlike(r"^(supplement|meal|drink|exercise)\b"), "event").otherwise("chat")
    confidence = F.round(F.lit(0.2) + F.when(metric.isNotNull(), 0.4).otherwise(0.0) + F.when(number.isNotNull(), 0.2).otherwise(0.0) + F.when(intent == "question", 0.2).otherwise(0.0), 6)
    return df.select("id", metric.alias("metric"), agg.alias("aggregation"), days.alias("days"), kind.alias("query_type"), intent.alias("intent"), confidence.alias("confidence"))


def extract_events(df: DataFrame) -> DataFrame:
    """(id, text) to event rows: each line that opens with a kind gives item, dose, unit and decimal hour."""
    lines = df.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line")).withColumn("line", F.trim(F.lower("line")))
    kind = F.regexp_extract("line", r"^(supplement|meal|exercise|drink)\s+(\S+)", 1)
    dose = F.regexp_extract("line", r"(\d+(?:\.\d+)?)\s*(mg|mcg|g|oz|ml|min|h)\b", 1).try_cast("double")
    unit = F.regexp_extract("line", r"(\d+(?:\.\d+)?)\s*(mg|mcg|g|oz|ml|min|h)\b", 2)
    h = F.regexp_extract("line", r"\b(\d{1,2})(?::(\d{2}))?\s*(am|pm)\b", 1).try_cast("double")
    minute = F.coalesce(F.regexp_extract("line", r"\b(\d{1,2})(?::(\d{2}))?\s*(am|pm)\b", 2).try_cast("double"), F.lit(0.0))
    half = F.regexp_extract("line", r"\b(\d{1,2})(?::(\d{2}))?\s*(am|pm)\b", 3)
    hour = h % 12 + F.when(half == "pm", 12).otherwise(0) + minute / 60
    return lines.where(~F.contains("line", F.lit("?")) & (kind != "")).select("id", "line_no", kind.alias("kind"), F.regexp_extract("line", r"^(supplement|meal|exercise|drink)\s+(\S+)", 2).alias("item"), dose.alias("dose"), F.nullif(unit, F.lit("")).alias("unit"), F.round(hour, 6).alias("hour"))


#: Fixed value: milligrams of caffeine in a serving of eight ounces.
CAFFEINE = {"coffee": 95.0, "tea": 47.0, "espresso": 500.0, "cola": 24.0}


def events_to_metrics(events: DataFrame) -> DataFrame:
    """Event rows to metric rows: intake, consumption, timing, duration, intensity and caffeine."""
    row = lambda test, name, value: F.when(test, F.struct(name.alias("metric_type"), value.cast("double").alias("value")))
    k, item = F.col("kind"), F.col("item")
    caffeine = F.create_map(*[F.lit(x) for kv in CAFFEINE.items() for x in kv])
    servings = F.when(F.col("unit") == "oz", F.col("dose") / 8).otherwise(F.lit(1.0))
    out = F.array_compact(F.array(
        row(k == "supplement", F.concat(item, F.lit("_intake")), F.coalesce("dose", F.lit(1.0))), row(k == "supplement", F.lit("supplement_intake"), F.lit(1)),
        row((k == "meal") & F.col("hour").isNotNull(), F.lit("meal_timing"), F.col("hour")), row(k == "meal", F.concat(item, F.lit("_consumption")), F.lit(1)),
        row((k == "exercise") & F.col("dose").isNotNull(), F.concat(item, F.lit("_duration")), F.col("dose")), row((k == "exercise") & F.col("dose").isNotNull(), F.lit("exercise_duration"), F.col("dose")),
        row(k == "exercise", F.lit("exercise_intensity"), F.lit(3)), row(k == "drink", F.concat(item, F.lit("_consumption")), F.coalesce("dose", F.lit(1.0))),
        row((k == "drink") & caffeine[item].isNotNull(), F.lit("caffeine_intake"), caffeine[item] * servings),
    ))
    return events.select("id", "line_no", F.explode(out).alias("x")).select("id", "line_no", "x.metric_type", F.round("x.value", 6).alias("value"))


FOLLOW_UP = r"^(what about|how about|and |show me more|same for|compared to|why)|\b(that|those|more details)\b"


def flag_follow_ups(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): whether a turn takes up the one before it; and the turn it answers."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    previous = F.lag("turn").over(w)
    return df.select("conv_id", "turn", (previous.isNotNull() & F.lower(F.coalesce("text", F.lit(""))).rlike(FOLLOW_UP)).alias("is_follow_up"), previous.alias("parent_turn"), F.lag("role").over(w).alias("parent_role"))


def metric_pair(text: Column) -> Column:
    """The first two different metrics of the parts of a text around its connectors, comma-joined."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\b(?:and|with|versus|vs|to)\b")
    found = F.array_distinct(F.array_compact(F.transform(parts, metric_of)))
    return F.when(F.size(found) >= 2, F.array_join(F.slice(found, 1, 2), ","))


def extract_nutrition(df: DataFrame) -> DataFrame:
    """(id, text): the numbers before "calories", "g protein", "g carbs", "g fat" and of "score"."""
    number = lambda p: F.regexp_extract(F.lower("text"), p, 1).try_cast("double")
    return df.select("id", number(r"(\d+(?:\.\d+)?) calories").alias("calories"), number(r"(\d+(?:\.\d+)?) ?g protein").alias("protein"), number(r"(\d+(?:\.\d+)?) ?g carbs").alias("carbs"), number(r"(\d+(?:\.\d+)?) ?g fat").alias("fat"), number(r"score:? (\d+(?:\.\d+)?)").alias("score"))


def message_insights(df: DataFrame) -> DataFrame:
    """(id, ts, text): message class, and an insight for late meals, caffeine and exercise."""
    t, h = F.lower("text"), F.hour("ts")
    kind = F.when(t.rlike(r"\bmeal\b"), "meal").when(t.rlike(r"\b(coffee|caffeine)\b"), "caffeine").when(t.rlike(r"\bexercise\b"), "exercise").otherwise("other")
    insight = F.when((kind == "meal") & (h >= 20), "late meal").when((kind == "caffeine") & (h >= 14), "late caffeine").when((kind == "exercise") & (h >= 19), "late exercise")
    return df.select("id", kind.alias("kind"), insight.alias("insight"))
