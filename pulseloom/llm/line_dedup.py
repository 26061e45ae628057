"""Removal of repeated passages by overlapping three-line windows.

Lines are trimmed of spaces and blank lines don't count. Each three consecutive
lines are a window, known by a 128-bit hash. A window that occurs more than once
stays where it occurs first (smallest doc_id, then position); every later
occurrence covers its three lines, and covered lines are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulseloom.llm.work import staged

WINDOW = 3
#: A window with this share of all windows or more is hot: at most 1 / HOT_SHARE are.
HOT_SHARE = 0.001
#: What is trimmed off both ends of a line before it is compared.
BLANKS = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, version, first, mid, last, h1, h2): each three consecutive non-blank lines, by their line numbers; version tells texts of one doc_id apart."""
    numbered = F.filter(
        F.transform(_lines(F.coalesce("text", F.lit(""))), lambda line, i: F.struct(i.alias("i"), F.xxhash64(F.btrim(line, F.lit(BLANKS))).alias("a"), F.xxhash64(F.lit("other"), F.btrim(line, F.lit(BLANKS))).alias("b"), (F.length(F.btrim(line, F.lit(BLANKS))) > 0).alias("some"))),
        lambda s: s.some,
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), numbered.alias("lines"))
    rows = rows.where(F.size("lines") >= WINDOW)
    part = lambda w, k: F.element_at("lines", (w + k).cast("int"))
    made = F.transform(
        F.sequence(F.lit(1), F.size("lines") - WINDOW + 1),
        lambda w: F.struct(
            part(w, 0).i.alias("first"), part(w, 1).i.alias("mid"), part(w, 2).i.alias("last"),
            F.xxhash64(*[part(w, k).a for k in range(WINDOW)]).alias("h1"),
            F.xxhash64(*[part(w, k).b for k in range(WINDOW)]).alias("h2"),
        ),
    )
    return rows.select("doc_id", "version", F.explode(made).alias("w")).select("doc_id", "version", "w.first", "w.mid", "w.last", "w.h1", "w.h2")


def covered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, version, covered) of the documents that hold later occurrences: the line numbers that these cover."""
    found = staged(windows(docs), "windows")
    where = F.struct("doc_id", "first", "version")
    kept = found.groupBy("h1", "h2").agg(F.min(where).alias("kept"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    kept = staged(kept, "repeated")
    least = max(2, int(found.count() * HOT_SHARE))
    # each hot window has a thousandth of all rows, so there are a thousand at most
    hot = F.broadcast(kept.where(F.col("n") >= least).drop("n"))
    is_later = where > F.col("kept")
    marked = found.join(hot, ["h1", "h2"], "left")
    place = ["doc_id", "version", F.array("first", "mid", "last").alias("lines")]
    later_hot = marked.where(F.col("kept").isNotNull() & is_later).select(*place)
    cold = marked.where(F.col("kept").isNull()).drop("kept").join(kept.where(F.col("n") < least).drop("n").hint("merge"), ["h1", "h2"])
    later = later_hot.unionByName(cold.where(is_later).select(*place))
    return later.groupBy("doc_id", "version").agg(F.collect_set("lines").alias("covered")).withColumn("covered", F.flatten("covered"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of each row of ``docs`` (doc_id, text, any others).

    Null stays null with no lines; texts of fewer than three non-blank lines stay
    as they are. Repeated rows keep the same lines; rows of one doc_id with
    different texts are different documents, in order of a hash of the text. Rows
    without a doc_id come before all others and stay whole. An empty table gives
    an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("version", F.xxhash64("text")).join(covered_lines(docs), ["doc_id", "version"], "left")
    rows = rows.withColumn("lines", _lines(F.col("text")))
    rows = rows.withColumn("left", F.when(F.col("covered").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "covered")))
    text = F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n")
    return rows.select(
        "doc_id",
        F.when(F.col("left").isNotNull(), text).otherwise(F.col("text")).alias("text"),
        F.when(F.col("lines").isNotNull(), F.size("lines")).otherwise(0).cast("long").alias("n_lines"),
        F.when(F.col("left").isNotNull(), F.size("lines") - F.size("left")).otherwise(0).cast("long").alias("n_removed"),
    )


ORACLE = """
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l
), f AS (
  SELECT doc_id, i, line, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c, lead(i, 2) OVER w AS last
  FROM s WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, i, last, row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, i) AS k FROM f WHERE last IS NOT NULL
), gone AS (
  SELECT DISTINCT s.doc_id, s.i FROM s JOIN r ON r.doc_id = s.doc_id AND s.i BETWEEN r.i AND r.last WHERE r.k > 1 AND s.line <> ''
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text
  FROM l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.i = l.i) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
       coalesce(n.n, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) n USING (doc_id)
"""
