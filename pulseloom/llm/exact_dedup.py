"""Exact deduplication by a persistent digest index.

The index is a table of digests, bucketed and sorted by hash. A batch of new
documents is reduced to one row per digest (aggregated before the shuffle),
meets the index in a sort-merge anti-join that needs no shuffle of the index,
and what is new is appended. The same index answers, for any document, which
row stays for its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseloom.llm.work import new_path, new_table, staged

#: The characters that are deleted before texts are compared: \x20 and \x09 to \x0D.
WHITE_SPACE = " \t\n\x0b\x0c\r"

#: A digest that has this share of a batch's rows or more is hot: at most 1 / HOT_SHARE digests are.
HOT_SHARE = 0.001


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text without white space; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "").cast("binary"), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_chars) of every document; other columns are left out, whatever their names."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        digest(F.col(text_col)).alias("digest"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_chars"),
    )


def representatives(found: DataFrame) -> DataFrame:
    """One row per digest: the row that stays (most code points, then smallest id; one without an id never) and the number of rows."""
    best = F.max_by(F.col("doc_id"), F.when(F.col("doc_id").isNotNull(), F.struct("n_chars", -F.col("doc_id"))))
    return found.groupBy("digest").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


class DigestIndex:
    """A persistent table (digest, keep_id, group_size, batch), bucketed and sorted by digest.

    ``location`` is a folder in shared storage; opening an existing one needs the
    bucket count it was made with. Batches are appended as further sorted files
    of the same buckets.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int = 64):
        self.spark, self.location, self.buckets = spark, location.rstrip("/"), buckets
        self.name = new_table("digest_index")
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT, group_size BIGINT, batch INT) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.location}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def fresh(self, reps: DataFrame) -> DataFrame:
        """The representatives whose digest the index lacks (sort-merge anti-join)."""
        return reps.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, fresh: DataFrame, batch: int) -> None:
        """Add rows that ``fresh`` returned."""
        rows = fresh.select("digest", "keep_id", "group_size", F.lit(batch).cast("int").alias("batch"))
        (
            rows.repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)

    def add(self, docs: DataFrame, batch: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Take in a batch; returns (doc_id, digest, n_chars) of its rows, staged.

        Documents whose text an earlier batch had are left out of the index: the
        earlier row stays.
        """
        found = staged(digests(docs, id_col, text_col), "digests")
        self.append(self.fresh(representatives(found)), batch)
        return found

    def resolve(self, found: DataFrame) -> DataFrame:
        """For each row of ``found``: keep_id and group_size of its digest in the index.

        Digests with a thousandth of all rows or more, at most a thousand, are
        broadcast; the others meet in a join in which no key is large.
        """
        total = found.count()
        least = max(2, int(total * HOT_SHARE))
        rows = self.table().select("digest", "keep_id", "group_size")
        # at most 1 / HOT_SHARE rows can have that many copies in this batch
        hot = staged(found.groupBy("digest").count().where(F.col("count") >= least).select("digest"), "hot")
        hot = rows.join(F.broadcast(hot), "digest", "left_semi").select("digest", F.struct("keep_id", "group_size").alias("known"))
        marked = found.join(F.broadcast(hot), "digest", "left")
        cold = marked.where(F.col("known").isNull()).drop("known").join(rows.hint("merge"), "digest")
        done = marked.where(F.col("known").isNotNull()).select("doc_id", "digest", "n_chars", "known.keep_id", "known.group_size")
        return done.unionByName(cold.select("doc_id", "digest", "n_chars", "keep_id", "group_size"))


def exact_dedup(docs: DataFrame, location: str | None = None, buckets: int = 64) -> DataFrame:
    """Group ``docs`` (doc_id, text, any others) by equal text.

    Texts are equal when identical after white space is deleted. Of equal texts
    the one with the most code points, then the smallest doc_id, stays. Null and
    empty texts are one group. A repeated row counts as a row of its group. Rows
    without a doc_id count too and are kept. An empty table gives an empty
    result. Returns doc_id, keep_id, group_size (rows of the batch that brought
    the text into the index), kept and text_sha256, a row for each row of ``docs``.
    """
    spark = docs.sparkSession
    index = DigestIndex(spark, location or new_path(spark, "digest_index"), buckets)
    found = index.add(docs)
    return index.resolve(found).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull()).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, by the rules of exact_dedup; rows without a doc_id stay.

    Of repeated rows of the document that stays, one does (with the most
    characters, then by a hash of all its columns).
    """
    found = exact_dedup(docs).where("doc_id IS NOT NULL")
    marks = found.groupBy(F.col("doc_id").alias("__id")).agg(F.bool_or("kept").alias("__kept"), F.count(F.lit(1)).alias("__rows"))
    marks = staged(marks.where("__rows > 1 OR NOT __kept"), "marks")
    own = F.col("doc_id").cast("long")
    left = docs.join(marks.select("__id"), own == F.col("__id"), "left_anti")
    repeated = marks.where("__rows > 1").select("__id")
    if repeated.isEmpty():
        return left
    # ids of several rows, whose texts may differ: those that keep their text, and of their equal rows one
    stay = found.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest")).join(repeated, "__id", "left_semi").distinct()
    again = docs.join(repeated, own == F.col("__id"), "left_semi").select(own.alias("__id"), digest(F.col("text")).alias("__digest"), F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    again = again.join(stay, ["__id", "__digest"], "left_semi")
    best = F.struct(F.char_length("__row.text"), F.bitwise_not(F.xxhash64(*[F.col("__row").getField(c) for c in docs.columns])))
    again = again.groupBy("__id", "__digest").agg(F.max_by("__row", best).alias("__row")).select("__row.*")
    return left.unionByName(again)


ORACLE = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
