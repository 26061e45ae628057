"""Full-text search by a stored positional index, ranked by cover density.

Postings (word, part, doc_id, positions) are bucketed and sorted by word and
part; a part is a range of document ids, so the postings of a frequent word are
many rows of many keys. A search joins the words of its queries with the postings
alone; texts aren't read again, and appended documents are found at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pulseloom.sources.shared import staged

#: Document ids of a part.
PART_DOCS = 1 << 20
#: What a cover of adjacent words counts.
COVER_WEIGHT = 0.1


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def cover_density(hits: list[tuple[int, int]], n: int) -> tuple[int, float]:
    """Number of covers, and the sum of COVER_WEIGHT / (1 + words between), of hits (position, number of word) of ``n`` words.

    A cover is a stretch of text that holds all words and no shorter stretch that does.
    """
    last: dict[int, int] = {}
    covers, rank, before = 0, 0.0, -1
    places = [p for p, _ in hits]
    at = {p: i for i, p in enumerate(places)}
    for p, w in hits:
        last[w] = p
        if len(last) == n:
            start = min(last.values())
            if start > before:  # the first end for this start
                before = start
                covers += 1
                rank += COVER_WEIGHT / (1 + (p - start) - (at[p] - at[start]))
    return covers, rank


class TextIndex:
    """The index below ``location``; documents are (doc_id, text, tags array<string>, any others)."""

    def __init__(self, spark: SparkSession, location: str, buckets: int = 16):
        self.spark, self.buckets = spark, buckets
        self.name = f"text_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (word STRING, part BIGINT, doc_id BIGINT, positions ARRAY<INT>) USING parquet "
            f"CLUSTERED BY (word, part) SORTED BY (word, part) INTO {buckets} BUCKETS LOCATION '{location.rstrip('/')}'"
        )

    def add(self, docs: DataFrame) -> None:
        """Append documents; the words of the tags stand behind those of the text. Rows without a doc_id aren't found; a null text or tag has no words."""
        whole = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
        rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(words(whole)).alias("position", "word"))
        # a document's words are grouped where its text was split: one key has one document's words at most
        rows = rows.groupBy("doc_id", "word").agg(F.array_sort(F.collect_set("position")).alias("positions"))
        rows = rows.select("word", F.floor(F.col("doc_id") / PART_DOCS).alias("part"), "doc_id", "positions")
        rows.repartition(self.buckets, "word", "part").write.mode("append").format("parquet").bucketBy(self.buckets, "word", "part").sortBy("word", "part").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The ``k`` best documents that hold all words of each of ``queries`` (query_id, query): covers, rank to six digits, place.

        Equal ranks are placed by ascending doc_id. Queries without words find nothing.
        """
        postings = self.spark.table(self.name)
        asked = queries.select("query_id", F.array_distinct(words(F.col("query"))).alias("w")).withColumn("n", F.size("w")).select("query_id", "n", F.posexplode("w").alias("number", "word"))
        # a document that holds all words holds the rarest one: its postings name the candidates of a query, and only theirs are looked up
        known = postings.join(asked.select("word").distinct(), "word", "left_semi")
        sizes = known.groupBy("word").agg(F.count(F.lit(1)).alias("size"))
        own = Window.partitionBy("query_id")
        asked = staged(asked.join(sizes, "word").withColumn("held", F.count(F.lit(1)).over(own)).where("held = n").withColumn("place", F.row_number().over(own.orderBy("size", "word"))).drop("held", "size"), "asked")
        candidates = asked.where("place = 1").select("query_id", "word").join(known.select("word", "part", "doc_id"), "word").select("query_id", "part", "doc_id").distinct()
        found = candidates.join(asked, "query_id").join(known, ["word", "part", "doc_id"])
        hits = F.transform("positions", lambda p: F.struct(p.alias("p"), F.col("number").alias("w")))
        g = found.groupBy("query_id", "doc_id").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("found"), F.array_sort(F.flatten(F.collect_list(hits))).alias("hits")).where("found = n")
        kind = queries.schema["query_id"].dataType.simpleString()

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scored = [cover_density([(h["p"], h["w"]) for h in hits], n) for hits, n in zip(batch.column("hits").to_pylist(), batch.column("n").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("doc_id"), pa.array([c for c, _ in scored], pa.int64()), pa.array([r for _, r in scored], pa.float64())], names=["query_id", "doc_id", "covers", "rank"])

        ranked = g.select("query_id", "doc_id", "n", "hits").mapInArrow(rank, f"query_id {kind}, doc_id long, covers long, rank double").withColumn("rank", F.round("rank", 6))
        w = Window.partitionBy("query_id").orderBy(F.desc("rank"), "doc_id")
        return ranked.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)
