"""Ranked lexical search by dense blocked matrix products.

Items are the queries. Their terms make up a small vocabulary, so a document
shrinks to the counts of those terms. Documents are packed into tiles, items
into tiles with a compact vocabulary of their own; the impacts of a document
tile times the weights of an item tile are all scores of both, as one dense
product of whole numbers in double precision. Vocabularies are cut into blocks
of which no partial sum can reach 2^53, so every product is exact in any order
of summation; blocks are added as 64-bit integers. Each task keeps the best
documents of every item, ties by id, and two grouped steps merge the tasks.

Many items are searched in rounds of a bounded size, each of which is broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pulseloom.llm.words import words
from pulseloom.llm.work import staged, tidy

#: Documents and items of a tile, and terms of a block of a tile's vocabulary.
TILE_DOCS, TILE_ITEMS, BLOCK_TERMS = 1024, 64, 4096
#: Characters of the items of a round, with so many more for each item; only a single longer item makes a longer round.
ROUND_CHARS, ROW_CHARS = 1 << 24, 64
#: No impact is above this, and no partial sum of a product may reach EXACT.
IMPACT, EXACT = 1_000_000, 1 << 53
#: Groups in which the best of an item's documents are merged first.
SALTS = 32

TILE = "n_docs long, n_terms long, ids binary, known binary, lengths binary, doc binary, term binary, tf binary"
BEST = "item long, doc_id long, score long"


def term_weight(n: int, df: int) -> int:
    """The weight of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def item_tiles(counts: list[dict[int, int]], weights: np.ndarray, limit: int = EXACT, most: int = BLOCK_TERMS) -> list[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first item, items, blocks) of each tile; a block is (terms, matrix of terms by items of weight times occurrences).

    Within a block the sum of a column times the largest impact stays below ``limit``.
    A term for which even that fails has its occurrences dealt over several blocks.
    """
    tiles = []
    for first in range(0, len(counts), TILE_ITEMS):
        own = counts[first : first + TILE_ITEMS]
        rows: list[tuple[int, list[tuple[int, int]]]] = []
        for term in sorted(set().union(*own)):
            w = int(weights[term])
            left = {k: c[term] for k, c in enumerate(own) if term in c} if w else {}
            step = max(1, (limit - 1) // max(1, w * IMPACT))
            while left:
                rows.append((term, [(k, w * min(step, c)) for k, c in left.items()]))
                left = {k: c - step for k, c in left.items() if c > step}
        blocks, terms, sums, entries = [], [], np.zeros(len(own), object), []
        seen: set[int] = set()

        def close() -> None:
            if terms:
                matrix = np.zeros((len(terms), len(own)))
                for r, row in enumerate(entries):
                    for k, v in row:
                        matrix[r, k] = v
                order = np.argsort(terms)
                blocks.append((np.array(terms)[order], matrix[order]))  # noqa: B023
            terms.clear(), entries.clear(), seen.clear()

        for term, row in rows:
            if len(terms) >= most or term in seen or any((sums[k] + v) * IMPACT >= limit for k, v in row):
                close()
                sums[:] = 0
            terms.append(term), entries.append(row), seen.add(term)
            for k, v in row:
                sums[k] += v
        close()
        tiles.append((first, len(own), blocks))
    return tiles


def impacts(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term of ``tf`` occurrences counts in a document of ``length`` terms."""
    m = 75 + (25 * length * n) // max(1, total)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Best:
    """The best documents of each item so far: highest score, then lowest id."""

    def __init__(self, items: int, k: int):
        self.k, self.found = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(items)]
        self.least = np.ones(items, np.int64)

    def add(self, first: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores (documents by items) of the items from ``first`` on. Ties with the last one kept are compared by id."""
        doc, item = np.nonzero(scores >= self.least[first : first + scores.shape[1]])
        order = np.argsort(item, kind="stable")
        doc, item = doc[order], item[order]
        bounds = np.flatnonzero(np.diff(item, prepend=-1, append=-1)) if len(item) else []
        for at, end in zip(bounds[:-1], bounds[1:], strict=True):
            k = first + int(item[at])
            rows = doc[at:end]
            s, i = np.concatenate([self.found[k][0], scores[rows, item[at]]]), np.concatenate([self.found[k][1], ids[rows]])
            top = np.lexsort((i, -s))[: self.k]
            self.found[k] = s[top], i[top]
            if len(top) == self.k:
                self.least[k] = s[top[-1]]

    def batch(self) -> pa.RecordBatch:
        n = [len(s) for s, _ in self.found]
        join = lambda p: np.concatenate([f[p] for f in self.found]) if n else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(n)), n)), pa.array(join(1)), pa.array(join(0))], names=["item", "doc_id", "score"])


def document_tiles(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``docs`` (doc_id long, text binary) in packed tiles: lengths of all documents, counts of the terms of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def pack(ids: list, lengths: list, found: list[Counter]) -> pa.RecordBatch:
        sizes = np.array([len(c) for c in found])
        term = np.fromiter((t for c in found for t in c), np.int32, int(sizes.sum()))
        tf = np.fromiter((v for c in found for v in c.values()), np.int32, int(sizes.sum()))
        packed = [np.array([i or 0 for i in ids], "<i8"), np.array([i is not None for i in ids], np.uint8), np.array(lengths, "<i8"), np.repeat(np.arange(len(ids)), sizes).astype("<i4"), term, tf]
        one = [pa.array([sum(n > 0 for n in lengths)], pa.int64()), pa.array([sum(lengths)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in packed)]
        return pa.RecordBatch.from_arrays(one, names=["n_docs", "n_terms", "ids", "known", "lengths", "doc", "term", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        ids, lengths, found = [], [], []
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = words(text.as_py())
                count = Counter(map(get, own))
                count.pop(None, None)
                ids.append(i), lengths.append(len(own)), found.append(count)
                if len(ids) == TILE_DOCS:
                    yield pack(ids, lengths, found)
                    ids, lengths, found = [], [], []
        if ids:
            yield pack(ids, lengths, found)

    return docs.mapInArrow(tidy(run), TILE)


def best_of_round(docs: DataFrame, items: list[tuple[int, dict[bytes, int]]], k: int) -> DataFrame:
    """(item, doc_id, score) of the best documents of each task for items (number, counts of terms) of one round."""
    spark = docs.sparkSession
    vocabulary = {t: n for n, t in enumerate(sorted(set().union(*(c for _, c in items))))}
    tiles = staged(document_tiles(docs, vocabulary), "document_tiles")
    size = len(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for term in batch.column("term"):
                df += np.bincount(np.frombuffer(term.as_py(), "<i4"), minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    total = tiles.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
    n, terms = total.n, total.terms
    weights = np.zeros(size, np.int64)
    for row in tiles.select("term").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        weights[row.term] = term_weight(n, row.df)
    packed = item_tiles([{vocabulary[t]: c for t, c in counts.items()} for _, counts in items], weights)
    shared = spark.sparkContext.broadcast((packed, np.array([number for number, _ in items], np.int64)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, numbers = shared.value
        best = Best(len(numbers), k)
        for batch in batches:
            for row in batch.to_pylist():
                read = lambda c, kind: np.frombuffer(row[c], kind)  # noqa: B023, E731
                ids, known, lengths, doc, term = read("ids", "<i8"), read("known", np.uint8) > 0, read("lengths", "<i8"), read("doc", "<i4"), read("term", "<i4")
                impact = impacts(read("tf", "<i4").astype(np.int64), lengths[doc], n, terms).astype(np.float64)
                for first, many, blocks in packed:
                    scores = np.zeros((len(ids), many), np.int64)
                    for vocab, matrix in blocks:
                        at = np.minimum(np.searchsorted(vocab, term), len(vocab) - 1)
                        hit = vocab[at] == term
                        tile = np.zeros((len(ids), len(vocab)))
                        tile[doc[hit], at[hit]] = impact[hit]
                        scores += (tile @ matrix).astype(np.int64)
                    best.add(first, ids[known], scores[known])
        out = best.batch()
        yield out.set_column(0, "item", pa.array(numbers[out.column(0).to_numpy()]))

    return tiles.mapInArrow(tidy(search), BEST)


def _top(df: DataFrame, k: int, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of ``docs`` (doc_id, text) with the highest scores for each of ``items`` (item_id, text).

    Other columns are left out, whatever their names. Equal scores are ranked by
    ascending doc_id; documents with score 0 aren't returned. Null and empty
    texts have no terms: such a document counts nowhere, such an item has no
    rows. Repeated rows of documents each count and are each ranked; repeated
    rows of items are one item, and rows of one item_id with different texts are
    ranked apart. Documents without a doc_id count in the statistics but aren't
    ranked. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    own = items.select("item_id", "text").where("length(text) > 0").distinct().withColumn("key", F.xxhash64("item_id", "text"))
    size, rounds = (F.char_length("text") + ROW_CHARS).alias("size"), 1
    while own.groupBy(F.pmod("key", F.lit(rounds)).alias("round")).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n")).where((F.col("size") > ROUND_CHARS) & (F.col("n") > 1)).limit(1).count():
        rounds *= 2
    w = Window.partitionBy("round").orderBy("key", "item_id", "text")
    own = staged(own.withColumn("round", F.pmod("key", F.lit(rounds)).cast("int")).withColumn("number", F.row_number().over(w).cast("long")), "items")
    found: list[DataFrame] = []
    for r in sorted(x["round"] for x in own.select("round").distinct().collect()):
        of_round = own.where(F.col("round") == r)
        counts = [(x.number, Counter(words(x.text.encode()))) for x in of_round.orderBy("number").toLocalIterator()]
        counts = [x for x in counts if x[1]]
        if counts:
            best = _top(best_of_round(docs, counts, k).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), k, "item", "salt")
            best = _top(best.select("item", "doc_id", "score"), k, "item")
            found.append(best.join(F.broadcast(of_round.select(F.col("number").alias("item"), "item_id")), "item"))
    out = found[0] if found else spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
a AS (SELECT count(*) AS n_docs, sum(len(terms)) AS n_terms FROM d WHERE len(terms) > 0),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
      FROM p, a GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, CAST(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN p USING (term), a GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
