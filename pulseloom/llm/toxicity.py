"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The classifier is fitted on a bounded sample of labelled training rows: document
counts of each n-gram by class give the log-count ratios, the n-grams that tell
the classes apart best are its features, and a logistic regression over presence
times ratio gives the weights. Scoring reads every whole text.

The sample is counted in groups of documents. An n-gram that occurs in more
documents than there are groups occurs twice in one of them, so only n-grams that
do are candidates; these are then counted in full. What the model is depends on
the sample alone, not on how rows fall into tasks or batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pulseloom.llm.work import tidy

#: The classifier is fitted on at most so many labelled rows of each class, those of smallest hash.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3_000, 6_000
#: Lengths of the n-grams in characters, white space at both ends of a text included.
LENGTHS = (3, 4, 5)
#: From the space before each word, longer n-grams up to this length are taken too.
WORD_LENGTH = 13
#: An n-gram is a feature if it is in so many sampled documents (more than there are groups, too) and among so many that tell the classes apart best.
LEAST_DOCS, CANDIDATES, FEATURES = 4, 65_536, 2_048
#: Sampled documents of a group that is counted at once, and the n-grams of it that are held at once.
GROUP_DOCS, HELD = 800, 1 << 22
#: Of the logistic regression, on squared weights.
REGULARISATION = 1e-3
#: Added to both counts of an n-gram.
SMOOTHING = 1.0
#: predicted is 1 from this score on.
TOXIC_FROM = 0.7
#: Characters that are hashed at once.
CHUNK = 1 << 16

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: the CRC-32 of its id as text leaves 1 modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".replace("\n", " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _hashes(chars: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of the n-grams: of each of LENGTHS anywhere, of longer ones from a space on."""
    out, h, size = [], chars, len(chars)
    for n in range(2, max(LENGTHS) + 1):
        h = h[: max(0, size - n + 1)] * _STEP + chars[n - 1 :]
        if n in LENGTHS:
            out.append(_mixed(h))
    at = np.flatnonzero(chars[: len(h)] == 32)
    h = h[at]
    for n in range(max(LENGTHS) + 1, WORD_LENGTH + 1):
        inside = at + n - 1 < size
        at, h = at[inside], h[inside]
        h = h * _STEP + chars[at + n - 1]
        out.append(_mixed(h))
    return out


def ngrams(text: str, part: int = 0, parts: int = 1) -> np.ndarray:
    """The distinct n-grams of a text; of several parts by hash, those of one."""
    chars, found = _characters(text), np.zeros(0, np.uint64)
    for at in range(0, max(1, len(chars) - 1), CHUNK):
        h = np.concatenate(_hashes(chars[at : at + CHUNK + WORD_LENGTH - 1]))
        found = np.union1d(found, h if parts == 1 else h[h % np.uint64(parts) == part])
    return found


@dataclass
class Model:
    """Sorted n-gram hashes, the weight of each, and the intercept."""

    keys: np.ndarray
    weights: np.ndarray
    intercept: float

    def __post_init__(self):
        self.may = np.zeros(1 << 20, bool)
        self.may[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def present(self, text: str) -> np.ndarray:
        """The features (places in keys) that a text has."""
        found, chars, longest = [], _characters(text), WORD_LENGTH
        for at in range(0, max(1, len(chars) - 1), CHUNK):
            for h in _hashes(chars[at : at + CHUNK + longest - 1]):
                h = h[self.may[(h >> np.uint64(44)).astype(np.int64)]]
                if len(h):
                    k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                    found.append(k[self.keys[k] == h])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[self.present(text)].sum(), -40, 40))))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled rows that aren't held out."""
    ids = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    order = [F.xxhash64("doc_id"), "doc_id", "toxic"]
    chosen = ids.where("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(ids.where("toxic = 0").orderBy(*order).limit(SAMPLE_CLEAN))
    # the chosen ids are bounded by the two parameters
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit the classifier. Without rows of both classes, every score is the smoothed share of toxic rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    rows = sample(docs, labels).persist()
    try:
        by_class = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
        toxic, clean = by_class.get(1, 0), by_class.get(0, 0)
        prior = float(np.log((toxic + 1) / (clean + 1)))
        nothing = Model(np.zeros(0, np.uint64), np.zeros(0), prior)
        if not toxic or not clean:
            return nothing
        groups = -(-(toxic + clean) // GROUP_DOCS)
        least = max(LEAST_DOCS, groups + 1)
        counts = pa.schema([("key", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])

        def as_table(keys: np.ndarray, n_toxic: np.ndarray, n_clean: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n_toxic.astype(np.int64)), pa.array(n_clean.astype(np.int64))], schema=counts)

        def count(table: pa.Table) -> pa.Table:
            texts = list(zip(table.column("text").to_pylist(), table.column("toxic").to_pylist(), strict=True))
            out, parts = [], 1 + 4 * sum(len(t) for t, _ in texts) // HELD
            for part in range(parts):
                own = [(ngrams(t, part, parts), c) for t, c in texts]
                keys, n = np.unique(np.concatenate([k for k, _ in own]), return_counts=True)
                keys = keys[n > 1]
                n = np.zeros((2, len(keys)), np.int64)
                for k, c in own:
                    at = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
                    n[c, at[keys[at] == k] if len(keys) else at[:0]] += 1
                out.append(as_table(keys, n[1], n[0]))
            return pa.Table.from_batches(out, schema=counts)

        def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = np.zeros((2, len(candidates.keys)), np.int64)
                for t, c in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                    n[c, candidates.present(t)] += 1
                some = np.flatnonzero(n.sum(0))
                yield as_table(candidates.keys[some], n[1, some], n[0, some])

        def best(counted: DataFrame, most: int, least: int) -> pd.DataFrame:
            """The n-grams in ``least`` documents whose shares in the two classes differ most against their common spread, ``most`` at most."""
            counted = counted.groupBy("key").agg(F.sum("toxic").alias("p"), F.sum("clean").alias("q")).where(F.col("p") + F.col("q") >= least)
            p, q = (F.col("p") + SMOOTHING) / (toxic + 2 * SMOOTHING), (F.col("q") + SMOOTHING) / (clean + 2 * SMOOTHING)
            both = (F.col("p") + F.col("q") + 2 * SMOOTHING) / (toxic + clean + 4 * SMOOTHING)
            gap = (p - q) * (p - q) / (both * (1 - both) + 1e-9)
            return counted.select("key", F.log(p / q).alias("ratio"), gap.alias("gap")).orderBy(F.desc("gap"), "key").limit(most).toPandas()

        def sorted_keys(found: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            keys = found["key"].to_numpy(np.int64).view(np.uint64)
            return keys[np.argsort(keys)], found["ratio"].to_numpy()[np.argsort(keys)]

        shape = "key long, toxic long, clean long"
        grouped = rows.select("text", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("part")).groupBy("part")
        keys, _ = sorted_keys(best(grouped.applyInArrow(lambda table: count(table), shape), CANDIDATES, 2))
        if not len(keys):
            return nothing
        candidates = Model(keys, np.zeros(len(keys)), 0.0)
        spread = rows.repartition(groups, "doc_id")
        keys, ratio = sorted_keys(best(spread.mapInArrow(tidy(recount), shape), FEATURES, least))
        blank = Model(keys, np.zeros(len(keys)), 0.0)

        def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                weight = np.where(pdf["toxic"] == 1, 0.5 / toxic, 0.5 / clean) * (toxic + clean)  # both classes count alike
                yield pd.DataFrame({"label": pdf["toxic"].astype(float), "weight": weight, "places": [blank.present(t).tolist() for t in pdf["text"]]})

        n = len(keys)
        vector = F.udf(lambda places: Vectors.sparse(n, places, [float(ratio[k]) for k in places]), VectorUDT())
        data = spread.mapInPandas(tidy(present), "label double, weight double, places array<int>").select("label", "weight", vector("places").alias("features")).persist()
        fit = LogisticRegression(maxIter=50, regParam=REGULARISATION, standardization=False, weightCol="weight").fit(data)
        data.unpersist()
        return Model(keys, ratio * fit.coefficients.toArray(), float(fit.intercept))
    finally:
        rows.unpersist()


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``; null and empty texts have the score of no n-gram."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES keys at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            score = np.array([model.score(t) for t in batch.column("text").to_numpy(zero_copy_only=False)], float)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= TOXIC_FROM).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document of ``docs`` (doc_id, text) by a classifier of ``labels`` (doc_id, toxic).

    Labels that are null or neither 0 nor 1, and those without a doc_id, don't
    count; a document with several labels counts with each. Repeated rows give
    repeated rows, also in training, and a row without a doc_id is scored: its
    held_out is null. An empty table gives an empty result.
    """
    return scored(docs, train(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are predicted to be toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([model.score(t or "") < TOXIC_FROM for t in texts], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
