"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as
Parquet and read again as the next stage's documents. All but the last keep the
columns of ``documents``. A stage reads every row that the one before it kept.
Each takes null, empty and long texts, rows without a doc_id, repeated rows,
further columns, and an empty table, which gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulseloom.llm import exact_dedup, near_dedup, packing, secrets, toxicity
from pulseloom.llm.work import scratch
from pulseloom.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows that aren't held out, rejects go.

    Null texts are scored as empty ones. Repeated rows stay or go together.
    Without labels of both classes nothing is rejected unless most labels are toxic.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the most characters, then the smallest doc_id, stays.

    Null and empty texts are equal. Of repeated rows one stays; rows without a doc_id all do.
    """
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity 0.8 or more) the one of the smallest doc_id stays.

    Texts without words, and rows without a doc_id, are linked with nothing and stay.
    """
    return near_dedup.keep_one(docs, size=5, percent=80).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and n_chars follows; every row stays, null texts stay null."""
    return secrets.redact_secrets(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences for training: a row per piece. A null or empty text is its end id alone; repeated rows are packed as often."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", redact),
    ("packing", pack),
]

#: Training, sketches and packing can't be expressed in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage stages on its way is deleted when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
