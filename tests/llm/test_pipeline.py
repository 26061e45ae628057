"""The pipeline's stages against brute force on a small folder of tables."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulseloom.llm import packing, secrets


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    words = ["house", "river", "stone", "green", "walk", "morning", "letter", "always", "number", "window"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))
    docs, labels = [], []
    for i in range(200):
        toxic = i % 5 == 0
        docs.append((i, text(60) + (" zgrumpf zgrumpling" if toxic else ""), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs += [(300, docs[1][1] + " \n", "en", "s", 0), (301, docs[2][1] + " extra", "en", "s", 0), (302, "password: hunter22 and " + text(30), "en", "s", 0), (303, None, None, None, None), (304, "", "en", "s", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {d[0]: d[1] for d in docs}


def test_stages(spark, folder, tmp_path):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before
    ids = {k: {r.doc_id for r in v} for k, v in seen.items()}
    clean = {i for i in texts if i >= 300 or i % 5}
    assert ids["toxicity"] == clean
    assert ids["exact_dedup"] == clean - {1} - {304}  # 300 has more characters; null and empty are equal
    assert ids["near_dedup"] == ids["exact_dedup"] - {301}
    assert ids["secrets"] == ids["near_dedup"]
    after = {r.doc_id: r.text for r in seen["secrets"]}
    assert all(after[i] == (None if texts[i] is None else secrets.redacted(texts[i], "[secret]")) for i in after) and "hunter22" not in after[302]
    words = packing.byte_ids(*packing.byte_paths())
    pieces = {}
    for r in seen["packing"]:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == ids["secrets"]
    for i, rows in pieces.items():
        ids_bytes = np.array([*words.encode(after[i] or ""), 0], "<u4").tobytes()
        assert sum(r.length for r in rows) * 4 == len(ids_bytes)
        assert all(r.ids_crc32 == zlib.crc32(ids_bytes[4 * r.start : 4 * (r.start + r.length)]) for r in rows)


def test_run(spark, folder):
    path, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert out.agg(F.countDistinct("doc_id")).first()[0] == 200 - 40 + 5 - 3


def test_odd_tables(spark, folder, tmp_path):
    """Empty tables, repeated rows, rows without a doc_id, clashing columns, for each stage."""
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    again = docs.where("doc_id IN (1, 3)")
    odd = docs.unionByName(again).unionByName(again.where("doc_id = 3")).unionByName(docs.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.withColumn("kept", F.lit("x")).withColumn("score", F.lit(1)).withColumn("pii", F.lit(2)).withColumn("component_id", F.lit(3))
    want = {"toxicity": 160 + 5 + 4, "exact_dedup": 160 + 5 - 2 + 1, "near_dedup": 160 + 5 - 3 + 1, "secrets": 160 + 5 - 3 + 1}
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, odd.limit(0), path)
        assert empty.count() == 0 and (name == "packing" or empty.columns == odd.columns)
        stage(spark, odd, path).write.parquet(f"{tmp_path}/{name}")
        columns, odd = odd.columns, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert odd.columns == columns and odd.count() == want[name], name
            assert odd.where("doc_id IS NULL").count() == 1
            assert odd.where("doc_id = 3").count() == (3 if name == "toxicity" else 1)


def test_scratch_is_deleted(spark, folder):
    from pulseloom.llm import work

    path, _ = folder
    before = {t.name for t in spark.catalog.listTables()}
    with work.scratch(spark) as keep:
        out = keep(corpus_pipeline.drop_copies(spark, spark.read.parquet(f"{path}/documents.parquet"), path), "out")
        inside = [what for kind, what in work._SCOPES[-1] if kind == "path"]
        assert inside
    assert out.count() == 203
    assert {t.name for t in spark.catalog.listTables()} == before
    assert not any(os.path.exists(p) for p in inside)
