"""Held-out accuracy, features, and odd inputs."""

import random
import zlib

from pulseloom.llm import toxicity

WORDS = ["house", "river", "stone", "green", "walked", "morning", "letter", "always", "number", "window", "café", "straße"]
BAD = ["zgrumpf", "zgrumpling", "unzgrumpf"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = [rng.choice(WORDS) + rng.choice(["", "s", "er"]) for _ in range(rng.randint(5, 200))]
        for _ in range(2 * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words), "x", 1.0))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(800)
    d = spark.createDataFrame(docs + [(9000, None, "x", 0.0), (9001, "", None, 0.0)], "doc_id long, text string, held_out string, score double")
    lab = spark.createDataFrame(labels + [(5, None), (9000, 7)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect()}
    assert len(rows) == 802
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for i, r in rows.items())
    truth = dict(labels)
    assert sum(rows[i].predicted == truth[i] for i in truth if rows[i].held_out) >= 0.99 * sum(rows[i].held_out for i in truth)
    assert rows[9000].score == rows[9001].score < 0.5
    kept = {r.doc_id for r in toxicity.keep_clean(d, lab).collect()}
    assert kept == {i for i, r in rows.items() if r.predicted == 0}


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(d, none).first().score == 0.5
    assert toxicity.toxicity(d.limit(0), none).count() == 0


def test_chunks_do_not_matter():
    text = "the zgrumpf " * 30_000
    keys = toxicity.ngrams("zgrumpf")
    m = toxicity.Model(keys, keys * 0.0 + 1, 0.0)
    assert len(m.present(text)) == len([k for k in keys if k in set(toxicity.ngrams(text))])


def test_model_depends_on_the_sample_alone(spark, monkeypatch):
    """Batches, partitions and the parts in which n-grams are held change nothing; n-grams of enough documents are never missed."""
    docs, labels = corpus(500, 3)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "GROUP_DOCS", 40)
    models = []
    for held, batch, parts in ((1 << 22, 10_000, 1), (1 << 12, 7, 5)):
        monkeypatch.setattr(toxicity, "HELD", held)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        models.append(toxicity.train(spark.createDataFrame(docs, "doc_id long, text string, x string, y double").repartition(parts), lab))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    a, b = models
    assert (a.keys == b.keys).all() and abs(a.weights - b.weights).max() < 1e-6
    # brute force: the share of each n-gram in both classes, over all documents of the sample
    own = [(set(toxicity.ngrams(t).tolist()), toxic) for (i, t, *_), (_, toxic) in zip(docs, labels, strict=True) if zlib.crc32(str(i).encode()) % 3 != 1]
    n = {c: sum(t == c for _, t in own) for c in (0, 1)}
    count = {c: {} for c in (0, 1)}
    for keys, t in own:
        for k in keys:
            count[t][k] = count[t].get(k, 0) + 1
    groups = -(-len(own) // 40)

    def gap(k):
        x, y = count[1].get(k, 0) + 1, count[0].get(k, 0) + 1
        both = (x + y) / (n[0] + n[1] + 4)
        return (x / (n[1] + 2) - y / (n[0] + 2)) ** 2 / (both * (1 - both) + 1e-9)

    enough = [k for k in {*count[0], *count[1]} if count[0].get(k, 0) + count[1].get(k, 0) > groups]
    least = sorted(map(gap, enough), reverse=True)[: toxicity.FEATURES][-1]
    missed = [k for k in enough if gap(k) > least * (1 + 1e-9) and k not in set(a.keys.tolist())]
    assert not missed, (len(missed), len(a.keys))


def test_long_texts_in_chunks(monkeypatch):
    text = "the zgrumpf walked " * 900
    whole = toxicity.ngrams(text)
    monkeypatch.setattr(toxicity, "CHUNK", 50)
    assert (toxicity.ngrams(text) == whole).all()
    assert sorted(k for p in range(3) for k in toxicity.ngrams(text, p, 3).tolist()) == whole.tolist()
