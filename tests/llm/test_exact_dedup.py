"""Groups against brute force; the index across batches."""

import hashlib
import random

from pulseloom.llm import exact_dedup as ed

WHITE = str.maketrans("", "", ed.WHITE_SPACE)
TEXTS = ["a b", "ab", " a\tb\n", "", None, "\x0b\x0c\r ", "é x", "éx ", "x" * 100_000, "x" * 99_999 + " x", "AB", "a\xa0b", "solo"]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(WHITE), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}


def test_groups_match_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(100 + i, "hot copy" + " " * (i % 3)) for i in range(500)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, kept int").repartition(5)
    got = ed.exact_dedup(df, buckets=4).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size, r.text_sha256) == want[r.doc_id] and r.kept == (r.keep_id == r.doc_id)


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in ed.exact_dedup(df, buckets=2).collect()) == [(1, 1, 2), (1, 1, 2), (2, 2, 1)]
    assert ed.exact_dedup(df.limit(0), buckets=2).count() == 0


def test_index_outlives_a_batch(spark, tmp_path):
    where = str(tmp_path / "index")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    ed.DigestIndex(spark, where, 4).add(first, batch=0)
    index = ed.DigestIndex(spark, where, 4)  # opened again, as by a later job
    second = spark.createDataFrame([(3, "a "), (4, "c"), (5, "c")], "doc_id long, text string")
    found = index.add(second, batch=1)
    got = {r.doc_id: r.keep_id for r in index.resolve(found).collect()}
    assert got == {3: 1, 4: 4, 5: 4} and index.table().count() == 3
    plan = index.fresh(ed.representatives(found))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_keep_one(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a b", "ab", "a  b", "c", "", None, "d" * i]), "x") for i in range(60)]
    # repeated ids: equal rows, equal texts with other white space, other texts; rows without an id
    rows += rows[:20] + [(3, "q q", "x"), (3, "qq", "x"), (3, "qq", "y"), (70, "solo", "x"), (70, "duo", "x"), (None, "c", "x"), (None, "c", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(4)
    plain = lambda t: "".join((t or "").split())
    best = {}
    for i, t, _ in rows:
        if i is not None:
            best[plain(t)] = min(best.get(plain(t), (1, 0)), (-len(t or ""), i))
    kept = sorted((i, plain(t)) for t, (_, i) in best.items())
    got = ed.keep_one(df).collect()
    assert sorted((r.doc_id, plain(r.text)) for r in got if r.doc_id is not None) == kept
    assert sum(r.doc_id is None for r in got) == 2 and ed.keep_one(df.limit(0)).count() == 0
    assert all(len(r.text or "") == -best[plain(r.text)][0] for r in got if r.doc_id is not None)
