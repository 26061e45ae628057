"""Ranked lexical search against scores by plain integers."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pulseloom.llm import lexical
from pulseloom.llm.words import words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    found = [(i, Counter(t), len(t)) for i, text in docs for t in [terms(text)]]
    n, total = sum(size > 0 for _, _, size in found), sum(size for _, _, size in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in found:
            score = 0
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * (100 - 25 + (25 * size * n) // total)))
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def made(seed, n):
    rng = random.Random(seed)
    alphabet = ["a", "B", "Ab", "é", "É", "日本", "x9", "😀", "\x00", "İ"]
    word = lambda: rng.choice(alphabet[: rng.randint(1, 10)])
    line = lambda size: "".join(word() + rng.choice([" ", "-", "\n", "", "_", "\x7f"]) for _ in range(size))
    docs = [(i, line(rng.choice([0, 1, 3, 30]))) for i in range(n)]
    docs += [docs[0], (None, line(9)), (n, None), (n + 1, "b " * 3000 + line(500))] + [(1000 + i, "same words é") for i in range(40)]
    return docs, [(7, line(12)), (8, ""), (9, "nothing there qqq"), (10, line(2)), (None, "same é same"), (11, None), (12, "SAME words")]


def test_words_equal_the_pattern():
    for seed in range(20):
        for _, text in made(seed, 50)[0]:
            assert [w.decode() for w in words(None if text is None else text.encode())] == terms(text)


@pytest.mark.parametrize("tile,most,limit", [(1024, 4096, 1 << 53), (7, 2, 1 << 53), (16, 3, 40_000_000_000)])
def test_equals_brute_force(spark, monkeypatch, tile, most, limit):
    monkeypatch.setattr(lexical, "TILE_DOCS", tile)
    monkeypatch.setattr(lexical, "TILE_ITEMS", 3)
    monkeypatch.setattr(lexical.item_tiles, "__defaults__", (limit, most))
    docs, items = made(3, 150)
    d = spark.createDataFrame([(i, t, "fr", 1) for i, t in docs], "doc_id long, text string, score string, rank int").repartition(3)
    q = spark.createDataFrame([*items, items[0]], "item_id long, text string").repartition(2)
    got = sorted(map(tuple, lexical.ranked_search(d, q, k=5).collect()), key=str)
    assert got == brute(docs, items, 5)


def test_rounds(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ROUND_CHARS", 100)
    docs, items = made(5, 40)
    got = sorted(map(tuple, lexical.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
    assert got == brute(docs, items, 20)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert lexical.ranked_search(docs.limit(0), items).count() == 0
    none = lexical.ranked_search(docs, items.limit(0))
    assert none.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")] and none.count() == 0


def test_no_partial_sum_reaches_the_limit():
    rng = random.Random(1)
    counts = [{t: rng.choice([1, 5, 10**6, 10**7]) for t in rng.sample(range(300), 40)} for _ in range(130)]
    weights = np.array([rng.choice([0, 1, 700, 21_000]) for _ in range(300)])
    total = np.zeros((130, 300), object)
    for first, many, blocks in lexical.item_tiles(counts, weights, most=16):
        for vocab, matrix in blocks:
            assert len(vocab) <= 16 and (np.diff(vocab) > 0).all()
            assert (matrix.astype(object).sum(0) * lexical.IMPACT < lexical.EXACT).all()
            for k in range(many):
                total[first + k, vocab] += matrix[:, k].astype(np.int64).astype(object)
    assert all(total[k, t] == c * weights[t] for k, own in enumerate(counts) for t, c in own.items())
