"""The positional index against a plain scan of all texts."""

import random
import re

from pulseloom.operators import text_index as ti

TERMS = re.compile(r"[^\W_]+")


def brute(docs, queries, k):
    out = []
    for q, query in queries:
        asked = list(dict.fromkeys(TERMS.findall((query or "").lower())))
        scored = []
        for i, text, tags in docs:
            own = TERMS.findall(((text or "") + " " + " ".join(t for t in tags or [] if t)).lower())
            if i is None or not asked or not set(asked) <= set(own):
                continue
            covers = []
            for a in range(len(own)):
                for b in range(a, len(own)):
                    if set(asked) <= set(own[a : b + 1]):
                        covers.append((a, b))
                        break
            covers = [c for c in covers if not any(d != c and c[0] <= d[0] and d[1] <= c[1] for d in covers)]
            rank = sum(0.1 / (1 + sum(w not in asked for w in own[a : b + 1])) for a, b in covers)
            scored.append((-round(rank, 6), i, len(covers)))
        out += [(q, i, n, -r, place) for place, (r, i, n) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ti, "PART_DOCS", 16)
    rng = random.Random(3)
    pool = ["sleep", "Heart", "rate", "tea", "élan", "x1", "日本", "walk"]
    text = lambda n: " ".join(rng.choice(pool) + rng.choice(["", ",", ".\n", " -"]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 5, 30])), rng.choice([None, [], ["tea", None], ["walk", "x1 y2"]])) for i in range(90)]
    docs += [(100, None, ["sleep", "tea"]), (None, "sleep tea heart", None)]
    queries = [(1, "sleep tea"), (2, "Heart RATE heart"), (3, ""), (4, None), (5, "nothing"), (6, "élan 日本 x1"), (7, "walk"), (8, "y2 tea")]
    schema = "doc_id long, text string, tags array<string>"
    index = ti.TextIndex(spark, str(tmp_path / "index"), buckets=3)
    index.add(spark.createDataFrame(docs[:50], schema))
    q = spark.createDataFrame(queries, "query_id long, query string")
    read = lambda: sorted((r.query_id, r.doc_id, r.covers, r["rank"], r.k) for r in index.search(q, 6).collect())
    assert read() == brute(docs[:50], queries, 6)
    index.add(spark.createDataFrame(docs[50:], schema))  # searchable without a rebuild
    assert read() == brute(docs, queries, 6) and len(read()) > 20
    index.add(spark.createDataFrame([], schema))
    assert index.search(q.limit(0)).count() == 0
