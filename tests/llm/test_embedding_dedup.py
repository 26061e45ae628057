"""Links and components against brute force over all pairs."""

import numpy as np

from pulseloom.llm import embedding_dedup as ed


def brute(rows, threshold):
    out = {}
    unit = {}
    for k, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x = np.array(v, float) / max(map(abs, v))
            unit[k] = x / np.linalg.norm(x)
    near = {k: [m for m in unit if m != k and len(unit[m]) == len(unit[k]) and unit[k] @ unit[m] >= threshold] for k in unit}
    for k, (vec_id, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in near.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out.setdefault(vec_id, set()).add((len(near.get(k, ())), min(rows[m][0] for m in seen)))
    return out


def vectors(n=400, dims=8, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dims))
    out = []
    for i in range(n):
        v = centers[rng.integers(12)] + rng.normal(size=dims) * rng.choice([0.05, 0.3, 1.0])
        out.append((i, [float(np.float32(c)) for c in v]))
    out += [(n + i, out[3][1]) for i in range(40)]
    out += [(1000, None), (1001, [0.0] * dims), (1002, [1.0] * (dims - 1) + [None]), (1003, [float("nan")] * dims), (1004, [float("inf")] + [1.0] * (dims - 1)), (1005, []), (1006, [1e-200] * dims), (1007, [1e200] * dims), (1008, [1.0, 2.0]), (1009, [2.0, 4.1])]
    return out


def test_matches_brute_force(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows] + [(None, rows[3][1], 1)], "vec_id long, embedding array<double>, weight int").repartition(3)
    want = brute(rows, 0.9)
    plain = ed.choose_pivots
    monkeypatch.setattr(ed, "PAIRS_AT_ONCE", 500)
    for per_cell, small, block_bytes, always in ((4096, 1024, 1 << 24, False), (40, 1024, 1 << 24, True), (40, 8, 1 << 24, True), (30, 8, 25 * 64, True), (30, 8, 25 * 64, False)):
        monkeypatch.setattr(ed, "PER_CELL", per_cell)
        monkeypatch.setattr(ed, "SMALL", small)
        monkeypatch.setattr(ed, "BLOCK_BYTES", block_bytes)
        monkeypatch.setattr(ed, "choose_pivots", (lambda sample, total, reach: ed._spread(sample, total // ed.PER_CELL)) if always else plain)
        got = ed.near_duplicate_vectors(df, 0.9).collect()
        assert len(got) == len(rows) + 1
        for r in got:
            if r.vec_id is None:
                assert (r.n_links, r.component_id, r.kept) == (0, None, True)
            else:
                assert want[r.vec_id] == {(r.n_links, r.component_id)} and r.kept == (r.vec_id == r.component_id), (r, want[r.vec_id])


def test_single_precision_table(spark):
    rows = vectors(300, 16, 4)[:300]
    got = ed.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.9).collect()
    want = brute(rows, 0.9)
    assert {r.vec_id: {(r.n_links, r.component_id)} for r in got} == want and max(r.n_links for r in got) > 0


def test_pivots_are_used_where_they_prune():
    rng = np.random.default_rng(3)
    reach = np.sqrt(0.2)
    tight = ed.units(np.repeat(rng.normal(size=(16, 64)), 64, 0) + 0.05 * rng.normal(size=(1024, 64)))
    loose = ed.units(rng.normal(size=(1024, 64)))
    rng.shuffle(tight)
    pivots = ed.choose_pivots(tight, 16 * ed.PER_CELL, reach)
    assert len(pivots) == 16 and ed.cells_of(tight, pivots, reach)[1].sum(1).mean() < 1.1
    few = ed.choose_pivots(loose, 16 * ed.PER_CELL, reach)
    assert 2 <= len(few) <= 8 and 1 < ed.copies(loose, few, reach) <= ed.MOST_COPIES
    assert len(ed.choose_pivots(loose[:300], 300, reach)) >= 2  # whatever the size
    # whatever is within reach meets in a cell
    home, near = ed.cells_of(tight, pivots, reach)
    for a, b in zip(*np.nonzero(tight @ tight.T >= 0.9), strict=True):
        assert near[a, home[b]] or near[b, home[a]]


def test_query_on_a_clustered_table(spark, tmp_path):
    """Through the registered query: most vectors go to one cell, and links and components are those of all pairs."""
    from pulseloom.llm.queries import QUERIES

    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(10, 32)), 30, 0) + 0.12 * rng.normal(size=(300, 32))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x[rng.permutation(300)])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    u = ed.units(np.array([v for _, v in rows]))
    pivots = ed.choose_pivots(u, len(u), np.sqrt(0.2))
    assert len(pivots) == 8 and ed.copies(u, pivots, np.sqrt(0.2)) < 1.6
    got = QUERIES["op3_embedding_dedup"](spark, str(tmp_path)).collect()
    assert {r.vec_id: {(r.n_links, r.component_id)} for r in got} == brute(rows, 0.9) and max(r.n_links for r in got) > 5


def test_empty(spark):
    assert ed.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert ed.near_duplicate_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first().n_links == 0
