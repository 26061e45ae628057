"""Betweenness against enumerated paths on random graphs."""

import itertools
import random

from pulseloom.operators.graphs import betweenness


def brute(edges):
    nodes = sorted({x for e in edges for x in e})
    near = {n: {b for a, b in edges if a == n} | {a for a, b in edges if b == n} for n in nodes}

    def paths(a, b):
        level, found = [[a]], []
        while level and not found:
            found = [p for p in level if p[-1] == b]
            level = [[*p, n] for p in level for n in near[p[-1]] if n not in p]
        return found

    out = dict.fromkeys(nodes, 0.0)
    for a, b in itertools.combinations(nodes, 2):
        found = paths(a, b)
        for p in found:
            for n in p[1:-1]:
                out[n] += 1 / len(found)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(6):
        n = rng.randint(2, 9)
        edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(1, 2 * n))}
        if g == 0:
            edges = {(i, i + 1) for i in range(7)}  # a path
        rows += [(g, f"n{a}", f"n{b}") for a, b in edges]
        for node, v in brute(edges).items():
            want[g, f"n{node}"] = v
    rows += [(0, "n0", "n1"), (0, "n1", "n0"), (0, "n3", "n3"), (0, None, "n1")]
    got = {(r.g, r.node): r.betweenness for r in betweenness(spark.createDataFrame(rows, "g long, m1 string, m2 string"), ["g"]).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert betweenness(spark.createDataFrame([], "g long, m1 string, m2 string"), ["g"]).count() == 0
