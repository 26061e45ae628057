"""Connected components by alternating large-star and small-star steps.

Each step only groups by a node for its smallest neighbour and joins that back,
so no component is ever gathered in one place; each is written to the shared
folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseloom.llm.work import staged

#: Edges that a step writes to a file.
EDGES_PER_FILE = 250_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum("b")).first())


def _star(pairs: DataFrame, larger: bool, files: int) -> DataFrame:
    """One step over directed pairs (a, b): every b of an a is tied to the smallest of a and its neighbours.

    What a step writes goes to ``files`` files, in proportion to the edges: small
    graphs don't pay for a task and a file per shuffle partition at each step.
    """
    least = pairs.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("least", "a"))
    least = staged(least.coalesce(files), "least")
    tied = pairs.join(least, "a")
    if larger:
        tied = tied.where(F.col("b") > F.col("a"))
        out = tied.select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return staged(out.where(F.col("a") != F.col("b")).distinct().coalesce(files), "star")


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) of the nodes of undirected ``edges`` (a, b): the smallest node that each reaches.

    Loops and repeated edges are allowed; rows with nulls are left out.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    loops = None
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    loops = edges.where("a = b").select("a")
    edges = edges.where("a > b")
    before = _state(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        files = 1 + before[0] // EDGES_PER_FILE
        edges = _star(_star(both, True, files), False, files)
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    alone = loops.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return found.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
