"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseloom.sources.shared import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of undirected ``edges`` (a, b): the smallest node that each reaches.

    In each round every component hooks onto its smallest neighbour, chains of
    hooks are cut short by doubling, and all members take the new name: rounds
    grow with the logarithm of the nodes, not with the longest path. Loops and
    repeated edges are allowed; rows with nulls are left out.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct()
    both = staged(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    named = staged(both.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct(), "named")
    while True:
        ends = both.join(named.select(F.col("node").alias("a"), F.col("component").alias("own")), "a").join(named.select(F.col("node").alias("b"), F.col("component").alias("near")), "b")
        hooks = staged(ends.groupBy("own").agg(F.min("near").alias("to")).where("to < own"), "hooks")
        if hooks.isEmpty():
            return named
        while True:  # a hook onto a component that hooks itself goes where that goes
            further = hooks.select(F.col("own").alias("to"), F.col("to").alias("further"))
            longer = staged(hooks.join(further, "to", "left").select("own", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "hooks")
            hooks = longer.drop("moved")
            if longer.where("moved").isEmpty():
                break
        named = staged(named.join(hooks.withColumnRenamed("own", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "named")


def betweenness(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, betweenness) of the nodes of undirected graphs, one per group of ``keys``, from ``edges`` (keys, m1, m2).

    From every node of every graph at once, a level of equally far nodes a round:
    shortest paths are counted forwards, and each node's share of them is summed
    backwards. A node's betweenness is the share of the shortest paths between
    two others that run through it, summed over these pairs and halved. A node
    with no edge isn't in ``edges`` and has no row. Rows grow with the nodes of
    a graph times those it reaches.
    """
    one = edges.where("m1 IS NOT NULL AND m2 IS NOT NULL AND m1 <> m2").select(*keys, "m1", "m2")
    both = staged(one.unionByName(one.select(*keys, F.col("m2").alias("m1"), F.col("m1").alias("m2"))).distinct(), "edges")
    start = both.select(*keys, F.col("m1").alias("source"), F.col("m1").alias("node")).distinct()
    levels = [staged(start.withColumn("paths", F.lit(1.0)), "level")]
    seen = levels[0].drop("paths")
    at = [*keys, "source", "node"]
    while True:
        further = levels[-1].join(both.withColumnRenamed("m1", "node"), [*keys, "node"]).groupBy(*keys, "source", F.col("m2").alias("node")).agg(F.sum("paths").alias("paths"))
        level = staged(further.join(seen, at, "left_anti"), "level")
        if level.isEmpty():
            break
        levels.append(level)
        seen = staged(seen.unionByName(level.drop("paths")), "seen")
    shares = levels[-1].withColumn("share", F.lit(0.0))
    out = shares.select(*at, "share")
    for level in reversed(levels[1:-1]):
        behind = shares.select(*keys, "source", F.col("node").alias("m2"), ((1 + F.col("share")) / F.col("paths")).alias("part"))
        passed = both.withColumnRenamed("m1", "node").join(behind, [*keys, "m2"]).groupBy(*at).agg(F.sum("part").alias("part"))
        shares = staged(level.join(passed, at, "left").withColumn("share", F.col("paths") * F.coalesce("part", F.lit(0.0))), "shares")
        out = out.unionByName(shares.select(*at, "share"))
    # a node is no part of the paths that start at it
    return levels[0].select(*keys, "node").join(out.where("source <> node").groupBy(*keys, "node").agg((F.sum("share") / 2).alias("found")), [*keys, "node"], "left").select(*keys, "node", F.coalesce("found", F.lit(0.0)).alias("betweenness"))
