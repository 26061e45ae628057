"""Density clusters in any number of dimensions, by a grid.

Points of equal coordinates are one point with a weight. Cells have a diagonal of
``eps``, so all points of a cell are near each other: a cell of ``least`` points is
all core and needs no pairs, and a cell's core points are one cluster whatever
their number. What is near is found in boxes of several ``eps`` that also hold
the points around them. Rows within eps of a point of a sparse cell are sought
among ``least`` points of each cell first, and only where these are too few among
the others of full cells. Cells are linked through ``least`` core points of each
first; only cells that are still apart are then compared whole. So the work grows
with the cells, not with the pairs of rows in a dense place, and no pair is left out.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseloom.operators.graphs import components
from pulseloom.sources.shared import staged

#: Dimensions that make up the key of a box, and the side of a box in eps.
KEY_DIMS, BOX = 6, 4
#: Core points of a cell that are compared at once with those of another.
BLOCK = 4096
#: Points of a box that are compared at once: those asked for, and those around them.
OWN_BLOCK, OTHER_BLOCK = 16384, 65536
#: Points that are compared with each other at once.
TILE = 64


def _squares(parts: list[Column]) -> Column:
    return sum((p * p for p in parts), F.lit(0.0))


def _apart(a: str, b: str, d: int) -> Column:
    """Squared distance of two points (arrays)."""
    return _squares([F.col(a)[i] - F.col(b)[i] for i in range(d)])


def _box_gap(x: str, low: str, high: str, d: int) -> Column:
    """Squared distance of a point from a box."""
    return _squares([F.greatest(F.lit(0.0), F.col(low)[i] - F.col(x)[i], F.col(x)[i] - F.col(high)[i]) for i in range(d)])


def _longer(along: Column):
    return lambda key: F.transform(along, lambda v: F.concat(key, v.cast("string"), F.lit(",")))


def _around(low: str, high: str, d: int, eps: float) -> Column:
    """Keys of the boxes within eps of what lies between two corners."""
    place = lambda v: F.floor(v / (BOX * eps) + 0.5)
    keys = F.array(F.lit(""))
    for i in range(min(d, KEY_DIMS)):
        along = F.sequence(place(F.col(low)[i] - eps * (1 + 1e-9)), place(F.col(high)[i] + eps * (1 + 1e-9)))
        keys = F.flatten(F.transform(keys, _longer(along)))
    return F.transform(keys, lambda k: F.concat(k, F.lit("|"), F.col("g")))


def _own(x: str, d: int, eps: float) -> Column:
    """Key of the box that a point lies in."""
    inside = [F.concat(F.floor(F.col(x)[i] / (BOX * eps) + 0.5).cast("string"), F.lit(",")) for i in range(min(d, KEY_DIMS))]
    return F.concat(*inside, F.lit("|"), F.col("g"))


def _kernels(d: int, eps: float, least: int):
    """What is done with the points of a box, or of two cells, in a task; everything is nested, so that executors need no module."""

    def arrays(table: pa.Table, *names: str):
        import numpy as np

        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        return np.ascontiguousarray(x), *[table.column(n).to_numpy() for n in names]

    def apart(p, q):
        """Squared distances of all points of p from all of q, summed as ``_apart`` does."""
        out = 0.0
        for i in range(d):
            out = out + (p[:, None, i] - q[None, :, i]) ** 2
        return out

    def reachable(p, q):
        """Whether each point of q is within eps of the box around p."""
        low, high = p.min(0) - eps * (1 + 1e-9), p.max(0) + eps * (1 + 1e-9)
        inside = (q[:, 0] >= low[0]) & (q[:, 0] <= high[0])
        for i in range(1, d):
            inside &= (q[:, i] >= low[i]) & (q[:, i] <= high[i])
        return inside

    def count_near(table: pa.Table) -> pa.Table:
        """(p, found, near, apart) of each own point: the rows within eps, and which points these are if they are fewer than ``least``."""
        import numpy as np

        x, p, weight, own = arrays(table, "p", "weight", "own")
        out = {"p": [], "found": [], "near": [], "apart": []}
        todo = [(np.flatnonzero(own), np.flatnonzero(~own))] if own.any() else []
        while todo:
            a, b = todo.pop()
            b = b[reachable(x[a], x[b])]
            if len(a) > TILE:
                a = a[np.argsort(x[a, np.argmax(np.ptp(x[a], axis=0))])]
                todo += [(a[: len(a) // 2], b), (a[len(a) // 2 :], b)]
                continue
            far = apart(x[a], x[b])
            near = far <= eps * eps
            for i, n in enumerate((near @ weight[b]).tolist()):
                if n:
                    hits = np.flatnonzero(near[i]) if n < least else []
                    out["p"].append(p[a[i]])
                    out["found"].append(n)
                    out["near"].append(p[b[hits]] if n < least else [])
                    out["apart"].append(far[i, hits] if n < least else [])
        return pa.table(out, schema=pa.schema([("p", pa.int64()), ("found", pa.int64()), ("near", pa.list_(pa.int64())), ("apart", pa.list_(pa.float64()))]))

    def link_cells(table: pa.Table) -> pa.Table:
        """(a, b): each cell with the first of those that it is linked with through the given points."""
        import numpy as np

        x, c = arrays(table, "c")
        cells, of = np.unique(c, return_inverse=True)
        first, left = np.full(len(cells), -1), np.arange(len(of))
        for s in range(len(cells)):
            if first[s] >= 0:
                continue
            first[s] = s
            front, left = left[of[left] == s], left[of[left] != s]
            while len(front) and len(left):
                a, front = front[: 4 * TILE], front[4 * TILE :]
                b, met = left[reachable(x[a], x[left])], np.zeros(len(cells), bool)
                for at in range(0, len(b), 4096):
                    near = b[at : at + 4096]
                    met[of[near[(apart(x[a], x[near]) <= eps * eps).any(0)]]] = True
                if met.any():
                    first[met] = s
                    joins = met[of[left]]
                    front, left = np.concatenate([front, left[joins]]), left[~joins]
        return pa.table({"a": cells, "b": cells[first]})

    def meet(table: pa.Table) -> pa.Table:
        """The clusters of two cells, if core points of both are near."""
        x, side = arrays(table, "side")
        p, q = x[side == "a"], x[side == "b"]
        for at in range(0, len(p), 256):
            if len(q) and (apart(p[at : at + 256], q) <= eps * eps).any():
                return pa.table({"a": table.column("component_a")[:1], "b": table.column("component_b")[:1]})
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    return count_near, link_cells, meet


def dbscan(points: DataFrame, coords: list[str], eps: float, least: int, keys: list[str] = (), id_col: str = "event_id") -> DataFrame:
    """(id, keys, core, cluster) of each row of ``points``, clustered by ``coords`` within each group of ``keys``.

    A row is core if ``least`` rows, itself included, lie within ``eps`` of it.
    Core rows within eps of each other are one cluster, named by its smallest id
    of a core row; other rows within eps of a core row take the cluster of the
    nearest (of equally near ones the smallest cluster); the rest is noise (-1).
    Rows with a null or non-finite coordinate are noise; groups of null keys are
    groups. An empty table gives an empty result.
    """
    keys, d, far = list(keys), len(coords), eps * eps
    side = eps / math.sqrt(d) * (1 - 1e-12)
    count_near, link_cells, meet = _kernels(d, eps, least)
    fine = [F.col(c).cast("double") for c in coords]
    good = F.lit(True)
    for c in fine:
        good = good & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300)
    rows = points.select(F.col(id_col).cast("long").alias("id"), F.to_json(F.struct(*keys)).alias("g") if keys else F.lit("").alias("g"), *keys, F.when(good, F.array(*[c + 0.0 for c in fine])).alias("x"))
    # beyond 9e15 sides two different numbers are more than a side apart
    cell = F.concat_ws(",", F.transform("x", lambda v: F.when(F.abs(v / side) < 9e15, F.floor(v / side).cast("string")).otherwise(v.cast("string"))))
    unique = rows.where("x IS NOT NULL").groupBy("g", "x").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("first"))
    unique = staged(unique.select("g", "x", "weight", "first", cell.alias("cell"), F.monotonically_increasing_id().alias("p")), "points")
    # each point with its cell: a number, its rows, and the point's place in it
    inside = Window.partitionBy("g", "cell")
    placed = unique.select("g", "x", "weight", "first", "p", F.sum("weight").over(inside).alias("own"), F.row_number().over(inside.orderBy("p")).alias("k"), F.min("p").over(inside).alias("c"))
    placed = staged(placed, "placed")
    corner = lambda f: F.array(*[f(F.col("x")[i]) for i in range(d)])

    # rows within eps of the points of sparse cells: first of those in sparse cells and a few of each full cell
    asked = placed.where(F.col("own") < least).select("p", "x", "weight", _own("x", d, eps).alias("at"))
    some = placed.where(F.col("k") <= least).select("p", "x", "weight", F.explode(_around("x", "x", d, eps)).alias("at"))
    sizes = asked.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / OWN_BLOCK).cast("int").alias("own_blocks"))
    sizes = staged(sizes.join(some.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / OTHER_BLOCK).cast("int").alias("other_blocks")), "at"), "sizes")
    h = F.xxhash64("p")
    own_copies, other_copies = F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)), F.explode(F.sequence(F.lit(0), F.col("own_blocks") - 1))
    asked_rows = asked.join(sizes, "at").select("at", F.pmod(h, F.col("own_blocks")).cast("int").alias("i"), own_copies.alias("j"), "p", "x", "weight", F.lit(True).alias("own"))
    some_rows = some.join(sizes, "at").select("at", other_copies.alias("i"), F.pmod(h, F.col("other_blocks")).cast("int").alias("j"), "p", "x", "weight", F.lit(False).alias("own"))
    counted = asked_rows.unionByName(some_rows.select(*asked_rows.columns)).groupBy("at", "i", "j").applyInArrow(count_near, "p long, found long, near array<long>, apart array<double>")
    counted = staged(counted, "counted")
    few = counted.groupBy("p").agg(F.sum("found").alias("found")).where(F.col("found") < least)
    few = staged(few.join(placed.select("p", "g", "x"), "p"), "few")
    # then of the rest of the full cells
    full = placed.where(F.col("own") >= least).groupBy("g", "c").agg(corner(F.min).alias("low"), corner(F.max).alias("high"), F.max("k").alias("size")).where(F.col("size") > least)
    full = full.select("c", "low", "high", F.explode(_around("low", "high", d, eps)).alias("at"))
    reach = few.select("p", "x", _own("x", d, eps).alias("at")).join(full, "at").where(_box_gap("x", "low", "high", d) <= far).select("p", "x", "c")
    apart = _apart("x", "y", d)
    more = reach.join(placed.where(F.col("k") > least).select("c", F.col("x").alias("y"), F.col("p").alias("q"), "weight"), "c").where(apart <= far)
    more = staged(more.select("p", "q", apart.alias("apart"), "weight"), "more")
    few = few.select("p", "found").unionByName(more.select("p", F.col("weight").alias("found"))).groupBy("p").agg(F.sum("found").alias("found"))
    lone = few.where(F.col("found") < least).select("p", F.lit(True).alias("lone"))
    marked = staged(placed.join(lone, "p", "left").select("g", "p", "c", "k", "x", "first", F.col("lone").isNull().alias("core")), "marked")

    # cells of core points that are one cluster: first through a few core points of each
    heads = staged(marked.where("core").groupBy("g", "c").agg(F.min("first").alias("first"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), corner(F.min).alias("low"), corner(F.max).alias("high")), "heads")
    some = marked.where(F.col("core") & (F.col("k") <= least)).select("c", "x", F.explode(_around("x", "x", d, eps)).alias("at"))
    parts = some.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / OTHER_BLOCK).alias("parts"))
    some = some.join(parts, "at").select("at", F.pmod(F.xxhash64("c"), F.col("parts")).alias("part"), "c", "x")
    linked = staged(some.groupBy("at", "part").applyInArrow(link_cells, "a long, b long"), "linked")
    named = components(linked)
    # then those that are near each other and still apart, in boxes of more than one cluster
    copies = heads.join(named.withColumnRenamed("node", "c"), "c").select("c", "component", "blocks", "low", "high", F.explode(_around("low", "high", d, eps)).alias("at"))
    shares = copies.groupBy("at", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("at").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("clusters"))
    copies = staged(copies.join(shares.where("clusters > 1").select("at", "main"), "at"), "apart")
    side_of = lambda s: [F.col(n).alias(f"{n}_{s}") for n in ("c", "component", "blocks", "low", "high")]
    pairs = copies.where("component <> main").select("at", "main", *side_of("a")).join(copies.select("at", *side_of("b")), "at")
    gap = _squares([F.greatest(F.lit(0.0), F.col("low_b")[i] - F.col("high_a")[i], F.col("low_a")[i] - F.col("high_b")[i]) for i in range(d)])
    span = _squares([F.greatest(F.col("high_b")[i] - F.col("low_a")[i], F.col("high_a")[i] - F.col("low_b")[i]) for i in range(d)])
    # of two that are both apart from the main cluster of the box, one order is enough
    pairs = pairs.where((F.col("component_a") != F.col("component_b")) & ((F.col("component_b") == F.col("main")) | (F.col("c_a") < F.col("c_b"))) & (gap <= far))
    pairs = staged(pairs.withColumn("whole", span <= far).dropDuplicates(["c_a", "c_b"]), "pairs")
    sure = pairs.where("whole").select(F.col("component_a").alias("a"), F.col("component_b").alias("b"))
    open_pairs = pairs.where("NOT whole")

    def candidates(own: str, other: str) -> DataFrame:
        """Core points of one side within reach of the other's box, a copy per block of the other side."""
        p = marked.where("core").select(F.col("c").alias(f"c_{own}"), "x", F.xxhash64("p").alias("h"))
        p = p.join(open_pairs, f"c_{own}").where(_box_gap("x", f"low_{other}", f"high_{other}", d) <= far)
        mine, copies = F.pmod("h", F.col(f"blocks_{own}")).cast("int"), F.explode(F.sequence(F.lit(0), F.col(f"blocks_{other}") - 1)).alias("copy")
        i, j = (F.col("mine"), F.col("copy")) if own == "a" else (F.col("copy"), F.col("mine"))
        p = p.select("c_a", "c_b", "component_a", "component_b", "x", mine.alias("mine"), copies)
        return p.select("c_a", "c_b", "component_a", "component_b", F.lit(own).alias("side"), "x", i.alias("i"), j.alias("j"))

    met = candidates("a", "b").unionByName(candidates("b", "a")).groupBy("c_a", "c_b", "i", "j").applyInArrow(meet, "a long, b long")
    alone = named.select(F.col("component").alias("a"), F.col("component").alias("b"))
    joined = components(sure.unionByName(met).unionByName(alone))
    clusters = named.join(joined.select(F.col("node").alias("component"), F.col("component").alias("last")), "component").select(F.col("node").alias("c"), "last")
    names = heads.join(clusters, "c").groupBy("last").agg(F.min("first").alias("cluster"))
    clusters = staged(clusters.join(names, "last").select("c", "cluster"), "clusters")

    # what isn't core goes to the nearest core point; fewer than ``least`` points are near it, and all of them were found
    near = counted.join(lone, "p").select("p", F.explode(F.arrays_zip(F.col("near").alias("q"), "apart")).alias("n")).select("p", F.col("n.q").alias("q"), F.col("n.apart").alias("apart"))
    near = near.unionByName(more.join(lone, "p").select("p", "q", "apart"))
    cores = marked.where("core").join(clusters, "c").select("g", "x", "p", "cluster")
    border = near.join(cores.select(F.col("p").alias("q"), "cluster"), "q").groupBy("p").agg(F.min(F.struct("apart", "cluster")).alias("best"))
    border = border.join(marked.select("p", "g", "x"), "p").select("g", "x", F.col("best.cluster").alias("cluster"), F.lit(False).alias("core"))
    done = staged(cores.select("g", "x", "cluster", F.lit(True).alias("core")).unionByName(border), "done")
    out = rows.join(done, ["g", "x"], "left")
    return out.select(F.col("id").alias(id_col), *keys, F.coalesce("core", F.lit(False)).alias("core"), F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))
