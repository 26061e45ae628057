"""Near-duplicate vectors by an exact metric range join.

Unit vectors within an angle are within a distance, so the join is over a metric.
Pivots partition the vectors: each belongs to the cell of its nearest pivot. By
the triangle inequality a vector can be within reach of a vector of another
cell only if its distance to that cell's pivot is at most twice the reach above
the distance to its own; it is copied to those cells, to the earlier one of two
cells only. Cells join independently, large ones in pairs of packed blocks, and
give counts and a spanning set of links, never all pairs.

In many dimensions vectors without clusters are near all boundaries, and more
pivots mean more copies. How many cells a vector goes to is measured on a sample;
as many pivots are used as keep the copies within a bound. Few pivots always do:
a pair is compared in one cell at most, so cells never add to the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pulseloom.llm.components import components
from pulseloom.llm.work import staged, tidy

#: Vectors per pivot that are aimed at, the fewest and the most pivots to begin with (their vectors go to all tasks).
PER_CELL, FEWEST_PIVOTS, MOST_PIVOTS = 4_096, 8, 512
#: Cells that a vector may go to on average; pivots are halved until it does.
MOST_COPIES = 4.5
#: Vectors from which pivots are chosen, per pivot, and vectors on which they are measured.
POOL, MEASURED = 8, 1_024
#: Bytes of the vectors of a block, and the least number of blocks that a large cell is cut into.
BLOCK_BYTES, LEAST_BLOCKS = 16 << 20, 4
#: Cells of fewer vectors are one block.
SMALL = 1_024
#: Pairs of which the products are held at once.
PAIRS_AT_ONCE = 1 << 23


def _vector(v) -> np.ndarray | None:
    """The vector as an array; None if it can't link: null, empty or zero, or with null or non-finite components."""
    if v is None or not len(v):
        return None
    x = np.asarray(v) if isinstance(v, np.ndarray) else np.array([np.nan if c is None else c for c in v])
    return x if x.dtype.kind == "f" and np.isfinite(x).all() and x.any() else None


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def link_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of rows of x and y (units) with a cosine of at least ``threshold`` in double precision.

    Products in single precision decide where they can't be wrong; the few close
    to the threshold are computed in double precision.
    """
    slack = 1e-6 * (4 + x.shape[1])  # well above the rounding of a sum of so many products
    rough = x.astype(np.float32) @ y.astype(np.float32).T
    a, b = np.nonzero(rough >= threshold - slack)
    close = np.flatnonzero(rough[a, b] < threshold + slack)
    keep = np.ones(len(a), bool)
    for at in range(0, len(close), 100_000):
        k = close[at : at + 100_000]
        keep[k] = np.einsum("ij,ij->i", x[a[k]], y[b[k]]) >= threshold
    return a[keep], b[keep]


def spanning(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The smallest place that each place reaches by the links and those that ``root`` stands for."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def cells_of(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each unit vector, and to which cells it goes: its own and earlier ones within reach."""
    d2 = np.maximum(0, 2 - 2 * np.clip(x @ pivots.T, -1, 1))
    d, home = np.sqrt(d2), d2.argmin(1)
    near = d <= d.min(1, keepdims=True) + 2 * reach + 1e-9
    # in Euclidean space the plane between two pivots is farther than the triangle inequality alone tells
    apart = np.sqrt(np.maximum(0, 2 - 2 * np.clip(pivots @ pivots.T, -1, 1)))[home]
    near &= d2 - d2.min(1, keepdims=True) <= 2 * apart * (reach + 1e-9)
    near &= np.arange(len(pivots))[None, :] <= home[:, None]
    near[np.arange(len(x)), home] = True
    return home, near


def copies(sample: np.ndarray, pivots: np.ndarray, reach: float) -> float:
    """To how many cells a vector of the sample (units) goes on average."""
    return float(cells_of(sample[:MEASURED], pivots, reach)[1].sum(1).mean())


def choose_pivots(sample: np.ndarray, total: int, reach: float) -> np.ndarray:
    """As many pivots as put a vector of ``sample`` (units) into at most MOST_COPIES cells on average."""
    n = min(MOST_PIVOTS, max(FEWEST_PIVOTS, total // PER_CELL))
    while True:
        pivots = _spread(sample[: POOL * n], n)
        if len(pivots) <= 2 or copies(sample, pivots, reach) <= MOST_COPIES:
            return pivots
        n = len(pivots) // 2


def _spread(pool: np.ndarray, n: int) -> np.ndarray:
    """n vectors of the pool that are far from each other: each next one is the farthest from those before."""
    chosen, best = [0], np.full(len(pool), -np.inf)
    while len(chosen) < min(n, len(pool)):
        best = np.maximum(best, pool @ pool[chosen[-1]])
        k = int(best.argmin())
        if best[k] >= 1 - 1e-9:
            break
        chosen.append(k)
    return pool[chosen]


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding, any others).

    Two rows are linked if the cosine of their vectors, in double precision, is
    at least ``threshold``. Equal vectors are compared as one, with their number.
    Vectors that can't link (null, empty, zero, or with null or non-finite
    components) have no links and are their own component, and so have vectors
    of different lengths with each other. vec_id names a row: repeated rows count
    as links of each other. Rows without a vec_id are linked with nothing, are
    kept, and their component_id is null. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind, type_name = (np.float32, "float") if single else (np.float64, "double")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{type_name}>").alias("embedding"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            found = [None if i is None else _vector(v) for i, v in zip(ids.to_pylist(), batch.column("embedding").to_numpy(zero_copy_only=False), strict=True)]
            blobs = [None if x is None else x.astype(kind).tobytes() for x in found]
            same = [None if x is None else xxhash.xxh3_128_digest(x) for x in blobs]
            yield pa.RecordBatch.from_arrays([ids, pa.array(same, pa.binary()), pa.array(blobs, pa.binary())], names=["vec_id", "same", "vector"])

    rows = staged(rows.mapInArrow(tidy(digests), "vec_id long, same binary, vector binary"), "vectors")
    classes = rows.where("same IS NOT NULL").groupBy("same").agg(F.min(F.struct("vec_id", "vector")).alias("first"), F.count(F.lit(1)).alias("weight"))
    classes = staged(classes.select("same", F.col("first.vec_id").alias("rep"), F.col("first.vector").alias("vector"), "weight"), "classes")
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    sizes = classes.agg(F.count(F.lit(1)).alias("n"), F.mode(F.length("vector"), True).alias("width")).first()
    if sizes.n:
        # at most MOST_PIVOTS * POOL vectors of the commonest length
        pool = max(MEASURED, POOL * min(MOST_PIVOTS, sizes.n // PER_CELL))
        chosen = classes.where(F.length("vector") == sizes.width).orderBy(F.xxhash64("rep"), "rep").limit(pool).select("vector").collect()
        pivots = choose_pivots(units(np.frombuffer(b"".join(r.vector for r in chosen), kind).reshape(len(chosen), -1)), sizes.n, reach)
    else:
        pivots = np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            blobs = batch.column("vector").to_numpy(zero_copy_only=False)
            widths = np.array([len(b) for b in blobs], np.int64)
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                if len(pivots) > 1 and width == pivots.shape[1] * np.dtype(kind).itemsize:
                    home, near = cells_of(units(np.frombuffer(b"".join(blobs[at]), kind).reshape(len(at), -1)), pivots, reach)
                    i, cell = np.nonzero(near)
                else:
                    i, cell, home = np.arange(len(at)), np.zeros(len(at), int), np.zeros(len(at), int)
                out = batch.take(pa.array(at[i]))
                columns = [pa.array(np.full(len(i), width, np.int32)), pa.array(cell.astype(np.int32)), pa.array(cell == home[i])]
                yield pa.RecordBatch.from_arrays([*columns, *out.columns], names=["width", "cell", "home", *out.schema.names])

    place_schema = "width int, cell int, home boolean, rep long, weight long"
    # vectors are placed twice, which is cheaper than to write their copies down: for the sizes of cells, and to be packed
    counted = classes.select("rep", "weight", "vector").mapInArrow(place, f"{place_schema}, vector binary").groupBy("width", "cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests"))

    def in_blocks(c: str, least: Column) -> Column:
        """A cell's rows go into blocks of a bounded size, some blocks at least, so that many tasks share a large cell."""
        large = F.greatest(F.ceil(F.col(c) * F.col("width") / F.lit(BLOCK_BYTES)), least)
        return F.when(F.col(c) == 0, 0).when(F.col(c) < SMALL, 1).otherwise(large).cast("int").alias(c)

    many = F.lit(LEAST_BLOCKS)
    counted = staged(counted.select("width", "cell", in_blocks("homes", F.when(F.col("guests") == 0, many).otherwise(1)), in_blocks("guests", many)), "sizes")

    def pack(table: pa.Table) -> pa.Table:
        one = {c: [table.column(c)[0].as_py()] for c in ("width", "cell", "homes", "guests", "home", "block")}
        one |= {"reps": [table.column("rep").to_numpy().astype("<i8").tobytes()], "weights": [table.column("weight").to_numpy().astype("<i8").tobytes()], "vectors": [b"".join(table.column("vector").to_pylist())]}
        return pa.Table.from_pydict(one, schema=pa.schema([(c, pa.int32()) for c in ("width", "cell", "homes", "guests")] + [("home", pa.bool_()), ("block", pa.int32())] + [(c, pa.binary()) for c in ("reps", "weights", "vectors")]))

    placed = classes.select("rep", "weight", "vector").mapInArrow(place, f"{place_schema}, vector binary").join(counted, ["width", "cell"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int"))
    packed = placed.groupBy("width", "cell", "homes", "guests", "home", "block").applyInArrow(pack, "width int, cell int, homes int, guests int, home boolean, block int, reps binary, weights binary, vectors binary")
    packed = staged(packed, "blocks")
    # a home block meets every home block (i <= j) and every guest block (j = -1 - guest block); a guest block meets every home block
    own, upto = F.col("block"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    no_jobs = F.array().cast("array<struct<i:int,j:int>>")
    with_homes = F.transform(upto("homes"), lambda b: F.struct(F.least(b, own).alias("i"), F.greatest(b, own).alias("j")))
    with_guests = F.when(F.col("guests") > 0, F.transform(upto("guests"), lambda b: F.struct(own.alias("i"), (-1 - b).cast("int").alias("j")))).otherwise(no_jobs)
    as_guest = F.when(F.col("homes") > 0, F.transform(upto("homes"), lambda b: F.struct(b.alias("i"), (-1 - own).cast("int").alias("j")))).otherwise(no_jobs)
    jobs = packed.withColumn("at", F.explode(F.when(F.col("home"), F.concat(with_homes, with_guests)).otherwise(as_guest))).select("width", "cell", "at.i", "at.j", "home", "block", "reps", "weights", "vectors")

    def join(table: pa.Table) -> pa.Table:
        blocks = sorted(table.to_pylist(), key=lambda r: (not r["home"], r["block"]))  # the left one first
        read = lambda r: (np.frombuffer(r["reps"], "<i8"), np.frombuffer(r["weights"], "<i8"), units(np.frombuffer(r["vectors"], kind).reshape(-1, r["width"] // np.dtype(kind).itemsize)))
        rep, weight, x = read(blocks[0])
        other, y = len(blocks) > 1, x
        if other:
            more, heavy, y = read(blocks[1])
            rep, weight = np.concatenate([rep, more]), np.concatenate([weight, heavy])
        elif table.column("i")[0].as_py() != table.column("j")[0].as_py():  # the other block has no rows
            return pa.Table.from_pydict({"rep": [], "links": [], "root": []}, schema=result)
        n, shift = len(rep), len(x) if other else 0
        order = np.argsort(rep, kind="stable")
        where = np.empty(n, np.int64)
        where[order] = np.arange(n)
        links, reached = np.zeros(n), np.arange(n)
        step = max(1, PAIRS_AT_ONCE // len(y))
        for at in range(0, len(x), step):
            a, b = link_pairs(x[at : at + step], y if other else y[at:], threshold)
            a, b = a + at, b + (shift if other else at)
            if not other:
                a, b = a[a < b], b[a < b]
            links += np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
            reached = spanning(where[a], where[b], reached)
        some = np.flatnonzero(links)
        return pa.Table.from_pydict({"rep": rep[some], "links": links[some].astype(np.int64), "root": rep[order][reached][where][some]}, schema=result)

    result = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    found = staged(jobs.groupBy("width", "cell", "i", "j").applyInArrow(join, "rep long, links long, root long"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    known = classes.select("same", "rep", "weight").join(links, "rep", "left").join(named, "rep", "left")
    known = known.select("same", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", "same").join(staged(known, "known"), "same", "left")
    component = F.coalesce("component", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(True))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
