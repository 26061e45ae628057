"""Approximate vector search by a stored index of random hyperplanes.

Each of several tables gives a vector a code: the sides of some random planes it
lies on. Postings (table, code, split, vec_id) are stored bucketed and sorted by
the code; a code that holds many vectors is dealt over splits. A query looks up
its own code in each table and those that are the likeliest to hold what lies
near it (the planes it is closest to are crossed first). Postings with their
vectors and the codes that queries look up meet in parts of the codes: a code is
a small matrix product there, and a part gives the best of each query only, so
no pairs are shuffled.
"""

from __future__ import annotations

import functools
import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Vectors of a code that are aimed at when the number of planes is chosen, and of a split of a large code.
PER_CODE, PER_SPLIT = 8, 4096
#: Postings of a part that are aimed at, similarities that are held at a time, and pairs of which the best are then kept.
PER_PART, PER_BLOCK, PER_CUT = 131_072, 1 << 21, 1 << 20


def enough(bits: int) -> int:
    """Codes to look up in a table of so many planes: about 1.44 times as many for each plane more."""
    return round(10 * 2 ** ((bits - 6) / 1.9))


def most_flips(bits: int) -> int:
    """Planes that a query crosses at most: with many planes, codes four planes away hold more than some that are three away."""
    return 3 if bits < 15 else 4


def planes(tables: int, bits: int, dim: int, seed: int) -> np.ndarray:
    """(tables, bits, dim) normal vectors of random planes."""
    return np.random.default_rng([seed, tables, bits, dim]).normal(size=(tables, bits, dim))


def projections(x: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """(rows, tables, bits) signed distances of unit vectors from the planes."""
    tables, bits, dim = normals.shape
    return (x @ normals.reshape(-1, dim).T).reshape(len(x), tables, bits)


def codes(p: np.ndarray) -> np.ndarray:
    """(rows, tables) codes of signed distances."""
    return ((p > 0) * (1 << np.arange(p.shape[2], dtype=np.int64))).sum(2)


@functools.lru_cache(maxsize=4)
def _crossings(bits: int, flips: int) -> tuple[np.ndarray, np.ndarray]:
    """Every set of up to ``flips`` planes: a row of ones and zeros, and the bits it turns."""
    sets = [s for n in range(min(flips, bits) + 1) for s in itertools.combinations(range(bits), n)]
    crossed = np.zeros((len(sets), bits))
    for i, s in enumerate(sets):
        crossed[i, list(s)] = 1
    return crossed, crossed.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def probes(p: np.ndarray, many: int, flips: int = 3) -> np.ndarray:
    """(tables, many) codes that a query with signed distances p (tables, bits) looks up: nearest by the planes it must cross."""
    crossed, masks = _crossings(p.shape[1], flips)
    cost = (p * p) @ crossed.T  # of each set in each table
    best = np.argpartition(cost, many - 1, axis=1)[:, :many] if many < len(masks) else np.tile(np.arange(len(masks)), (len(p), 1))
    best = np.take_along_axis(best, np.argsort(np.take_along_axis(cost, best, 1), axis=1, kind="stable"), 1)
    return codes(p[None])[0][:, None] ^ masks[best]


def _units(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit vectors of the rows of ``dim`` finite components that aren't all zero."""
    found = batch.column("embedding").to_numpy(zero_copy_only=False)
    at = [i for i, v in enumerate(found) if v is not None and len(v) == dim and np.isfinite(v).all() and np.any(v)]
    x = np.array([found[i] for i in at], float).reshape(len(at), dim)
    return np.array(at, np.int64), x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, and where each begins and ends."""
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return sorted_keys[at], at, np.append(at[1:], len(sorted_keys)).astype(np.int64)


class _Best:
    """The best vectors of each query among pairs that come bit by bit; a pair may come more than once."""

    def __init__(self, queries: int, ids: np.ndarray, lengths: np.ndarray, k: int, threshold: float):
        self.ids, self.same = np.unique(ids, return_inverse=True)
        self.lengths, self.k = lengths, k
        self.floor = np.full(queries, threshold - 1e-6)
        self.held, self.new, self.count = [], [], 0

    def add(self, q: np.ndarray, v: np.ndarray, s: np.ndarray) -> None:
        self.new.append((q, v, s))
        self.count += len(q)
        if self.count >= PER_CUT:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keeps all that may round to the k-th best; of vectors that are as far and as long as each other, the k smallest ids."""
        q, v, s = (np.concatenate(x) for x in zip(*self.held, *self.new, strict=True)) if self.held or self.new else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        first = np.unique(q * len(self.ids) + self.same[v], return_index=True)[1]
        q, v, s = q[first], v[first], s[first]
        order = np.lexsort((self.same[v], self.lengths[v].round(9), -s.round(9), q))
        q, v, s = q[order], v[order], s[order]
        near, length = s.round(9), self.lengths[v].round(9)
        alike = np.concatenate([[False], (q[1:] == q[:-1]) & (near[1:] == near[:-1]) & (length[1:] == length[:-1])]) if len(q) else np.zeros(0, bool)
        begins = np.maximum.accumulate(np.where(alike, 0, np.arange(len(q))))
        few = np.arange(len(q)) - begins < self.k
        q, v, s = q[few], v[few], s[few]
        which, start, end = _runs(q)
        full = end - start >= self.k
        self.floor[which[full]] = np.maximum(self.floor[which[full]], s[start[full] + self.k - 1] - 2e-6)
        good = s >= self.floor[q]
        self.held, self.new, self.count = [(q[good], v[good], s[good])], [], 0
        return self.held[0]


class HyperplaneIndex:
    """Stored postings and vectors below ``location``; opened again by the same location and name of its tables."""

    def __init__(self, spark: SparkSession, location: str, tables: int, bits: int, dim: int, seed: int = 7, buckets: int = 16):
        self.spark, self.location = spark, location.rstrip("/")
        self.tables, self.bits, self.dim, self.seed, self.buckets = tables, bits, dim, seed, buckets
        self.normals = planes(tables, bits, dim, seed)
        self.name = f"hyperplanes_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (bucket BIGINT, split INT, vec_id BIGINT) USING parquet CLUSTERED BY (bucket) SORTED BY (bucket) INTO {buckets} BUCKETS LOCATION '{self.location}/postings'")
        spark.sql(f"CREATE TABLE {self.name}_vectors (vec_id BIGINT, embedding ARRAY<FLOAT>) USING parquet CLUSTERED BY (vec_id) SORTED BY (vec_id) INTO {buckets} BUCKETS LOCATION '{self.location}/vectors'")

    @classmethod
    def build(cls, vectors: DataFrame, location: str, tables: int = 16, bits: int | None = None, seed: int = 7, buckets: int = 16) -> HyperplaneIndex:
        """An index of ``vectors`` (vec_id, embedding) of the commonest length; ``bits`` follows from their number unless given."""
        sizes = vectors.where("vec_id IS NOT NULL").groupBy(F.size("embedding").alias("dim")).count().where("dim > 0").orderBy(F.desc("count"), "dim").first()
        dim, n = (sizes["dim"], sizes["count"]) if sizes else (1, 0)
        bits = bits or min(24, max(4, round(math.log2(max(1, n / PER_CODE)))))
        index = cls(vectors.sparkSession, location, tables, bits, dim, seed, buckets)
        index.add(vectors)
        return index

    def _postings(self, vectors: DataFrame) -> DataFrame:
        shared = self.spark.sparkContext.broadcast(self.normals)
        tables, bits, dim = self.tables, self.bits, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, x = _units(batch, dim)
                found = codes(projections(x, shared.value)) + (np.arange(tables, dtype=np.int64) << bits)
                ids = batch.column("vec_id").take(pa.array(np.repeat(at, tables)))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), ids], names=["bucket", "vec_id"])

        return vectors.mapInArrow(run, "bucket long, vec_id long")

    def add(self, vectors: DataFrame) -> None:
        """Append vectors; rows without an id, and vectors that are null, zero, not finite or of another length, aren't found."""
        rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
        postings = self._postings(rows)
        # codes with a thousandth of the batch and more, at most a thousand a table, are split; a search looks the splits up
        least = max(PER_SPLIT, rows.count() // 1000)
        size = postings.groupBy("bucket").count().where(F.col("count") > least).select("bucket", F.ceil(F.col("count") / PER_SPLIT).cast("int").alias("splits"))
        dealt = postings.join(F.broadcast(size), "bucket", "left")
        dealt = dealt.select("bucket", F.pmod(F.xxhash64("vec_id"), F.coalesce("splits", F.lit(1))).cast("int").alias("split"), "vec_id")
        self._append(dealt, self.name, "bucket")
        self._append(rows, f"{self.name}_vectors", "vec_id")

    def _append(self, rows: DataFrame, name: str, key: str) -> None:
        rows.repartition(self.buckets, key).write.mode("append").format("parquet").bucketBy(self.buckets, key).sortBy(key).saveAsTable(name)
        self.spark.catalog.refreshTable(name)

    def _looked(self, queries: DataFrame, many: int, parts: int) -> DataFrame:
        """(part, split, query_id, q, codes): what codes a query (vec_id, embedding) looks up in each of ``parts`` of all codes."""
        shared = self.spark.sparkContext.broadcast(self.normals)
        tables, bits, dim, flips = self.tables, self.bits, self.dim, most_flips(self.bits)
        # codes that were split: at most a thousand a table of each batch that was added
        large = sorted(map(tuple, self.spark.table(self.name).where("split > 0").groupBy("bucket").agg(F.max("split")).collect()))
        hot = self.spark.sparkContext.broadcast(np.array(large, np.int64).reshape(-1, 2))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, last = hot.value.T
            for batch in batches:
                every, units = _units(batch, dim)
                for begin in range(0, len(every), 64):
                    at, x = every[begin : begin + 64], units[begin : begin + 64]
                    found = np.stack([probes(p, many, flips) for p in projections(x, shared.value)]) + (np.arange(tables, dtype=np.int64)[:, None] << bits)
                    row, code = np.repeat(np.arange(len(at)), found[0].size), found.ravel()
                    split = np.zeros(len(code), np.int64)
                    if len(known):
                        place = np.searchsorted(known, code).clip(max=len(known) - 1)
                        more = np.where(known[place] == code, last[place], 0)
                        row, code, split = np.repeat(row, more + 1), np.repeat(code, more + 1), np.arange((more + 1).sum()) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
                    part = code % parts
                    order = np.lexsort((split, part, row))
                    row, code, split, part = row[order], code[order], split[order], part[order]
                    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1]) | (split[1:] != split[:-1])]))
                    source = pa.array(at[row[new]])
                    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(code)).astype(np.int32)), pa.array(code))
                    yield pa.RecordBatch.from_arrays([pa.array(part[new]), pa.array(split[new].astype(np.int32)), batch.column("vec_id").take(source), batch.column("embedding").take(source), lists], names=["part", "split", "query_id", "q", "codes"])

        kind = queries.schema["embedding"].dataType.simpleString()
        rows = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL")
        return rows.mapInArrow(run, f"part long, split int, query_id long, q {kind}, codes array<long>")

    def candidates(self, queries: DataFrame, many: int) -> DataFrame:
        """(query_id, vec_id): what lies in the ``many`` likeliest codes of each query in each table."""
        looked = self._looked(queries, many, 1).select("query_id", "split", F.explode("codes").alias("bucket"))
        return looked.join(self.spark.table(self.name), ["bucket", "split"]).select("query_id", "vec_id").distinct()

    def search(self, queries: DataFrame, k: int = 10, threshold: float = 0.2, many: int | None = None) -> DataFrame:
        """The ``k`` most similar of the candidates of each query, at ``threshold`` or above; ties by distance, then id.

        ``many`` codes are looked up in each table: more find more, and cost more.
        """
        vectors = self.spark.table(f"{self.name}_vectors")
        parts = -(-vectors.count() * self.tables // PER_PART) | 1  # odd, so that all planes of a code count
        looked = self._looked(queries, many or enough(self.bits), parts)
        held = self.spark.table(self.name).join(vectors.where(F.size("embedding") == self.dim), "vec_id").select(F.pmod("bucket", F.lit(parts)).alias("part"), "split", "bucket", "vec_id", "embedding")

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
            if len(left) and len(right):
                q, v = _matrix(left.column("q"), len(left)), _matrix(right.column("embedding"), len(right))
                nq, nv = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
                uq, uv = q / nq[:, None], v / nv[:, None]
                lists = left.column("codes").combine_chunks()
                code, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(left)), lists.value_lengths().to_numpy())
                order = np.argsort(code, kind="stable")
                code, row = code[order], row[order]
                place = np.argsort(bucket := right.column("bucket").to_numpy(), kind="stable")
                kept = _Best(len(left), right.column("vec_id").to_numpy(), nv, k, threshold)
                (asked, a, b), (there, c, d) = _runs(code), _runs(bucket[place])
                _, i, j = np.intersect1d(asked, there, assume_unique=True, return_indices=True)
                for a0, b0, c0, d0 in zip(a[i].tolist(), b[i].tolist(), c[j].tolist(), d[j].tolist(), strict=True):
                    mine = place[c0:d0]
                    some = uv[mine].T
                    step = max(1, PER_BLOCK // (d0 - c0))
                    for begin in range(a0, b0, step):
                        who = row[begin : min(b0, begin + step)]
                        s = uq[who] @ some
                        x, y = np.nonzero(s >= kept.floor[who, None])
                        if len(x):
                            kept.add(who[x], mine[y], s[x, y])
                x, y, _ = kept.cut()
                found = [np.zeros(len(x)), np.zeros(len(x))]
                for begin in range(0, len(x), 65536):
                    at = slice(begin, begin + 65536)
                    found[0][at] = (q[x[at]] * v[y[at]]).sum(1) / (nq[x[at]] * nv[y[at]])
                    found[1][at] = np.sqrt(((q[x[at]] - v[y[at]]) ** 2).sum(1))
                out = [left.column("query_id").to_numpy()[x], right.column("vec_id").to_numpy()[y], *found]
            return pa.table(dict(zip(("query_id", "vec_id", "similarity", "distance"), map(pa.array, out), strict=True)))

        keys = ["part", "split"]
        found = looked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, similarity double, distance double")
        scored = found.groupBy("query_id", "vec_id").agg(F.round(F.max("similarity"), 6).alias("similarity"), F.round(F.min("distance"), 6).alias("distance"))
        w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "distance", "vec_id")
        return scored.where(F.col("similarity") >= threshold).withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)
