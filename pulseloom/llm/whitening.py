"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Vectors are put on a grid of whole numbers, so the scatter of the distinct ones
is a matrix of integers, summed exactly. Its characteristic polynomial is
computed modulo many primes, one Spark task for some of them each (reduction to
Hessenberg form, then a recurrence), and put together by Chinese remainders.
All its roots are real, so Descartes' rule counts the roots above any point
exactly; bisection isolates each eigenvalue to many more bits than a double
has, whatever its multiplicity. Inverse iteration in fixed-point integers at
that value gives the null space, which is the component. What goes through the
driver grows with the number of dimensions alone.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseloom.llm.work import staged, tidy

#: Grid steps of a unit, and what is added to each step number. SHIFT cancels out of all that is centred.
GRID, SHIFT = 64, 1_000_000
#: Components that are given.
COMPONENTS = 16
#: Step numbers beyond this count as this.
FAR = 1 << 62
#: Bits of the limbs of a step number, and rows of a product of limbs: 2 * (LIMB - 1) + 12 stays within the 53 bits of a double.
LIMB, ROWS = 21, 4096
#: Bits of the parts in which exact sums travel, and their number.
PART, PARTS = 40, 5
#: Significant bits of an eigenvalue; eigenvalues that agree in so many bits share a null space.
ROOT_BITS, SAME_BITS = 110, 70
#: Primes that a task reduces at once (for 64 dimensions; fewer in more).
PRIMES_AT_ONCE = 16


def steps(vector: np.ndarray | None) -> np.ndarray | None:
    """floor(64 * c) of each entry; None for a vector that is null or has null or non-finite entries."""
    if vector is None:
        return None
    x = np.asarray(vector, dtype=np.float64) if len(vector) else np.zeros(0)
    if not np.isfinite(x).all():
        return None
    with np.errstate(over="ignore"):
        return np.clip(np.floor(GRID * x), -float(FAR), float(FAR)).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """The numbers in the least of 2, 4 or 8 bytes each."""
    most = int(np.abs(x).max()) if len(x) else 0
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def unpacked(blobs: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(blobs), dim), np.int64)
    for k, b in enumerate(blobs):
        out[k] = np.frombuffer(b, f"<i{len(b) // dim}")
    return out


def exact_gram(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers: products of limbs in double precision, none of which can round."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), ROWS):
        y, limbs = x[at : at + ROWS], []
        while y.any():
            low = ((y + (1 << LIMB - 1)) & ((1 << LIMB) - 1)) - (1 << LIMB - 1)
            limbs.append(low.astype(np.float64))
            y = (y - low) >> LIMB
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)
    return total


def scatter_sums(fit: DataFrame, dim: int) -> tuple[list[int], np.ndarray]:
    """Sums of each dimension and of all products of two, over ``fit`` (x binary), as Python integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, total = np.zeros((dim, dim), object), np.zeros(dim, object)
        for batch in batches:
            x = unpacked(batch.column("x").to_pylist(), dim)
            gram += exact_gram(x)
            total += ((x >> 31).sum(0).astype(object) << 31) + (x & ((1 << 31) - 1)).sum(0)
        keys, values = [], []
        for i, row in enumerate([*gram, total]):
            for k in range(PARTS):
                part = [int(v) >> PART * k if k == PARTS - 1 else (int(v) >> PART * k) & ((1 << PART) - 1) for v in row]
                if any(part):
                    keys.append(i * PARTS + k), values.append(part)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.list_(pa.int64()))], names=["key", "v"])

    sums = F.array(*[F.sum(F.col("v")[j]) for j in range(dim)])
    out = np.zeros((dim + 1, dim), object)
    for row in fit.select("x").mapInArrow(tidy(run), "key long, v array<long>").groupBy("key").agg(sums.alias("v")).collect():
        out[row.key // PARTS] += np.array([v << PART * (row.key % PARTS) for v in row.v], object)
    return [int(v) for v in out[dim]], out[:dim]


def primes_below(top: int, many: int) -> list[int]:
    """The ``many`` largest primes below ``top`` (at most 2^32)."""

    def prime(n: int) -> bool:
        d, s = n - 1, 0
        while d % 2 == 0:
            d, s = d // 2, s + 1
        for a in (2, 3, 5, 7):  # decides up to 3,215,031,751
            x = pow(a, d, n)
            if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
                return False
        return True

    out, n = [], top - 1 if top % 2 == 0 else top - 2
    while len(out) < many:
        if all(n % q for q in (3, 5, 7, 11, 13, 17, 19, 23)) and prime(n):
            out.append(n)
        n -= 2
    return out


def characteristic_mod(a: np.ndarray, primes: list[int]) -> np.ndarray:
    """Coefficients (constant first) of det(xI - a) modulo each prime below 2^31; ``a`` holds Python integers."""
    count, d = len(primes), len(a)
    p = np.array(primes, np.int64)
    h = np.stack([(a % q).astype(np.int64) for q in primes])
    at, p1, p2 = np.arange(count), p[:, None], p[:, None, None]
    for m in range(1, d - 1):
        below = h[:, m:, m - 1] != 0
        i = below.argmax(1) + m
        rows = h[at, i].copy()
        h[at, i] = h[:, m]
        h[:, m] = rows
        cols = h[at, :, i].copy()
        h[at, :, i] = h[:, :, m]
        h[:, :, m] = cols
        inverse = np.array([pow(int(v), -1, q) if v else 0 for v, q in zip(h[:, m, m - 1], primes, strict=True)], np.int64)
        u = h[:, m + 1 :, m - 1] * inverse[:, None] % p1
        h[:, m + 1 :] = (h[:, m + 1 :] - u[:, :, None] * h[:, m, None, :] % p2) % p2
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1 :] * u[:, None, :] % p2).sum(2)) % p1
    polys = np.zeros((count, d + 1, d + 1), np.int64)
    polys[:, 0, 0] = 1
    for k in range(1, d + 1):
        new = -(h[:, k - 1, k - 1, None] * polys[:, k - 1] % p1)
        new[:, 1:] += polys[:, k - 1, :-1]
        chain, factors = np.ones(count, np.int64), np.zeros((count, k - 1), np.int64)
        for i in range(k - 2, -1, -1):
            chain = chain * h[:, i + 1, i] % p
            factors[:, i] = chain * h[:, i, k - 1] % p
        polys[:, k] = (new - (factors[:, :, None] * polys[:, : k - 1] % p2).sum(1)) % p1
    return polys[:, d]


def characteristic(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Coefficients (constant first) of det(xI - a) of a positive semidefinite matrix of integers.

    They are sums of products of eigenvalues, all below (1 + trace / d)^d; the
    primes' product is above twice that, and one prime more has to agree.
    """
    d, trace = len(a), int(a.trace())
    bits = d * (2 + trace // d).bit_length() + 2
    primes = primes_below(1 << 31, bits // 30 + 2)
    group = max(1, PRIMES_AT_ONCE * 4096 // max(1, d * d))
    groups = [primes[i : i + group] for i in range(0, len(primes), group)]
    shared = spark.sparkContext.broadcast((a, groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, groups = shared.value
        for batch in batches:
            for k in batch.column("id").to_pylist():
                rest = characteristic_mod(a, groups[k])
                yield pa.RecordBatch.from_arrays([pa.array(groups[k], pa.int64()), pa.array(rest.tolist(), pa.list_(pa.int64()))], names=["prime", "rest"])

    rests = {r.prime: r.rest for r in spark.range(0, len(groups), 1, min(len(groups), 4096)).mapInArrow(tidy(run), "prime long, rest array<long>").collect()}
    used, spare = primes[:-1], primes[-1]
    product = math.prod(used)
    lifts = [(product // q) * pow(product // q, -1, q) for q in used]
    out = []
    for k in range(d + 1):
        c = sum(rests[q][k] * lift for q, lift in zip(used, lifts, strict=True)) % product
        c -= product if c > product // 2 else 0
        if (c - rests[spare][k]) % spare:
            raise ArithmeticError("the primes don't determine the characteristic polynomial")
        out.append(c)
    return out


def roots_above(poly: list[int], t: int, scale: int) -> int:
    """How many roots (with multiplicity) of a polynomial with real roots alone lie above t / 2^scale: its sign changes about that point."""
    r = len(poly) - 1
    c = [v << scale * (r - k) for k, v in enumerate(poly)]
    for i in range(r):
        for j in range(r - 1, i - 1, -1):
            c[j] += t * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], t: int, scale: int) -> int:
    value, r = 0, len(poly) - 1
    for k in range(r, -1, -1):
        value = value * t + (poly[k] << scale * (r - k))
    return (value > 0) - (value < 0)


def root(poly: list[int], k: int, most: int) -> tuple[int, int]:
    """(t, scale): the k-th largest root lies within half a unit of t / 2^scale; 0 < root <= most. poly has positive roots alone."""
    scale, lo, hi, n_lo, n_hi = 0, 0, most, len(poly) - 1, 0
    while True:
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if n_lo - n_hi == 1:  # isolated: the sign tells the side
                s = _sign(poly, mid, scale)
                above = n_lo if s and (s > 0) == (n_lo % 2 == 0) else n_hi
            else:
                above = roots_above(poly, mid, scale)
            lo, hi, n_lo, n_hi = (mid, hi, above, n_hi) if above >= k else (lo, mid, n_lo, above)
        more = ROOT_BITS - max(lo, 1).bit_length()
        if more <= 0 or scale > 64 * ROOT_BITS:
            return 2 * lo + 1, scale + 1
        more = more if lo else ROOT_BITS
        scale, lo, hi = scale + more, lo << more, hi << more


def null_space(a: np.ndarray, t: int, scale: int, many: int) -> list[list[int]]:
    """``many`` orthonormal vectors, in units of 2^-bits (bits = 2 * ROOT_BITS), of the null space of a - t / 2^scale, by inverse iteration in integers."""
    d, bits = len(a), 2 * ROOT_BITS
    point = scale + bits
    u = np.array([[int(v) << point for v in row] for row in a], object)
    for i in range(d):
        u[i, i] -= t << bits
    order, lower = [], []
    for k in range(d):
        i = k + max(range(d - k), key=lambda r: abs(u[k + r, k]))
        order.append(i)
        if i != k:
            u[[k, i]] = u[[i, k]]
        if not u[k, k]:
            u[k, k] = 1
        f = (u[k + 1 :, k] << point) // u[k, k] if k + 1 < d else np.zeros(0, object)
        lower.append(f)
        if k + 1 < d:
            u[k + 1 :, k + 1 :] -= (f[:, None] * u[k, k + 1 :]) >> point

    def solve(b: np.ndarray) -> np.ndarray:
        b = b << point
        for k in range(d):
            b[[k, order[k]]] = b[[order[k], k]]
            b[k + 1 :] -= (lower[k] * b[k]) >> point
        for k in range(d - 1, -1, -1):
            b[k] = (b[k] << point) // u[k, k]
            b[:k] -= (u[:k, k] * b[k]) >> point
        return b

    rng = random.Random(d)
    found = [np.array([rng.randrange(-(1 << 40), 1 << 40) for _ in range(d)], object) for _ in range(many)]
    for _ in range(4):
        done: list[np.ndarray] = []
        for v in found:
            v = solve(v)
            v = (v << 2 * bits) // max(1, max(abs(x) for x in v))
            for _ in range(2):
                for w in done:
                    v = v - ((w * int((v * w).sum())) >> 2 * bits)
            v = (v << bits) // max(1, math.isqrt(int((v * v).sum())))
            done.append(v)
        found = done
    return [[int(x) for x in (v if v[max(range(d), key=lambda i: abs(v[i]))] > 0 else -v)] for v in found]


def components(spark: SparkSession, a: np.ndarray, many: int) -> list[tuple[int, int, list[float]]]:
    """(t, scale, unit vector) of the ``many`` largest eigenvalues t / 2^scale above 0 of a positive semidefinite matrix of integers, falling."""
    poly, trace = characteristic(spark, a), int(a.trace())
    while len(poly) > 1 and not poly[0]:
        poly = poly[1:]
    many = min(many, len(poly) - 1)
    if not many:
        return []
    shared = spark.sparkContext.broadcast((a, poly))

    def isolate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                t, scale = root(shared.value[1], k + 1, trace + 1)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([str(t)]), pa.array([scale])], names=["k", "t", "scale"])

    roots = sorted((r.k, int(r.t), r.scale) for r in spark.range(0, many, 1, many).mapInArrow(isolate, "k long, t string, scale long").collect())
    groups: list[list[tuple[int, int, int]]] = []
    for k, t, scale in roots:
        before = groups[-1][0] if groups else None
        if before:
            high = max(scale, before[2])
            x, y = t << high - scale, before[1] << high - before[2]
            if (y - x) << SAME_BITS <= y:
                groups[-1].append((k, t, scale))
                continue
        groups.append([(k, t, scale)])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column("id").to_pylist():
                (k, t, scale), n = groups[g][0], len(groups[g])
                for i, v in enumerate(null_space(shared.value[0], t, scale, n)):
                    size = math.isqrt(sum(x * x for x in v))
                    yield pa.RecordBatch.from_arrays([pa.array([k + i]), pa.array([[x / size for x in v]], pa.list_(pa.float64()))], names=["k", "v"])

    found = {r.k: r.v for r in spark.range(0, len(groups), 1, len(groups)).mapInArrow(vectors, "k long, v array<double>").collect()}
    return [(t, scale, found[k]) for k, t, scale in roots]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: 64-bit integers where they suffice, else Python's."""
    most = n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, sums), default=0)
    return x * n - np.array(sums, np.int64) if most < FAR else x.astype(object) * n - np.array(sums, object)


def deviations(z: np.ndarray) -> list[int | None]:
    """Sums of squares of each row; None beyond 64 bits."""
    if z.dtype != object and z.shape[1] * float(np.abs(z).max(initial=0)) ** 2 < FAR:
        return (z * z).sum(1).tolist()
    found = [sum(int(v) ** 2 for v in row) for row in z]
    return [v if v < 1 << 63 else None for v in found]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, many: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row of ``vectors`` (vec_id, embedding, any others) and component.

    Rows whose vector is null or holds null or non-finite entries are left out.
    The fit is over distinct grid vectors of the commonest length (of equally
    common ones the largest); rows of other lengths have no deviation and no
    whitened value. Components of eigenvalue 0 have no whitened value either, and
    aren't part of identity_error, which is null if there are no others; where
    all vectors are equal, explained is null. A deviation beyond 64 bits is null.
    Grid numbers beyond 2^62 count as 2^62. Repeated rows, and rows without a
    vec_id, are rows of the result like others. An empty table, or one of empty
    vectors, gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for v in batch.column("embedding").to_numpy(zero_copy_only=False) if (x := steps(v)) is not None and len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in found], pa.int32()), pa.array([packed(x) for x in found], pa.binary())], names=["dim", "x"])

    distinct = staged(rows.select("embedding").mapInArrow(tidy(grid), "dim int, x binary").distinct(), "grid_vectors")
    commonest = distinct.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if commonest is None:
        return spark.createDataFrame([], SCHEMA)
    dim, n = commonest["dim"], commonest["count"]
    fit = distinct.where(F.col("dim") == dim)
    sums, gram = scatter_sums(fit, dim)
    # centred before multiplying: n times the sum of (x - S / n)(x - S / n)', and whole
    scatter = gram * n - np.outer(np.array(sums, object), np.array(sums, object))
    common = math.gcd(*map(int, scatter.ravel())) or 1
    scatter = np.array([[int(v) // common for v in row] for row in scatter], object)
    found, trace = components(spark, scatter, min(many, dim)), int(scatter.trace())
    wide = 256
    # the square root of the eigenvalue of n^2 V
    roots = [math.isqrt((t * common << 2 * wide) >> scale) / (1 << wide) for t, scale, _ in found]
    explained = [t / (trace << scale) for t, scale, _ in found] + [0.0 if trace else None] * (min(many, dim) - len(found))
    weights = np.array([np.array(v) / s for (_, _, v), s in zip(found, roots, strict=True)]).reshape(len(found), dim).T
    shared = spark.sparkContext.broadcast((sums, weights))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weights = shared.value
        k = weights.shape[1]
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = centred(unpacked(batch.column("x").to_pylist(), dim), n, sums).astype(np.float64) @ weights
            total += y.sum(0)
            square += y.T @ y
        values = np.concatenate([total, square.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["k", "v"])

    error = None
    if found:
        k = len(found)
        added = np.zeros(k + k * k)
        for row in fit.select("x").mapInArrow(products, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            added[row.k] = row.v / n
        error = float(np.abs(added[k:].reshape(k, k) - np.outer(added[:k], added[:k]) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weights = shared.value
        per, k = len(explained), weights.shape[1]
        for batch in batches:
            found = [steps(v) for v in batch.column("embedding").to_numpy(zero_copy_only=False)]
            keep = [i for i, x in enumerate(found) if x is not None]
            fits = [i for i, x in enumerate(keep) if len(found[x]) == dim]
            z = centred(np.array([found[keep[i]] for i in fits], np.int64).reshape(len(fits), dim), n, sums)
            values, known = np.zeros((len(keep), per)), np.zeros((len(keep), per), bool)
            values[fits, :k], known[fits, :k] = z.astype(np.float64) @ weights, True
            deviation: list[int | None] = [None] * len(keep)
            for i, v in zip(fits, deviations(z), strict=True):
                deviation[i] = v
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.array(keep, np.int64), per)))
            columns = [
                ids,
                pa.array(np.tile(np.arange(1, per + 1, dtype=np.int32), len(keep))),
                pa.array(np.full(len(ids), n)),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(keep)), per))),
                pa.array(values.ravel(), mask=~known.ravel()),
                pa.array(explained * len(keep), pa.float64()),
                pa.array([error] * len(ids), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(tidy(project), SCHEMA)
