"""Near-duplicate documents by SetSketch registers, bands, likelihood, and full sets.

A document's word shingles become a sketch of registers: every shingle sends a
Poisson stream of points to registers at random, a register keeps its first
point, truncated to an exponential scale (merging two sketches is a maximum).
Documents with equal sets are one class. Classes that share a band of registers
are tied to the first and last class of the band; pairs that the joint
likelihood of both sketches rules out are dropped. Where a band still falls into
several parts, all pairs of its classes that aren't tied yet are judged as well,
in blocks. What is tied in the end is a family. Families are searched in full,
in blocks, with whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pulseloom.llm.components import components
from pulseloom.llm.work import staged, tidy

#: Base of the register scale, rows of a band, bands. At similarity 0.8 a pair shares no band once in a million times.
BASE, ROWS, BANDS = 1.2, 7, 52
REGISTERS = ROWS * BANDS
#: A register's value at a point of 1.
OFFSET = 40
#: A pair is dropped if its best likelihood is so many e-folds above that of the threshold (5 standard deviations).
MARGIN = 14.0
#: Documents of a block, and their shingles; families are searched by pairs of blocks.
BLOCK, BLOCK_SHINGLES = 512, 1 << 22
#: Classes of a block of a crowded band; its pairs are judged by pairs of blocks.
BAND_BLOCK = 2048
#: Pairs of a crowded band with so many standard deviations fewer equal registers than at the threshold aren't judged further.
SCREEN = 7.0
#: The table of word hashes is emptied at so many entries.
TABLE_WORDS = 100_000

_GAMMA, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < TABLE_WORDS:
            self[word] = h
        return h


_HASHES = _Hashes()


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``size`` words; fewer words are one shingle, none is the empty set.

    A-Z are lower-cased; words are split at spaces and \\x09 to \\x0D.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_HASHES) >= TABLE_WORDS:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        out = _mix(out * _GAMMA + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set that isn't empty."""
    m, n = REGISTERS, len(hashes)
    reach = (np.log(m) + 6) / n
    while True:
        first = np.full(m, np.inf)
        mean = m * reach
        seed, x, k, width = hashes, np.zeros(n), 0, int(np.ceil(mean + np.sqrt(mean))) + 1
        while len(seed):
            step = _GAMMA * np.arange(k + 1, k + width + 1, dtype=np.uint64)
            z = _mix(seed[:, None] + step[None, :])
            gap = -np.log(((z >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32) / m
            at = x[:, None] + np.cumsum(gap, axis=1)
            inside = at < reach
            place = ((z[inside] & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
            np.minimum.at(first, place.astype(np.int64), at[inside])
            going = inside[:, -1]
            seed, x, k, width = seed[going], at[going, -1], k + width, int(np.ceil(np.sqrt(mean))) + 2
        if np.isfinite(first).all():
            return np.clip(np.floor(OFFSET - np.log(np.maximum(first, 1e-300)) / np.log(BASE)), 0, 255).astype(np.uint8)
        reach *= 2


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def _share(x: np.ndarray) -> np.ndarray:
    """The chance that a register of one set is above the other's by having x of the union to itself."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def may_reach(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the joint likelihood of sketches (rows of a and b) leaves room for a similarity of ``threshold``.

    The likelihood of a similarity J is that of the counts of registers that are
    larger, smaller and equal, given both set sizes.
    """
    larger, smaller = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = REGISTERS - larger - smaller
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        p, q = _share(np.maximum(u - v * j, 1e-12)), _share(np.maximum(v - u * j, 1e-12))
        return larger * np.log(p) + smaller * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))

    grid = np.linspace(0.0, 1.0, 60)[None, :] * most
    values = log_likelihood(grid)
    best = values.argmax(1)
    estimate = grid[np.arange(len(grid)), best]
    at_threshold = log_likelihood(np.minimum(np.full_like(most, threshold), most))[:, 0]
    return (most[:, 0] >= threshold - 1e-12) & ((estimate >= threshold) | (values.max(1) - at_threshold <= MARGIN))


def tie(sketches: np.ndarray, sizes: np.ndarray, parts: np.ndarray, sides: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Places of pairs that tie ``parts`` of a band together: every pair of two parts and two sides is judged, unless it is tied by then."""
    # whatever the sizes are, registers are equal with this chance or a larger one at the threshold
    chance = 1 - _share(np.array(1 - threshold))
    least = REGISTERS * chance - SCREEN * np.sqrt(REGISTERS * chance * (1 - chance))
    parts, found = np.unique(parts, return_inverse=True)[1], []
    for i in range(len(parts) - 1):
        j = i + 1 + np.flatnonzero((parts[i + 1 :] != parts[i]) & (sides[i + 1 :] != sides[i]))
        if len(j):
            j = j[np.count_nonzero(sketches[j] == sketches[i], axis=1) >= least]
        if len(j):
            a = np.broadcast_to(sketches[i], (len(j), REGISTERS))
            j = j[may_reach(a, sketches[j], np.full(len(j), float(sizes[i])), sizes[j].astype(float), threshold)]
        for k in j:
            if parts[k] != parts[i]:
                found.append((i, int(k)))
                parts[parts == parts[k]] = parts[i]
    return found


def linked(common: np.ndarray, n_a, n_b, percent: int) -> np.ndarray:
    """100 * intersection >= percent * union."""
    return 100 * common >= percent * (n_a + n_b - common)


def search(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The root (smallest place) of each set among ``sets``: exact components of the linked pairs.

    A search from each set in turn: what is found joins, and only sets that are
    still apart are compared, so a family of near copies is gone through once.
    """
    root = np.full(len(sets), -1)
    sizes = np.array([len(s) for s in sets])
    apart = np.arange(len(sets))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    for start in range(len(sets)):
        if root[start] >= 0:
            continue
        root[start] = start
        queue = [start]
        apart = apart[apart != start]
        while queue and len(apart):
            if len(flat) > 2 * sizes[apart].sum():
                rest = np.isin(owner, apart)
                flat, owner = flat[rest], owner[rest]
            s = sets[queue.pop()]
            k = np.minimum(np.searchsorted(s, flat), len(s) - 1)
            common = np.bincount(owner[s[k] == flat], minlength=len(sets))
            near = apart[linked(common[apart], sizes[apart], len(s), percent)]
            if len(near):
                root[near] = start
                queue += near.tolist()
                apart = apart[root[apart] < 0]
    return root


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The runs of equal keys of sorted batches."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            held = pdf
            continue
        change = np.flatnonzero((pdf[keys].to_numpy()[1:] != pdf[keys].to_numpy()[:-1]).any(1)) + 1
        cuts = [0, *change.tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield pdf.iloc[a:b]
        held = pdf.iloc[cuts[-1] :]
    if held is not None and len(held):
        yield held


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text, any others).

    Documents are linked if 100 * intersection >= percent * union of their sets
    of shingles of ``size`` words; component_id is the smallest doc_id reachable
    by links. Null, empty and blank texts have the empty set, linked with
    nothing. doc_id names a document: repeated rows get the same answer. Rows
    without a doc_id are linked with nothing: they are kept, and their
    component_id is null. An empty table gives an empty result.
    """

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column("text").to_numpy(zero_copy_only=False)]
            ids = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            found = pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), ids, found], names=["doc_id", "n", "set_id", "sketch"])
        _HASHES.clear()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = staged(rows.mapInArrow(tidy(sketches), "doc_id long, n long, set_id binary, sketch binary"), "sketches")
    first = F.min(F.struct("doc_id", "n", "sketch")).alias("first")
    classes = found.where("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(first).select("set_id", F.col("first.doc_id").alias("rep"), "first.n", "first.sketch")
    classes = staged(classes, "classes")
    families = _families(classes, percent / 100)
    roots = _roots(rows, families.join(classes.select(F.col("rep").alias("node"), "n"), "node"), size, percent)
    named = classes.select("set_id", "rep").join(roots, "rep", "left").select("set_id", F.coalesce("root", "rep").alias("component"))
    named = staged(named, "named")
    out = found.select("doc_id", "n", "set_id").join(named, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def _families(classes: DataFrame, threshold: float) -> DataFrame:
    """(node, component): classes tied by bands, without the pairs that the likelihood rules out."""
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("sketch", k * ROWS + 1, ROWS)) for k in range(BANDS)])
    bands = classes.select("rep", F.explode(keys).alias("band"))
    ends = bands.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
    ends = staged(ends, "bands")
    tied = bands.join(ends, "band").select("rep", F.explode(F.array("low", "high")).alias("center")).where("rep != center")
    pairs = staged(tied.select(F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b")).distinct(), "pairs")
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a, b = (np.frombuffer(b"".join(pdf[f"sketch_{c}"]), np.uint8).reshape(-1, REGISTERS) for c in "ab")
                yield pdf.loc[may_reach(a, b, pdf["n_a"].to_numpy(float), pdf["n_b"].to_numpy(float), threshold), ["a", "b"]]

    parts = staged(components(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(tidy(judge), "a long, b long")), "parts")
    # the ends have been judged with all of the band, so bands of up to three are done
    inner = bands.join(ends.where("size > 3"), "band").where("rep != low AND rep != high").select("band", "rep")
    more = staged(_ties(inner, classes, parts, threshold), "ties")
    if more.isEmpty():
        return parts
    return components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def _ties(inner: DataFrame, classes: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): what ties the parts of each band of ``inner`` (band, rep), by all pairs of different parts, in blocks."""
    inner = inner.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("part"))
    inner = staged(inner, "inner")
    # bands of the same classes are judged once
    same = [F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("y")]
    split = inner.groupBy("band").agg(*same, F.min("part").alias("first"), F.max("part").alias("last")).where("first < last")
    split = staged(split.groupBy("size", "x", "y").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("size") / BAND_BLOCK).cast("int").alias("blocks")), "split")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, own).alias("i"), F.greatest(b, own).alias("j")))
    placed = inner.join(split, "band").select("band", "rep", "part", own.alias("own"), F.explode(others).alias("at")).select("band", "rep", "part", "own", "at.i", "at.j")
    with_sketch = placed.join(classes.select("rep", "n", "sketch"), "rep")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _grouped(batches, ["band", "i", "j"]):
            group = group.sort_values("rep")
            reps = group["rep"].to_numpy()
            sides = group["own"].to_numpy() if group["i"].iloc[0] < group["j"].iloc[0] else np.arange(len(group))
            sketches = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(-1, REGISTERS)
            found = tie(sketches, group["n"].to_numpy(), group["part"].to_numpy(), sides, threshold)
            yield pd.DataFrame({"a": [reps[i] for i, _ in found], "b": [reps[k] for _, k in found]}, dtype="int64")

    ordered = with_sketch.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return ordered.mapInPandas(tidy(judge), "a long, b long").distinct()


def _roots(rows: DataFrame, families: DataFrame, size: int, percent: int) -> DataFrame:
    """(rep, root) of the classes of families, by full sets: blocks of each family are searched pair by pair."""
    families = staged(families.where(F.col("node").isNotNull()), "families")
    blocks = families.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = families.drop("n").join(staged(blocks, "blocks"), "component")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, own).alias("i"), F.greatest(b, own).alias("j")))
    placed = placed.select("node", "component", "blocks", F.explode(others).alias("at")).select("node", "component", "blocks", "at.i", "at.j")
    with_text = placed.join(rows.withColumnRenamed("doc_id", "node"), "node")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _grouped(batches, ["component", "i", "j"]):
            group = group.drop_duplicates("node").sort_values("node")
            nodes = group["node"].to_numpy()
            roots = nodes[search([shingles(t, size) for t in group["text"]], percent)]
            yield pd.DataFrame({"a": nodes, "b": roots, "blocks": group["blocks"].to_numpy()})
        _HASHES.clear()

    ordered = with_text.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    found = staged(ordered.mapInPandas(tidy(link), "a long, b long, blocks int"), "links")
    single = found.where("blocks = 1").select(F.col("a").alias("rep"), F.col("b").alias("root"))
    several = components(found.where("blocks > 1").select("a", "b"))
    return single.unionByName(several.select(F.col("node").alias("rep"), F.col("component").alias("root")))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one of the smallest doc_id.

    Rows without a doc_id stay; repeated rows of a document stay or go together.
    """
    ids = near_duplicates(docs, size, percent).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__gone_id")).agg(F.bool_or("kept").alias("kept"))
    gone = ids.where("NOT kept").select("__gone_id")
    return docs.join(gone, docs["doc_id"] == gone["__gone_id"], "left_anti")
