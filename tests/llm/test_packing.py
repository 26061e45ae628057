"""Pieces against whole encodings, limits and padding."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from pulseloom.llm import packing

LIBRARY = Tokenizer.from_file(packing.byte_paths()[0])
ODD = ["a  b", " lead", "trail ", "x\n y", "x \ny", "tab\t z", "it's  'll", "a b", "é ñ  ü", "1 2  3", "…  . ,", "<|endoftext|> a", "x <|endoftext|><|endoftext|>\n y <|endoftext|>", "a\x1c b", "\n\n", "", "  ", "a  b", "a  b"]


def test_ids_equal_library():
    words = packing.byte_ids(*packing.byte_paths())
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["the", " ", "  ", "\n", "'s", "é", "7", ".", "ation", "\t", "😀", "'"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for t in texts:
        assert words.encode(t) == LIBRARY.encode(t, add_special_tokens=False).ids, repr(t)


def test_long_runs():
    words = packing.byte_ids(*packing.byte_paths())
    for t in (" " * 99_999 + "x", "\n" * 150_000 + "x", "ab" * 100_000):
        assert words.encode(t) == LIBRARY.encode(t, add_special_tokens=False).ids


def check(rows, want, tokens=1024, segments=64):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for doc, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want[doc])
            assert r.ids_crc32 == zlib.crc32(np.array(want[doc][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want[doc])
    padding = total = 0
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= tokens and len(parts) <= segments
        padding += 0 if at & (at - 1) == 0 else tokens - at
        total += at
    return padding / max(1, total)


def test_pack_documents(spark):
    rng = random.Random(3)
    texts = [*ODD, None, "word " * 5000] + ["w%d " % rng.randint(0, 99) * rng.randint(1, 900) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, offset int, length string").repartition(3)
    rows = packing.pack_documents(df).collect()
    want = {i: LIBRARY.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert check(rows, want) < 0.001
    loss = {}
    for r in rows:
        loss[r.sequence_id] = loss.get(r.sequence_id, 0) + max(0, r.start + r.length - max(r.start, packing.CONTEXT))
    assert max(loss.values()) == packing.LOSS  # the limit binds: a full sequence holds the beginning of some document
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_limits_hold(spark):
    rng = random.Random(4)
    want = {i: [rng.randint(1, 9)] * rng.randint(1, 300) for i in range(500)}
    df = spark.createDataFrame([(i, bytearray(np.array(x, "<u4").tobytes()), len(x) // 3) for i, x in want.items()] + [(900, None, 0)], "doc_id long, ids binary, loss_from long").coalesce(1)
    rows = packing.pack_examples(df, (256, 4, 120)).collect()
    check(rows, want, 256, 4)
    loss = {}
    for r in rows:
        loss[r.sequence_id] = loss.get(r.sequence_id, 0) + max(0, r.start + r.length - max(r.start, len(want[r.doc_id]) // 3))
    assert max(loss.values()) <= 120
