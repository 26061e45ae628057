"""Ids and decoded text against the library on whole texts."""

import hashlib
import json
import random
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers.models import BPE

from pulseloom.llm import bpe

WHOLE = bpe.tokenizer(bpe.word_path())


def own(leaf_chars):
    return bpe.Bpe(bpe.word_path(), leaf_chars)


def library(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


def want(text):
    ids = library(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(WHOLE.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def unsplit(rng, n):
    parts = ["the", "ation", "ing", "'s", "'ll", "!!'", "…", "é", "é", "ñandú", "42", "7", "日本語", "한국", "😀", "<|endoftext|>", "<|startof", "text|>", "Qq", "zx", "İ", "ﬁ", "-", ".", "''s", "ΑΣ", "Σ.", "\x1d", "\0", "\u0378"]
    out = ""
    while len(out) < n:
        out += rng.choice(parts)
    return out


@pytest.mark.parametrize("leaf", [16, 37, 128])
def test_tree_equals_whole(leaf):
    coder = own(leaf)
    for seed in range(120):
        rng = random.Random(seed)
        text = unsplit(rng, rng.randint(1, 900)) if seed % 3 else "".join(rng.choice("abcdest") for _ in range(rng.randint(1, 700)))
        if seed % 2:
            text = " ".join(text[k : k + 9] for k in range(0, len(text), 9))
        ids = coder.encode(text)
        assert ids == library(text), text
        assert coder.decode(ids) == WHOLE.decode(ids, skip_special_tokens=False)
    assert coder.joins > 100


def test_runs():
    coder = own(16)
    for text in ("a", "a" * 50, "a" * 333, "ab" * 200, "é" * 100, "日" * 99, " " * 100, "x" + "\n" * 5000 + "y"):
        assert coder.encode(text) == library(text)


def test_every_token_encodes_to_itself():
    """With this, ranks and merges give the same ids: any two neighbours that merge would have merged in both."""
    model = json.loads(Path(bpe.word_path()).read_text())["model"]
    inner = BPE(vocab=model["vocab"], merges=[tuple(m) for m in model["merges"]])
    for s, i in model["vocab"].items():
        found = WHOLE.model.tokenize(s[:-4]) if s.endswith("</w>") else inner.tokenize(s)
        assert [x.id for x in found] == [i], s


def test_characters():
    coder = own(64)
    rng = random.Random(2)
    for c in rng.sample([c for c in range(0x20000) if not 0xD800 <= c <= 0xDFFF], 6_000) + [0x7FD, 0x899, 0x1715, 0x11930, 0x10EFD, 0x345, 0x3A3, 0x130, 0x1C, 0x85, 0xA0]:
        text = f"a{chr(c)}b 1{chr(c)} .{chr(c)}{chr(c)} {chr(c)}x e{chr(c)}\u0301 A{chr(c)}"
        assert coder.encode(text) == library(text), (hex(c), unicodedata.category(chr(c)))


def test_trees_on_the_given_documents():
    coder = own(bpe.LEAF_CHARS)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()
    for t in texts:
        ids = coder.encode(t or "")
        assert ids == library(t or "")
    assert coder.joins >= sum(len(t or "") > 2 * bpe.LEAF_CHARS for t in texts) > 0


def test_documents(spark):
    rng = random.Random(5)
    texts = [None, "", "   ", "Plain words\n\n  here\tand there ́x", "<|endoftext|> a<|startoftext|>b", unsplit(rng, 30_000), " ".join(unsplit(rng, 20) for _ in range(200)), "x"]
    long = [unsplit(rng, 12_000) + " " + unsplit(rng, 7_000), "word " * 3_000 + "Straße" * 1_500, "na" * 9_000, " " * 6_000]
    rows = [(i, t, 0) for i, t in enumerate(texts + long)] + [(len(texts), long[0], 1), (None, "no id " * 2_000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.bpe_report(df, piece_chars=5_000).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "no id " * 2_000 if r.doc_id is None else (texts + long)[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(text), r.doc_id
    assert bpe.bpe_report(df.limit(0)).count() == 0
