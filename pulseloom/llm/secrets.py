"""Secrets by patterns, and by how new a string is to a dictionary-primed compressor.

A candidate in a sensitive context (near a word such as "password" or "bearer")
is compressed behind the text around it, by zstandard primed with a dictionary
of identifiers and code words. The bytes that it adds are its novelty. Strings
that add nearly as many bytes as random ones do are reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulseloom.llm.work import tidy

# The patterns of the base kinds, and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 or more: shorter runs are dropped anyhow
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
BASE = ("assign", "access", "hex")

#: Words that make what follows them sensitive.
SENSITIVE = re.compile(r"(?:passw|secret|token|api.?key|bearer|credential|private.?key|auth)", re.I | re.A)
#: Candidates stand within so many characters behind a sensitive word.
REACH = 80
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Text around a candidate that its novelty is measured against, on each side.
AROUND = 400
#: Added bytes for each character from which a candidate is reported. Letters and digits at random take about 0.75.
LEAST_NOVELTY = 0.62

# A dictionary of identifiers and code words that often stand in configuration and source text.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_secret authorization bearer credential "
    "username user_id account session cookie header request response content-type application/json localhost example "
    "config settings environment database connection string timeout version release default true false null none "
    "import from return class function public static void const let var self this print open read write close "
    "https http www com org net html script style begin end certificate ssh rsa md5 sha1 sha256 base64 uuid "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
)


@lru_cache(maxsize=1)
def _compressor():
    import zstandard

    primer = zstandard.ZstdCompressionDict(IDENTIFIERS.encode() * 2, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primer, write_checksum=False, write_content_size=False)


def novelty(context: str, candidate: str) -> float:
    """Bytes for each character that the candidate adds to its context's compressed size."""
    c, before, data = _compressor(), context.encode(), candidate.encode()
    return max(0, len(c.compress(before + b"\n" + data)) - len(c.compress(before + b"\n"))) / max(1, len(data))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


def novel_spans(text: str, known: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates in a sensitive context that no base span covers and whose novelty is high."""
    out, done = [], 0
    covered = sorted((a, b) for _, a, b in known)
    at = 0
    for s in SENSITIVE.finditer(text):
        for m in CANDIDATE.finditer(text, max(done, s.end()), s.end() + REACH + 256):
            a, b = m.span()
            if a > s.end() + REACH:
                break
            if b == s.end() + REACH + 256:  # it may go on
                b = CANDIDATE.match(text, a).end()
            done = b
            while at < len(covered) and covered[at][1] <= a:
                at += 1
            if at < len(covered) and covered[at][0] < b:
                continue
            word = text[a:b]
            kinds = sum(bool(re.search(p, word)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
            if kinds >= 2 and novelty(text[max(0, a - AROUND) : a] + text[b : b + AROUND], word) >= LEAST_NOVELTY:
                out.append(("novel", a, b))
    return out


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and all of them, both by start, then kind."""
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base), key=lambda s: (s[1], (*BASE, "novel").index(s[0])))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


REPORT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secret_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, any others): counts of the base kinds, their digest, and all spans.

    Positions are code points, the end exclusive. Null counts as empty; texts
    without secrets have zeros, the digest of an empty string and no spans.
    Repeated rows give repeated rows, rows without a doc_id a row without one,
    and an empty table an empty result.
    """

    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, every = all_spans(text)
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, REPORT)


def redacted(text: str, mark: str) -> str:
    """The text with each span (overlapping ones as one) replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in all_spans(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with secrets in ``text`` replaced; ``n_chars``, where there is one, follows.

    Null texts stay null; every row stays, whatever its doc_id and however often it comes.
    """
    schema = docs.schema
    counted = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts = [None if t is None else redacted(t, mark) for t in batch.column(k).to_pylist()]
            yield batch.set_column(k, "text", pa.array(texts, pa.string()))

    out = docs.mapInArrow(tidy(run), schema)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if counted else out
