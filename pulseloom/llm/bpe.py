"""BPE encoding and decoding of whole texts by tree concatenation.

The words of a text, each with a mark at its end, are one string. It is halved
down to leaves wherever the halves fall, also inside words; leaves are encoded
on their own, and at each join of the tree a growing window is encoded again
until both sides agree with it exactly. Texts longer than PIECE_CHARS are dealt
out as rows, so that their pieces are encoded in parallel, and put together by
the same joins.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import unicodedata
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulseloom.llm.work import tidy

#: Strings longer than this are halved.
LEAF_CHARS = 2_048
#: Texts longer than this are dealt out as rows of their own.
PIECE_CHARS = 65_536
#: Tokens on each side of a join that are encoded again at first, and those at each end of the window that must agree.
WINDOW, AGREE = 8, 2

#: The mark behind each word; texts that hold it themselves are left to the library.
MARK = "\0"
_END = "</w>"


def word_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer of the file, on one thread, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def _ranges(wanted: Callable[[str], bool], last: int = 0x10FFFF) -> str:
    """The wanted characters up to ``last`` as the inside of a character class."""
    out, begin = [], None
    for c in range(last + 2):
        inside = c <= last and wanted(chr(c))
        if inside and begin is None:
            begin = c
        elif not inside and begin is not None:
            out.append(f"\\U{begin:08x}-\\U{c - 1:08x}")
            begin = None
    return "".join(out)


def _is_unsure(c: str) -> bool:
    """Whether libraries of different ages may treat a character differently: it isn't assigned here, or is a mark that came after Unicode 3.2."""
    kind = unicodedata.category(c)
    return kind == "Cn" or kind[0] == "M" and unicodedata.ucd_3_2_0.category(c) == "Cn"


@lru_cache(maxsize=1)
def _classes() -> tuple[re.Pattern, re.Pattern]:
    """The pre-tokenizer's pattern for lower-case text, and the characters that may be unsure."""
    letters, numbers = (_ranges(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
    words = re.compile(f"[{letters}]+|[{numbers}]|'(?:[stmd]|re|ve|ll)|[^\\s{letters}{numbers}]+")
    return words, re.compile(f"[{_ranges(_is_unsure, 0xFFFF)}\U00010000-\U0010ffff]")


_ASCII_WORDS = re.compile(r"[a-z]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\sa-z0-9]+", re.A)
#: Texts with these are left to the library: the mark, and what only Python takes for white space.
_ODD = re.compile("[\0\x1c-\x1f]")


def marked(text: str) -> str | None:
    """The words of a text as the normalizer and the pre-tokenizer give them, a mark behind each; None: they can't be told here."""
    if _ODD.search(text):
        return None
    find = _ASCII_WORDS.findall
    if not text.isascii():
        every, unsure = _classes()
        if unsure.search(text) and any(map(_is_unsure, set(text))):
            return None
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        find = lambda w: (_ASCII_WORDS if w.isascii() else every).findall(w)
    words: list[str] = []
    for w in text.lower().split():
        if w.isalpha():
            words.append(w)
        else:
            words += find(w)
    return MARK.join(words) + MARK if words else ""


def cuts(n: int, most: int) -> list[int]:
    """Ends of the parts into which n characters are halved until none is longer than ``most``."""
    k = 1 << ((max(1, n) - 1) // most).bit_length()
    return [n * i // k for i in range(k + 1)]


class Bpe:
    """Encoding and decoding by the vocabulary of a file whose merges are numbered in their order, as ranks."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # the byte-level alphabet: bytes that print stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        raw = lambda s: bytes(map(alphabet.__getitem__, s))
        ranks = {raw(s[: -len(_END)]) + MARK.encode() if s.endswith(_END) else raw(s): i for s, i in vocab.items()}
        if len(ranks) != len(vocab):
            raise ValueError("two entries of the vocabulary have the same bytes")
        self.library, self.leaf_chars, self.joins = tokenizer(path), leaf_chars, 0
        self.special = {x.content: i for i, x in self.library.get_added_tokens_decoder().items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.ranks = tiktoken.Encoding("word_bpe", pat_str="[^\\x00]*\\x00|[^\\x00]+", mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: b for b, i in ranks.items()}
        self.inside = {i for b, i in ranks.items() if 0x80 <= b[0] < 0xC0}  # these begin within a character
        self.texts = {i: s for s, i in (*vocab.items(), *self.special.items())}

    def segments(self, text: str) -> list[str | int | tuple[str]]:
        """What a text consists of: marked words, ids of special tokens, and texts (in a tuple) that are left to the library."""
        parts = self.at_special.split(text) if any(s in text for s in self.special) else [text]
        out: list[str | int | tuple[str]] = []
        for p in parts:
            if p in self.special:
                out.append(self.special[p])
            elif p:
                words = marked(p)
                out.append((p,) if words is None else words)
        return out

    def seam(self, left: Sequence[int], right: Sequence[int]) -> tuple[int, list[int], int]:
        """(i, window, j): left[:i] + window + right[j:] are the ids of what left and right stand for.

        The window's ids are found by encoding it as a whole; at both ends they
        are those of left and right. So each pair of neighbours in the result
        comes from an encoding that saw both of them.
        """
        self.joins += 1
        width = WINDOW
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            while i > 0 and left[i] in self.inside:
                i -= 1
            while j < len(right) and right[j] in self.inside:
                j += 1
            old, new = list(left[i:]), list(right[:j])
            window = self.ranks.encode_ordinary(b"".join(map(self.bytes.__getitem__, old + new)).decode())
            if (i == 0 or window[:AGREE] == old[:AGREE]) and (j == len(right) or window[-AGREE:] == new[-AGREE:]):
                return i, window, j
            width *= 2

    def tree(self, words: str) -> list[int]:
        """The ids of a string of marked words, or of any part of one, by halves."""
        ends = cuts(len(words), self.leaf_chars)
        if len(ends) == 2:
            return self.ranks.encode_ordinary(words)
        level = [self.ranks.encode_ordinary(words[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        while len(level) > 1:
            for k in range(0, len(level), 2):
                i, window, j = self.seam(level[k], level[k + 1])
                level[k][i:] = window
                level[k] += level[k + 1][j:]
            level = level[::2]
        return level[0]

    def ids(self, segment: str | int | tuple[str]) -> list[int]:
        """The ids of a segment."""
        if isinstance(segment, str):
            return self.tree(segment)
        return [segment] if isinstance(segment, int) else self.library.encode(segment[0], add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        """The ids of a text, as the library gives them."""
        parts = self.segments(text)
        return self.ids(parts[0]) if len(parts) == 1 else [i for p in parts for i in self.ids(p)]

    def decode(self, ids: Sequence[int]) -> str:
        """What the library decodes: the file has no decoder, so tokens are joined by spaces."""
        return " ".join(map(self.texts.__getitem__, ids))


@lru_cache(maxsize=4)
def bpe_of(path: str) -> Bpe:
    """This worker's vocabulary of the file."""
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str | None = None, digests: bool = False, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each row of ``docs`` (doc_id, text, any others).

    ids are little-endian unsigned 32-bit integers; they and the decoded text
    equal the library's. Null counts as empty: no ids, empty text. Repeated rows
    give repeated rows; a null doc_id stays null; an empty table gives none.
    With ``digests``, ids and decoded are their hex SHA-256.
    """
    path = path or word_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = f"doc_id long, n_tokens long, ids {'string' if digests else 'binary'}, decoded string"

    def finished(doc_ids: pa.Array, found: list[Sequence[int]]) -> list[pa.Array]:
        decode = bpe_of(path).decode
        ids, texts = [struct.pack(f"<{len(x)}I", *x) for x in found], [decode(x) for x in found]
        if digests:
            ids, texts = [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x.encode()).hexdigest() for x in texts]
        return [doc_ids, pa.array([len(x) for x in found], pa.int64()), pa.array(ids, pa.string() if digests else pa.binary()), pa.array(texts, pa.string())]

    names = ["doc_id", "n_tokens", "ids", "decoded"]
    held = 1 << 20  # characters whose ids are held at once

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe_of(path).encode
        for batch in batches:
            texts, begin, chars, found = batch.column("text").to_numpy(zero_copy_only=False), 0, 0, []
            for k, text in enumerate(texts):
                found.append(encode(text))
                chars += len(text)
                if chars >= held or k + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays(finished(batch.column("doc_id").slice(begin, k + 1 - begin), found), names=names)
                    begin, chars, found = k + 1, 0, []

    piece = pa.schema([("doc_id", pa.int64()), ("whole", pa.string()), ("piece", pa.int64()), ("kind", pa.string()), ("text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = bpe_of(path).segments
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                key, k = hashlib.sha256(text.encode()).hexdigest(), 0
                for s in segments(text) or [""]:
                    if isinstance(s, str):
                        ends = cuts(len(s), piece_chars)
                        parts = [("first" if a == 0 else "glued", s[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                    else:
                        parts = [("special", str(s))] if isinstance(s, int) else [("library", s[0])]
                    for kind, part in parts:
                        yield pa.RecordBatch.from_pylist([{"doc_id": doc, "whole": key, "piece": k, "kind": kind, "text": part}], schema=piece)
                        k += 1

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe_of(path)
        for batch in batches:
            for r in batch.to_pylist():
                kind, text = r["kind"], r.pop("text")
                found = own.ids(int(text) if kind == "special" else (text,) if kind == "library" else text)
                yield pa.RecordBatch.from_pylist([r | {"ids": struct.pack(f"<{len(found)}I", *found)}], schema=piece.remove(4).append(pa.field("ids", pa.binary())))

    def assemble(table: pa.Table) -> pa.Table:
        own, ids, copies = bpe_of(path), array("I"), table.column("piece").to_pylist().count(0)
        table, before = table.sort_by("piece"), -1
        for batch in table.to_batches():
            for k, kind, blob in zip(*(batch.column(c) for c in ("piece", "kind", "ids")), strict=True):
                if k.as_py() == before:  # of a repeated row
                    continue
                before, here = k.as_py(), array("I", blob.as_py())
                if kind.as_py() == "glued" and ids and here:
                    i, window, j = own.seam(ids, here)
                    ids[i:] = array("I", window)
                    here = here[j:]
                ids.extend(here)
        one = finished(table.column("doc_id").slice(0, 1).combine_chunks(), [ids])
        return pa.Table.from_arrays([pa.concat_arrays([c] * copies) for c in one], names=names)

    short = rows.where(F.char_length("text") <= piece_chars).mapInArrow(tidy(whole), schema)
    keys = "doc_id long, whole string, piece long, kind string"
    pieces = rows.where(F.char_length("text") > piece_chars).mapInArrow(cut, f"{keys}, text string")
    pieces = pieces.repartition("doc_id", "whole", "piece").mapInArrow(encode_pieces, f"{keys}, ids binary")
    return short.unionByName(pieces.groupBy("doc_id", "whole").applyInArrow(assemble, schema))


def bpe_report(docs: DataFrame, path: str | None = None, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of ids and decoded text, as encode_documents gives them."""
    return encode_documents(docs, path, True, piece_chars).select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))
