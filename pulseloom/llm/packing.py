"""Packing token sequences by vector bin packing with the dot-product heuristic.

Each piece has a vector: tokens, segments (one) and loss-bearing tokens, each as
a share of its limit. An open sequence takes, of a bounded pool of pending
pieces, the one that fits and whose vector has the largest dot product with what
is left of the limits; when none fits, a pending piece is cut to fill the rest.
Tasks pack their own rows as a stream, so there is no shuffle, memory is bounded
by the pool, and a lost task is run again by itself.
"""

from __future__ import annotations

import base64
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pulseloom.llm.work import tidy

#: Limits of a sequence: tokens, segments, loss-bearing tokens.
TOKENS, SEGMENTS, LOSS = 1024, 64, 1016
#: The first tokens of a document are context and bear no loss.
CONTEXT = 16
#: Pieces that a task keeps pending.
POOL = 1024
#: Runs of white space from this length on are left to the tokenizers library; the other one's stack has no room for them.
LONG_RUN = 100_000
#: The id behind each document.
END_ID = 0


def byte_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class ByteIds:
    """Ids of whole texts as the tokenizers library gives them for the byte-level file.

    Texts are cut at special tokens, as the library does; what lies between them
    is encoded by the same vocabulary as ranks.
    """

    RUN = re.compile(rf"\s{{{LONG_RUN}}}")

    def __init__(self, json_path: str, rank_path: str):
        import public_tokenizers
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(json_path)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = {x.content: i for i, x in self.library.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    def encode(self, text: str) -> list[int]:
        if len(text) >= LONG_RUN and self.RUN.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        if not any(s in text for s in self.special):
            return self.ranks.encode_ordinary(text)
        ids: list[int] = []
        for part in self.cut.split(text):
            ids += [self.special[part]] if part in self.special else self.ranks.encode_ordinary(part)
        return ids


@lru_cache(maxsize=2)
def byte_ids(json_path: str, rank_path: str) -> ByteIds:
    return ByteIds(json_path, rank_path)


class Packer:
    """Packs the examples of one task. ``out`` collects (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, first_sequence: int, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, pool: int = POOL):
        self.limits, self.sequence = (tokens, segments, loss), first_sequence
        self.size = np.zeros(pool + 1, np.int64)
        self.loss = np.zeros(pool + 1, np.int64)
        self.items: list[tuple] = []
        self.out: list[tuple] = []

    def add(self, doc: int, ids: np.ndarray, loss_from: int) -> None:
        """Take in an example of which the first ``loss_from`` tokens bear no loss."""
        tokens, _, loss = self.limits
        at, n = 0, len(ids)
        while at < n:
            end = min(n, at + tokens, max(at, loss_from) + loss)
            if end - at == tokens:
                self._place([(doc, at, ids[at:end], n)])
            else:
                self._pend(doc, at, ids[at:end], n, loss_from)
            at = end

    def _pend(self, doc: int, start: int, ids: np.ndarray, n: int, loss_from: int) -> None:
        k = len(self.items)
        self.items.append((doc, start, ids, n, loss_from))
        self.size[k], self.loss[k] = len(ids), max(0, start + len(ids) - max(start, loss_from))
        if k + 1 == len(self.size):
            while len(self.items) > len(self.size) // 2:
                self._place(self._fill())

    def _take(self, k: int) -> tuple:
        last = len(self.items) - 1
        item = self.items[k]
        self.items[k] = self.items[last]
        self.size[k], self.loss[k] = self.size[last], self.loss[last]
        self.items.pop()
        return item

    def _fill(self) -> list[tuple]:
        """The pieces of the next sequence."""
        tokens, segments, loss = left = list(self.limits)
        got = []
        while self.items and left[0] and left[1]:
            size, bearing = self.size[: len(self.items)], self.loss[: len(self.items)]
            # the dot product of what is left with each piece, all as shares of the limits
            score = size * (left[0] / tokens**2) + left[1] / segments**2 + bearing * (left[2] / loss**2)
            score[(size > left[0]) | (bearing > left[2])] = -1
            k = int(score.argmax())
            if score[k] < 0:  # none fits: cut the one of which most fits
                k = int(np.minimum(np.minimum(size, left[0]), size - bearing + left[2]).argmax())
                doc, start, ids, n, loss_from = self.items[k]
                end = min(start + left[0], max(start, loss_from) + left[2])
                if end <= start:
                    break
                self.items[k] = (doc, end, ids[end - start :], n, loss_from)
                self.size[k] -= end - start
                self.loss[k] = max(0, start + len(ids) - max(end, loss_from))
                doc, start, ids, n, loss_from = doc, start, ids[: end - start], n, loss_from
            else:
                doc, start, ids, n, loss_from = self._take(k)
            got.append((doc, start, ids, n))
            left[0] -= len(ids)
            left[1] -= 1
            left[2] -= max(0, start + len(ids) - max(start, loss_from))
        return got

    def _place(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, n in pieces:
            self.out.append((doc, start, ids, n, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def finish(self) -> None:
        """Place what is pending; the last sequence is cut into sequences of powers of two, which need no padding."""
        while self.items:
            got = self._fill()
            total = sum(len(x[2]) for x in got)
            if total == self.limits[0]:
                self._place(got)
                continue
            while got:
                room, part = 1 << (sum(len(x[2]) for x in got).bit_length() - 1), []
                while room:
                    doc, start, ids, n = got.pop(0)
                    part.append((doc, start, ids[:room], n))
                    if len(ids) > room:
                        got.insert(0, (doc, start + room, ids[room:], n))
                    room -= min(room, len(ids))
                self._place(part)

    def drain(self, with_ids: bool) -> pa.RecordBatch:
        out, self.out = self.out, []
        blobs = [x[2].tobytes() for x in out]
        columns = [
            pa.array([x[0] for x in out], pa.int64()), np.array([x[1] for x in out], np.int64), np.array([len(x[2]) for x in out], np.int64), np.array([zlib.crc32(b) for b in blobs], np.int64),
            np.array([x[3] for x in out], np.int64), np.array([x[4] for x in out], np.int64), np.array([x[5] for x in out], np.int64), *([pa.array(blobs, pa.binary())] if with_ids else []),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*NAMES, "ids"][: len(columns)])


NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
COLUMNS = ", ".join(f"{c} long" for c in NAMES)


def _packed(df: DataFrame, examples: Callable[[pa.RecordBatch], Iterable[tuple]], limits: tuple[int, int, int], with_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 36, *limits)
        for batch in batches:
            for doc, ids, loss_from in examples(batch):
                packer.add(doc, ids, loss_from)
            yield packer.drain(with_ids)
        packer.finish()
        yield packer.drain(with_ids)

    return df.mapInArrow(tidy(run), COLUMNS + ", ids binary" * with_ids)


def pack_documents(docs: DataFrame, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS), with_ids: bool = False, context: int = CONTEXT) -> DataFrame:
    """Pack the ids of ``docs`` (doc_id, text, any others), each document followed by id 0.

    A row per piece. Null and empty texts are the end id alone; repeated rows are
    packed as often as they come, rows without a doc_id like others; an empty table gives no sequences. All tokens
    but a document's first ``context`` bear loss. ``docs`` should be read from
    files, so that a task that runs again sees its rows in the same order.
    """
    paths = byte_paths()

    def examples(batch: pa.RecordBatch):
        encode = byte_ids(*paths).encode
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_numpy(zero_copy_only=False), strict=True):
            ids = encode(text)
            ids.append(END_ID)
            yield doc, np.frombuffer(struct.pack(f"<{len(ids)}I", *ids), "<u4"), context

    return _packed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), examples, limits, with_ids)


def pack_examples(examples: DataFrame, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS), with_ids: bool = True) -> DataFrame:
    """Pack encoded instruction data: doc_id, ids (little-endian unsigned 32-bit), loss_from (tokens of the prompt).

    Null ids and examples without ids give no piece.
    """

    def each(batch: pa.RecordBatch):
        for doc, ids, loss_from in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "loss_from")), strict=True):
            yield doc, np.frombuffer(ids, "<u4"), loss_from

    rows = examples.select(F.col("doc_id").cast("long").alias("doc_id"), "ids", F.coalesce("loss_from", F.lit(0)).cast("long").alias("loss_from"))
    return _packed(rows.where(F.length("ids") >= 4), each, limits, with_ids)
