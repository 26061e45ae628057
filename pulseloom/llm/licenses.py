"""License notices in texts: exact phrases, and short notices with a few edits.

A text is folded to its words, one blank between them. A notice with at most k
edits, cut into k + 1 pieces, has at least one piece in the text unchanged
(pigeonhole), so the pieces of all notices are the exact seeds of one
Aho-Corasick automaton. Around each seed lies a short window that holds every
match with that piece; the regex library's bounded-error matching decides
there, and whole words only. Words that tell licenses from each other (names, version numbers) must
be unchanged.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from pulseloom.llm.words import FOLD
from pulseloom.llm.work import tidy

#: Phrases whose exact places count as base, and their labels. Fixed values.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Notices that are searched with edits: label, text, most edits. Words in brackets allow none.
NOTICES = (
    ("mit", "under the [mit] license", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("apache-2", "apache license version [2]", 2),
    ("apache-2", "licensed under the [apache] license version [2 0]", 3),
    ("cc-by-nc", "[cc by nc]", 0),
    ("cc-by-nc", "creative commons attribution [noncommercial]", 3),
    ("cc-by-nc", "creative commons attribution [non commercial]", 3),
    ("gpl", "[gnu general] public license", 2),
    ("gpl", "under the [gpl]", 1),
    ("lgpl", "[gnu lesser] general public license", 2),
    ("agpl", "[gnu affero] general public license", 2),
    ("bsd", "under the [bsd] license", 2),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 6),
    ("mpl-2", "mozilla public license version [2]", 3),
    ("epl", "eclipse public license", 2),
    ("isc", "under the [isc] license", 2),
    ("cc-by-sa", "[cc by sa]", 0),
    ("cc0", "[cc0] public domain dedication", 3),
)


class Notice(NamedTuple):
    label: str
    text: str
    edits: int
    pattern: regex.Pattern
    #: (piece, characters before it, characters behind it)
    seeds: tuple[tuple[str, int, int], ...]


class Found(NamedTuple):
    label: str
    first: int
    last: int
    edits: int
    score: float


def notice(label: str, marked: str, edits: int) -> Notice:
    """A notice from its text with bracketed words that allow no edit."""
    text = marked.replace("[", "").replace("]", "")
    parts = regex.split(r"(\[[^]]*\])", marked)
    made = "".join(regex.escape(p[1:-1]) if p[0] == "[" else f"(?:{regex.escape(p)}){{e<={edits}}}" for p in parts if p)
    n = edits + 1
    cuts = [len(text) * i // n for i in range(n + 1)]
    seeds = tuple((text[a:b], a, len(text) - b) for a, b in zip(cuts, cuts[1:], strict=False))
    return Notice(label, text, edits, regex.compile(f"(?<![^ ]){made}(?![^ ])", regex.BESTMATCH), seeds)


@lru_cache(maxsize=4)
def automaton(notices: tuple = NOTICES) -> tuple[list[Notice], ahocorasick.Automaton]:
    """The notices, and the automaton of their seeds: (notice, before, behind) of each."""
    made = [notice(*n) for n in notices]
    found: dict[str, list[tuple[int, int, int]]] = {}
    for k, n in enumerate(made):
        for piece, before, behind in n.seeds:
            found.setdefault(piece, []).append((k, before, behind))
    seeds = ahocorasick.Automaton()
    for piece, where in found.items():
        seeds.add_word(piece, (len(piece), tuple(where)))
    seeds.make_automaton()
    return made, seeds


def fold(text: str | bytes | None) -> bytes:
    """The words of a text with one blank before, between and behind them; empty without words."""
    own = (text.encode() if isinstance(text, str) else text or b"").translate(FOLD).split()
    return b" %b " % b" ".join(own) if own else b""


def exact_places(folded: bytes) -> list[tuple[int, str]]:
    """(first word, label) of all places of the base phrases."""
    out = []
    for phrase, label in BASE:
        key, at = b" %b " % phrase.encode(), folded.find(b" %b " % phrase.encode())
        while at >= 0:
            out.append((folded.count(b" ", 0, at), label))
            at = folded.find(key, at + 1)
    return sorted(out)


def windows(line: str, notices: list[Notice], seeds: ahocorasick.Automaton) -> Iterator[tuple[Notice, int, int]]:
    """Each notice and stretch of whole words in which a match with one of its seeds unchanged must lie."""
    seen: set[tuple[int, int, int]] = set()
    for end, (size, where) in seeds.iter(line):
        for k, before, behind in where:
            e = notices[k].edits
            a, b = line.rfind(" ", 0, max(1, end + 1 - size - before - e)) + 1, line.find(" ", min(len(line) - 1, end + 1 + behind + e))
            if (k, a, b) not in seen:
                seen.add((k, a, b))
                yield notices[k], a, b


def fuzzy_places(folded: bytes, notices: tuple = NOTICES) -> list[Found]:
    """Notices with at most their edits in whole words: label, first and last word, edits, share of unchanged characters.

    Each seed gives its closest match; of overlapping matches of a notice the closest, then first, stays.
    """
    made, seeds = automaton(notices)
    line, best = folded.decode("utf-8", "replace"), {}
    for n, a, b in windows(line, made, seeds):
        at = line.find(f" {n.text} ", a - 1, b + 1)
        if at >= 0:
            best.setdefault(n, set()).add((0, at + 1, at + 1 + len(n.text)))
        elif (m := n.pattern.search(line, a, b)) and sum(m.fuzzy_counts) <= n.edits:
            best.setdefault(n, set()).add((sum(m.fuzzy_counts), *m.span()))
    out = []
    for n, own in best.items():
        taken: list[tuple[int, int]] = []
        for edits, a, b in sorted(own):
            k = bisect.bisect(taken, (a, b))
            if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
                taken.insert(k, (a, b))
                first = line.count(" ", 0, a) - 1
                out.append(Found(n.label, first, first + line.count(" ", a, b), edits, 1 - edits / len(n.text)))
    return sorted(set(out), key=lambda f: (f.first, f.last, f.label, f.edits))


def notices(text: str | bytes | None) -> tuple[int, list[tuple[int, str]], list[Found]]:
    """Number of words, base places, and all notices of the method."""
    folded = fold(text)
    return max(0, folded.count(b" ") - 1), exact_places(folded), fuzzy_places(folded)


REPORT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def license_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, any others): base places, labels and the score of the closest notice.

    Null counts as empty; a text without notices has no labels, score 0 and no
    first or last word. ``score`` is 1 for a base place, else the largest share
    of unchanged characters of a notice. ``spans`` lists all notices of the
    method as label:first word:last word:edits. Repeated rows give repeated
    rows, rows without a doc_id a row without one, an empty table an empty result.
    """
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                n, base, found = notices(text.as_py())
                own = {label for _, label in base}
                score = 1.0 if base else max((f.score for f in found), default=0.0)
                every = ",".join(sorted(own | {f.label for f in found}))
                spans = ",".join(f"{f.label}:{f.first}:{f.last}:{f.edits}" for f in found)
                rows.append((n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), every, score, spans))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), REPORT)
