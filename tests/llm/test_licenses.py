"""License notices against plain word loops and an edit-distance table."""

import random
import re

import pytest

from pulseloom.llm import licenses as li

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    """n_words, and (first word, label) of base places, by the words alone."""
    own = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for phrase, label in li.BASE for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]
    return len(own), sorted(places)


def least_edits(marked, words, most):
    """Fewest edits of a notice over all stretches of whole words, bracketed parts unchanged; None above ``most``."""
    parts = [p for p in re.split(r"(\[[^]]*\])", marked) if p]
    line = " ".join(words)
    starts = [0] + [m.end() for m in re.finditer(" ", line)] if line else []
    stops = {m.start() for m in re.finditer(" ", line)} | {len(line)}
    best = None
    for a in starts:
        costs = {a: 0}  # costs of the parts so far by where they end
        for p in parts:
            fixed, p = p[0] == "[", p.strip("[]") if p[0] == "[" else p
            after = {}
            for at, cost in costs.items():
                if fixed:
                    if line.startswith(p, at):
                        after[at + len(p)] = min(cost, after.get(at + len(p), 99))
                    continue
                row = {at + j: cost + j for j in range(most + 1) if at + j <= len(line)}
                for c in p:
                    new = {}
                    for e, v in row.items():
                        new[e] = min(new.get(e, 99), v + 1)
                        if e < len(line):
                            new[e + 1] = min(new.get(e + 1, 99), v + (line[e] != c))
                    for e in sorted(new):
                        if e + 1 <= len(line):
                            new[e + 1] = min(new.get(e + 1, 99), new[e] + 1)
                    row = {e: v for e, v in new.items() if v <= most}
                for e, v in row.items():
                    after[e] = min(v, after.get(e, 99))
            costs = after
        for e, v in costs.items():
            if e in stops and e > a and v <= most:
                best = v if best is None else min(best, v)
    return best


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("abez 1") + text[i:], text[:i] + rng.choice("abez 1") + text[i + 1 :]])
    return text


def test_base_places():
    rng = random.Random(2)
    pool = ["Under", "THE", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "x", "mité", "2a"]
    for _ in range(400):
        text = "".join(rng.choice(pool) + rng.choice([" ", "-", "\n", ", ", "__"]) for _ in range(rng.randint(0, 40)))
        text += rng.choice(["", "under the mit license", "Apache License,\tVersion 2.0", "CC BY-NC 4.0"])
        n, base, _ = li.notices(text)
        assert (n, base) == plain(text)


def test_fuzzy_equals_brute_force():
    rng = random.Random(3)
    notices = [n for n in li.NOTICES if len(n[1]) < 50]
    missed = []
    for _ in range(250):
        label, marked, most = rng.choice(notices)
        text = " ".join(rng.choice(["the", "foo", "under", "license", "a", "version", "public"]) for _ in range(rng.randint(0, 4)))
        text += " " + edited(rng, re.sub(r"[][]", "", marked), rng.randint(0, most + 2)) + " the end"
        folded = li.fold(text)
        found = li.fuzzy_places(folded)
        words = folded.decode().split()
        want = {}
        for lab, mark, k in notices:
            e = least_edits(mark, words, k)
            if e is not None:
                score = 1 - e / len(re.sub(r"[][]", "", mark))
                want[lab] = max(want.get(lab, 0), score)
        got = {}
        for f in found:
            got[f.label] = max(got.get(f.label, 0), f.score)
        if got != want:
            missed.append((text, got, want))
    assert not missed, (len(missed), missed[:3])


@pytest.mark.parametrize("text,labels", [
    ("Released under the MIT Licence.", "mit"), ("released under the mt license", ""), ("under the mpl license", ""), ("Apache License, Version 1.0", ""), ("Apache Licence, Vesion 2.0", "apache-2"),
    ("CC BY-ND", ""), ("cc-by-sa 4.0", "cc-by-sa"), ("under teh MIT license, or the GNU General Public Licence", "gpl,mit"), ("Permission is hereby granted, free of charge, to any persons obtaining copies", "mit"),
    ("the license of the house under the roof", ""), ("", ""), (None, ""), ("under the mit\nlicenses", "mit"),
])
def test_labels(text, labels):
    assert ",".join(sorted({f.label for f in li.fuzzy_places(li.fold(text))})) == labels


def test_table(spark):
    long = "word " * 100_000 + "under the mit license " * 2_000 + "cc by nc"
    docs = spark.createDataFrame([(1, "Under the MIT license.", "x", 5), (2, None, "x", 5), (None, "apache licence version 2", "x", 5), (1, "Under the MIT license.", "x", 5), (3, long, "x", 5)], "doc_id long, text string, labels string, score int")
    rows = {(r.doc_id, r.n_words): r for r in li.license_report(docs).collect()}
    assert li.license_report(docs).count() == 5 and li.license_report(docs.limit(0)).count() == 0
    assert rows[1, 4][2:] == (1, 0, 0, "mit", "mit", 1.0, "mit:0:3:0")
    assert rows[2, 0][2:] == (0, None, None, "", "", 0.0, "")
    assert rows[None, 4][2:] == (0, None, None, "", "apache-2", 1 - 1 / 24, "apache-2:0:3:1")
    r = rows[3, 108_003]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (2_001, 100_000, 108_000, "cc-by-nc,mit") and r.spans.count("mit:") == 2_000
