"""Removed lines against a brute-force pass over all windows."""

import random

from pulseloom.llm import line_dedup


def brute(docs):
    first, cover = {}, {}
    for d, text in sorted((d, t) for d, t in docs if t is not None):
        lines = [(i, x.strip(line_dedup.BLANKS)) for i, x in enumerate(text.split("\n"))]
        lines = [x for x in lines if x[1]]
        for a, b, c in zip(lines, lines[1:], lines[2:], strict=False):
            if first.setdefault((a[1], b[1], c[1]), (d, a[0])) != (d, a[0]):
                cover.setdefault(d, set()).update((a[0], b[0], c[0]))
    out = {}
    for d, text in docs:
        if text is None:
            out[d] = None
        else:
            out[d] = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in cover.get(d, ()))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(2)
    docs = [(i, "\n".join(rng.choice(["a", "b", " c", "c ", "", "d\t", "e"]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "a\nb"), (103, "x\n\ny\n \nz"), (104, "x\ny\nz"), (105, "same\n" * 200), (106, "long " * 5000 + "\nq\nr")]
    df = spark.createDataFrame([(d, t, "k") for d, t in docs], "doc_id long, text string, kept string")
    rows = line_dedup.line_dedup(df).collect()
    want = brute(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert r.text == want[r.doc_id], (r.doc_id, r.text, want[r.doc_id])
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_repeated_and_missing_ids(spark):
    whole = "a\nb\nc\nd"
    rows = [(1, whole), (1, whole), (2, whole + "\ne"), (2, "x\ny\nz\nw"), (None, "k\nl\nm"), (3, "k\nl\nm\nn"), (4, "p\nq\nr"), (4, "p\nq\nr")]
    df = spark.createDataFrame([(i, t, "v") for i, t in rows], "doc_id long, text string, version string")
    got = sorted(((r.doc_id, r.text) for r in line_dedup.line_dedup(df).collect()), key=str)
    assert got == sorted([(1, whole), (1, whole), (2, "e"), (2, "x\ny\nz\nw"), (None, "k\nl\nm"), (3, "n"), (4, "p\nq\nr"), (4, "p\nq\nr")], key=str)
