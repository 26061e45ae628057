"""Spans against a brute-force scan of each text."""

import hashlib
import re

from pyspark.sql import Row, functions as F

from pulseloom.llm import pii

CLASSES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ok(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        twice = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return True


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in CLASSES.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


TEXTS = [
    "write to a.b+c@x-y.co.uk or a@b.c_d@e.f.g and q@nodots, @a.b c@d.e",
    "ip 10.0.0.1 256.1.1.1 0255.000.1.1 1.2.3.4.5.6.7.8 00000000000000000000001.1.1.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 5500005555555559 1 2 3",
    "call +1 (415) 555-0123 or +49 30 1234567 +1 and +((((1 +1-2 +123456789012345678",
    "emoji 😀 first@mail.org then ü 192.168.0.1 😀 +44 20 7946 0958",
    "", None, "   ", "é" * 50 + "z@z.zz" * 3,
    "a@b.c " * 700 + "1.2.3.4",
    "iban DE89 3704 0044 0532 0130 00 and DE89370400440532013001; ssn 123-45-6789 but 123-45-6789",
    "x" * 60000 + "@y.zz" + ".a" * 9000,
]


def test_base_spans_match_brute_force(spark):
    df = spark.createDataFrame([Row(doc_id=i, text=t, pii="clash", kind=1) for i, t in enumerate(TEXTS)], "doc_id long, text string, pii string, kind int")
    rows = {r.doc_id: r for r in pii.pii_report(df).collect()}
    for i, t in enumerate(TEXTS):
        want = brute(t)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, want, rows[i].spans)
        assert [rows[i][f"n_{k}"] for k in CLASSES] == [sum(w.startswith(k) for w in want) for k in CLASSES]


def test_added_kinds_need_checksum_and_context(spark):
    df = spark.createDataFrame([(1, TEXTS[10])], "doc_id long, text string")
    spans = pii.pii_report(df).first().spans
    assert "iban:5:32" in spans and spans.count("iban") == 1
    assert spans.count("national_id") == 1  # the word "ssn" stands before the first only


def test_mask_and_empty(spark):
    df = spark.createDataFrame([(1, "mail a@b.cc now"), (2, None), (3, "plain")], "doc_id long, text string")
    assert [r.text for r in pii.mask_pii(df).orderBy("doc_id").collect()] == ["mail <email> now", None, "plain"]
    assert pii.pii_report(df.where(F.lit(False))).count() == 0


def test_repeated_rows_stay(spark):
    df = spark.createDataFrame([(1, "a@b.cc")] * 3, "doc_id long, text string").withColumn("pii", F.lit(1))
    assert [r.n_email for r in pii.pii_report(df).collect()] == [1, 1, 1]
    assert [(r.text, r.pii) for r in pii.mask_pii(df).collect()] == [("<email>", 1)] * 3
    assert pii.pii_spans(df).columns == ["doc_id", "text", "pii"]


def test_rows_without_id_or_text(spark):
    df = spark.createDataFrame([(None, "a@b.cc"), (2, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_email, r.spans) for r in pii.pii_report(df).collect()) == [("2", 0, ""), ("None", 1, "email:0:6")]
