"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

All of it is DataFrame functions: Java regular expressions find the matches of a
kind and the gaps between them, and positions are sums of their lengths.
Patterns are written so that each runs in time linear in the text, whatever the
text (possessive repeats; a start is only tried where a run begins).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Positions are summed over blocks of so many matches.
BLOCK = 256
#: Context words are looked for in so many characters before a match, back to the match before it of that kind at most.
CONTEXT_CHARS = 48
#: An added span is reported from this score on.
LEAST_SCORE = 0.5


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    base: reported whenever it is valid. score: that of a valid match without
    context; a context word within CONTEXT_CHARS before it adds 0.3.
    """

    name: str
    pattern: str
    base: bool
    score: float
    context: str
    needs: str = ""


# The patterns of the base kinds.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, 0.7, r"e-?mail|contact|write to|mailto", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True, 0.5, r"\bip\b|address|host|server|client"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", True, 0.6, r"card|visa|credit|debit|payment|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True, 0.6, r"phone|call|tel|mobile|fax|whatsapp|anruf", "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", False, 0.6, r"iban|account|konto|cuenta|compte"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", False, 0.3, r"ssn|social security|tax id|national id", "-"),
    Kind("local_phone", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", False, 0.3, r"phone|call|tel|mobile|fax|reach"),
)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(2 * d - 9 * (d > 4)) for d in range(10)]), c.cast("int") + 1)),
    )
    return F.aggregate(F.filter(values, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether a bank account code without spaces leaves 1 after its first four characters move to the end, modulo 97."""
    turned = F.concat(F.substr(code, F.lit(5)), F.left(code, F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(v < 10, (rest * 10 + v) % 97).otherwise((rest * 100 + v) % 97).cast("int")

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.ltrim(p, F.lit("0")).try_cast("int")), F.lit(0)) <= 255))
    if kind == "card":
        n = F.length(_digits(hit))
        return F.when(n.between(13, 19), luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        code = F.replace(hit, F.lit(" "), F.lit(""))
        return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)
    if kind == "national_id":
        return ~hit.rlike(r"^(?:000|666|9..)-|-00-|-0000$")
    return F.lit(True)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, v: a + v)


def _step_lengths(hits: Column, gaps: Column) -> Column:
    """How far each match and the gap before it move on."""
    return F.transform(hits, lambda h, i: F.char_length(gaps[i]) + F.char_length(h))


def _block_starts(lengths: Column) -> Column:
    """The sum of the lengths before each block."""
    return F.aggregate(
        F.sequence(F.lit(0), F.floor(F.size(lengths) / BLOCK).cast("int")),
        F.array(F.lit(0)),
        lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + _total(F.slice(lengths, b * BLOCK + 1, BLOCK)))),
    )


def pii_spans(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: array of (kind, start, end, score) by kind as in KINDS, then start; a column of that name gives way.

    Positions are code points, the end exclusive. Null and empty texts have an
    empty array; a base kind's spans are its valid matches, others need
    LEAST_SCORE. Columns of ``docs`` stay; helper columns are named ``__pii_*``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [c for c in docs.columns if c != out]
    df = docs.withColumns({
        f"__pii_h_{k.name}": F.when(F.contains(text, F.lit(k.needs)) if k.needs else F.lit(True), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)))
        for k in KINDS
    })
    hits = {k.name: F.col(f"__pii_h_{k.name}") for k in KINDS}
    some = {k: F.size(c) > 0 for k, c in hits.items()}
    df = df.withColumns({f"__pii_g_{k.name}": F.when(some[k.name], F.split(text, k.pattern, -1)) for k in KINDS})
    gaps = {k.name: F.col(f"__pii_g_{k.name}") for k in KINDS}
    df = df.withColumns({
        f"__pii_l_{k.name}": F.when(some[k.name], _step_lengths(hits[k.name], gaps[k.name]))
        for k in KINDS
    })
    lens = {k.name: F.col(f"__pii_l_{k.name}") for k in KINDS}
    df = df.withColumns({
        f"__pii_b_{k.name}": F.when(
            some[k.name],
            _block_starts(lens[k.name]),
        )
        for k in KINDS
    })

    def spans(k: Kind) -> Column:
        gap, length, base = gaps[k.name], lens[k.name], F.col(f"__pii_b_{k.name}")

        def span(hit: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            start = base[block] + _total(F.slice(length, block * BLOCK + 1, i % BLOCK)) + F.char_length(gap[i])
            near = F.right(gap[i], F.lit(CONTEXT_CHARS)).rlike(f"(?i){k.context}")
            return F.struct(
                F.lit(k.name).alias("kind"), start.cast("long").alias("start"), (start + F.char_length(hit)).cast("long").alias("end"),
                (F.lit(k.score) + F.when(near, F.lit(0.3)).otherwise(F.lit(0.0))).alias("score"), _valid(k.name, hit).alias("ok"),
            )

        least = 0.0 if k.base else LEAST_SCORE
        made = F.filter(F.transform(hits[k.name], span), lambda s: s.ok & (s.score >= least))
        plain = F.transform(made, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.score.alias("score")))
        empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
        return F.when(some[k.name], plain).otherwise(empty)

    df = df.withColumns({f"__pii_s_{k.name}": spans(k) for k in KINDS})
    return df.select(*[df[c] for c in own], F.concat(*[F.col(f"__pii_s_{k.name}") for k in KINDS]).alias(out))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, any others): counts of the base kinds, their digest, and all spans.

    Null counts as empty. Repeated rows give repeated rows, rows without a doc_id
    a row without one, and an empty table an empty result.
    """
    base = [k.name for k in KINDS if k.base]
    found = pii_spans(docs.select("doc_id", "text"))
    found = found.withColumn("of_base", F.filter("pii", lambda s: s.kind.isin(base)))
    count = lambda k: F.size(F.filter("of_base", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(joined(F.col("of_base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.aggregate("pii", F.lit(0.0), lambda a, s: F.greatest(a, s.score)).alias("top_score"),
    )


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace each span by its kind in angle brackets; overlapping spans are masked as one, named by the first."""
    found = pii_spans(docs, text_col, "__pii_found")
    text = F.coalesce(F.col(text_col), F.lit(""))
    ordered = F.array_sort(F.col("__pii_found"), lambda a, b: F.when(a.start < b.start, -1).when(a.start > b.start, 1).when(a.end > b.end, -1).when(a.end < b.end, 1).otherwise(0))
    done = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.struct(
            F.greatest(acc.at, s.end).alias("at"),
            F.when(s.start >= acc.at, F.concat(acc.parts, F.array(F.substr(text, (acc.at + 1).cast("int"), (s.start - acc.at).cast("int")), F.concat(F.lit("<"), s.kind, F.lit(">"))))).otherwise(acc.parts).alias("parts"),
        ),
        lambda acc: F.concat(F.array_join(acc.parts, ""), F.substr(text, (acc.at + 1).cast("int"))),
    )
    return found.select(*[found[c] for c in docs.columns if c != text_col], F.when(F.size("__pii_found") > 0, done).otherwise(F.col(text_col)).alias(text_col)).select(*docs.columns)
