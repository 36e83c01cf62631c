"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums (Luhn, mod-97) and ranges confirm them,
and words before a span raise or lower its score.  Nothing runs in Python.

The patterns are possessive and start only where a run of their characters starts,
so that each text is read once even if it holds a run of a million digits.

Defined results: a null text counts as empty and has no spans; equal rows give equal
rows; other columns are dropped by ``pii_digest`` and kept by ``with_pii``, which puts
its own columns last and replaces columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")

PATTERNS = {
    # \G: the run in which the match before ended may go on with another address
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole runs of digits with single separators, of 13 to 19 digits; others would be dropped anyhow
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
}
#: Texts without it can't hold the kind; a cheap test before the patterns.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
CONTEXT = {
    "email": r"(?:e-?mail|contact|write|mailto|correo|courriel)",
    "ip": r"(?:\bip\b|addr|host|server|login)",
    "card": r"(?:card|visa|master|amex|credit|debit|karte|carte|tarjeta)",
    "phone": r"(?:tel|phone|call|mobile|fax|cell|anruf|appel)",
    "iban": r"(?:iban|account|bank|konto|compte|cuenta)",
}
AGAINST = r"(?:version|order|serial|invoice|isbn|ref\.)"
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
WINDOW = 40


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn_ok(hit: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    reversed_ = F.split(F.reverse(_digits(hit)), "")
    doubled = F.transform(
        reversed_,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97_ok(hit: Column) -> Column:
    """Whether the account number's check digits are right (remainder 1 by 97)."""
    plain = F.replace(hit, F.lit(" "))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).when(code >= 48, (acc * 10 + code - 48) % 97).otherwise(acc)

    return F.length(plain).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return luhn_ok(hit)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        return mod97_ok(hit)
    return F.lit(True)


def spans_of(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind: array of struct(kind, start, end, hit), code points,
    end exclusive.  Starts are the lengths of what stands between the matches, summed."""
    pattern = PATTERNS[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    both = F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,hit:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    found = F.filter(F.aggregate(both, zero, step, lambda acc: acc["out"]), lambda s: _valid(kind, s["hit"]))
    return F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(none) if kind in NEEDS else found


def _score(text: Column, s: Column) -> Column:
    """0 to 1: the kind's prior, moved by words shortly before the span."""
    before = F.lower(F.substring(text, F.greatest(s["start"] - WINDOW, F.lit(0)) + 1, F.least(s["start"], F.lit(WINDOW))))
    prior, near = F.lit(0.0), F.lit(False)
    for kind in KINDS:
        prior = F.when(s["kind"] == kind, F.lit(PRIOR[kind])).otherwise(prior)
        near = near | ((s["kind"] == kind) & before.rlike(CONTEXT[kind]))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), prior + F.when(near, 0.1).otherwise(0.0) - F.when(before.rlike(AGAINST), 0.3).otherwise(0.0)))


def with_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: array of struct(kind, start, end, score) of all kinds, by
    kind as in ``KINDS`` and then start."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs
    for kind in KINDS:
        out = out.withColumn(f"_spans_{kind}", spans_of(body, kind))
    every = F.concat(*[F.col(f"_spans_{k}") for k in KINDS])
    scored = F.transform(
        every,
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _score(body, s).alias("score")),
    )
    return out.withColumn("pii", scored).drop(*[f"_spans_{k}" for k in KINDS])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind))


def pii_digest(docs: DataFrame) -> DataFrame:
    """The result columns of the query, one row for each row of ``docs``."""
    found = with_pii(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"] != "iban")
    return found.select(
        "doc_id",
        *[_count(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
