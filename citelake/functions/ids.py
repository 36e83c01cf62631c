"""Identifier algebra as Column expressions: case numbers, CELEX, ECLI, treaty articles.

Nothing here depends on the clock; what a two-digit year means follows ``reference_year``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE_YEAR = 2026
FOUNDED = 1952
GENERAL_COURT = 1989
HYPHENS = "‑–—"
#: A case number: court, number, year, suffix.
CASE = rf"(?<![/A-Za-z0-9_])([CTct])(?:[{HYPHENS}-]\s?)?([0-9]{{1,4}})/([0-9]{{2}})(?![0-9]|[.,][0-9])(?:\s*(?i:(P\(R\)|RENV|DEP|REV|OP|P|R))(?![A-Za-z0-9_(]))?"
ECLI = r"(?<![A-Za-z0-9_])(?i:(?:ECLI:)?EU:([CT]):([0-9]{4}):([0-9]+))(?![A-Za-z0-9_])"

SECTOR = {"C": {"judgment": "CJ", "opinion": "CC", "order": "CO"}, "T": {"judgment": "TJ", "order": "TO"}}
ACT_LETTER = {"directive": "L", "regulation": "R", "règlement": "R", "recommendation": "H", "recommandation": "H"}
TREATY_LETTER = {"tfeu": "E", "tfue": "E", "teu": "M", "tue": "M"}


def _choose(key: Column, table: dict[str, str], otherwise: str | None = None) -> Column:
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def two_digit_year(yy: Column, reference_year: int = REFERENCE_YEAR) -> Column:
    """The latest year with these last digits that isn't after the reference year."""
    candidate = F.lit(reference_year - reference_year % 100) + yy.cast("int")
    return F.when(candidate > reference_year, candidate - 100).otherwise(candidate)


def canonical_case(text: Column) -> Column:
    """``c‑12/07p`` to ``C-12/07 P``; what is no case number only in upper case."""
    trimmed = F.trim(text)
    whole = f"^{CASE}$"
    court, number, year, suffix = (F.regexp_extract(trimmed, whole, i) for i in (1, 2, 3, 4))
    made = F.concat(F.upper(court), F.lit("-"), number, F.lit("/"), year, F.when(suffix != "", F.concat(F.lit(" "), F.upper(suffix))).otherwise(""))
    return F.when(trimmed.rlike(whole), made).otherwise(F.upper(trimmed))


def case_identity(text: Column) -> Column:
    """Court, number and year, whatever the hyphen, leading zeros or suffix."""
    canon = canonical_case(text)
    return F.concat_ws("-", F.substring(canon, 1, 1), F.regexp_extract(canon, "-([0-9]+)/", 1).cast("int").cast("string"), F.regexp_extract(canon, "/([0-9]{2})", 1))


def court_of_ecli(ecli: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(ecli, "(?i)^ECLI:EU:([A-Z]):", 1)), F.lit(""))


def celex_of_case(case: Column, document_type: Column, court: Column | None = None, reference_year: int = REFERENCE_YEAR) -> Column:
    """Null before the court was founded and for opinions of the General Court."""
    canon = canonical_case(case)
    year = two_digit_year(F.nullif(F.regexp_extract(canon, "/([0-9]{2})", 1), F.lit("")), reference_year)
    number = F.regexp_extract(canon, "-([0-9]+)/", 1)
    letter = F.coalesce(court, F.substring(canon, 1, 1)) if court is not None else F.substring(canon, 1, 1)
    sector = F.lit(None).cast("string")
    for k, kinds in SECTOR.items():
        sector = F.when(F.upper(letter) == k, _choose(document_type, kinds)).otherwise(sector)
    return F.when(year >= FOUNDED, F.concat(F.lit("6"), year.cast("string"), sector, F.lpad(number, 4, "0")))


def act_year_number(kind: Column, has_suffix: Column, has_no: Column, first: Column, second: Column, reference_year: int = REFERENCE_YEAR) -> Column:
    """struct(year, number) of an act, null where the order of its numbers stays open."""

    def year(v: Column, low: Column | int) -> Column:
        return F.when((F.length(v) == 4) & v.cast("int").between(low, reference_year), v)

    def old(v: Column) -> Column:
        return F.when((F.length(v) == 2) & v.cast("int").between(58, 98), F.concat(F.lit("19"), v))

    def pair(y: Column, n: Column) -> Column:
        return F.when(y.isNotNull(), F.struct(y.alias("year"), n.alias("number")))

    low = F.when(F.lower(kind).isin("regulation", "règlement"), 2015).otherwise(FOUNDED)
    return (
        F.when(has_suffix & has_no, pair(year(first, FOUNDED), second))
        .when(has_suffix, pair(F.coalesce(year(first, FOUNDED), old(first)), second))
        .when(has_no, pair(F.coalesce(year(second, FOUNDED), old(second)), first))
        .otherwise(pair(year(first, low), second))
    )


def celex_of_act(kind: Column, year: Column, number: Column) -> Column:
    return F.concat(F.lit("3"), year, _choose(F.lower(kind), ACT_LETTER, "D"), F.lpad(number, 4, "0"))


def celex_of_treaty(treaty: Column, article: Column) -> Column:
    return F.concat(F.lit("12016"), _choose(F.lower(treaty), TREATY_LETTER, "P"), F.lpad(article, 3, "0"))


def edit_distance_of_digits(a: Column, b: Column) -> Column:
    return F.levenshtein(F.regexp_replace(a, "[^0-9]", ""), F.regexp_replace(b, "[^0-9]", ""))


def official_url(celex: Column, commission_case: Column, case: Column) -> Column:
    """The page of a document: by CELEX, else the Commission's case, else the court's search."""
    plain = F.replace(F.url_encode(case), F.lit("+"), F.lit("%20"))
    return (
        F.when(celex.isNotNull(), F.concat(F.lit("https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:"), celex))
        .when(commission_case.rlike(r"^(AT|SA|M)\.[0-9]{3,6}$"), F.concat(F.lit("https://competition-cases.ec.europa.eu/cases/"), commission_case))
        .when(case.isNotNull(), F.concat(F.lit("https://curia.europa.eu/juris/liste.jsf?num="), plain))
    )


def valid_lookup(value: Column, celex: Column, ecli: Column, case: Column, paragraphs: Column) -> Column:
    """Whether a lookup's fields are within their shapes and limits; nulls are left out."""
    return (
        F.coalesce(F.length(value).between(1, 500), F.lit(False))
        & (celex.isNull() | celex.rlike("^[0-9][0-9]{4}[A-Z]{1,2}[0-9]{3,4}$"))
        & (ecli.isNull() | ecli.rlike("^ECLI:EU:[A-Z]:[0-9]{4}:[0-9]+$"))
        & (case.isNull() | (F.length(case) <= 40))
        & (paragraphs.isNull() | ((F.size(paragraphs) <= 2000) & F.forall(paragraphs, lambda p: p.between(0, 1_000_000))))
    )
