"""What a reviewer is shown, as Column expressions: labels, keys, dates, names, predicates."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from citelake.functions.text import levels
from citelake.operators.detect import MONTHS
from citelake.operators.passages import GAP

# fixed values: month names as written, words that name no party, headings of court documents
MONTH_NAMES = [name.capitalize() for name in list(MONTHS)[:12]]
GENERIC_WORDS = (
    "and the of for de des du la le les et und der die y e jv ag sa se nv bv plc inc ltd llc spa gmbh co corp group holding holdings business businesses art article procedure joint venture"
).split()
HEADINGS = {
    "opinion": r"\bOPINION OF (?:MR |MRS |MS )?ADVOCATE[\s-]GENERAL\b|\bCONCLUSIONS DE (?:L['’]|M\. L['’]|MME L['’])AVOCAT",
    "order": r"\bORDER OF THE (?:COURT|GENERAL COURT|PRESIDENT|VICE-PRESIDENT)\b|\bORDONNANCE (?:DU|DE LA)\b",
    "judgment": r"\bJUDGMENT OF THE (?:COURT|GENERAL COURT)\b|\bARRÊT (?:DE LA COUR|DU TRIBUNAL)\b",
}


def _plain_letters() -> dict[str, str]:
    """Latin letters with marks to the letters without them, from their decompositions."""
    out = {}
    for code in range(0xC0, 0x250):
        first, *marks = unicodedata.normalize("NFKD", chr(code))
        if marks and all(unicodedata.combining(m) for m in marks):
            out[chr(code)] = first
    return out


PLAIN = _plain_letters()


def type_label(kind: Column, otherwise: Column) -> Column:
    return F.when(kind == "opinion", "CJEU Advocate General opinion").when(kind == "order", "CJEU order").otherwise(otherwise)


def description(value: Column, name: Column, case: Column, kind: Column, ecli: Column, celex: Column, is_back: Column) -> Column:
    """What to call a document: its name, its number, for back-references an identifier."""
    qualifier = F.when(kind != "judgment", F.concat(F.lit(" ("), kind, F.lit(")"))).otherwise("")
    numbered = F.concat(name, F.coalesce(F.concat(F.lit(", "), case), F.lit("")), qualifier)
    return F.coalesce(numbered, F.concat(case, qualifier), F.when(is_back, F.coalesce(ecli, celex)), value)


def candidate_key(celex: Column, ecli: Column, case: Column, kind: Column, name: Column) -> Column:
    return F.coalesce(celex, ecli, F.when(case.isNotNull(), F.concat_ws(":", case, kind)), name, F.lit("unknown"))


def confirmation_key(value: Column, note: Column, idx: Column, is_back: Column) -> Column:
    """A name means one thing in a document; a back-reference only at its place."""
    return F.when(is_back, F.concat_ws("-", note, idx, value)).otherwise(F.lower(value))


def passages_of(excerpt: Column) -> Column:
    return F.filter(F.transform(F.split(excerpt, GAP, -1), lambda p: F.trim(p)), lambda p: p != "")


def written_date(date: Column) -> Column:
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    return F.concat_ws(" ", F.dayofmonth(date).cast("string"), F.element_at(names, F.month(date)), F.year(date).cast("string"))


def read_date(text: Column) -> Column:
    """``24 March 2004`` or ``1er août 1999`` as YYYY-MM-DD; null if it is no such date."""
    shape = r"(?iu)^\s*([0-9]{1,2})(?:er|st|nd|rd|th)?\s+(\p{L}+)\s+([0-9]{4})\s*$"
    month = F.try_element_at(F.create_map(*[F.lit(x) for item in MONTHS.items() for x in item]), F.lower(F.regexp_extract(text, shape, 2)))
    day = F.lpad(F.regexp_extract(text, shape, 1), 2, "0")
    return F.when(month.isNotNull() & day.between("01", "31"), F.concat_ws("-", F.regexp_extract(text, shape, 3), F.lpad(month.cast("string"), 2, "0"), day))


def loose_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def name_words(name: Column) -> Column:
    """Words of a case name worth comparing: no marks, no numbers, none that names no party."""
    plain = F.lower(F.regexp_replace(F.translate(name, "".join(PLAIN), "".join(PLAIN.values())), r"\p{M}", ""))
    return F.filter(F.split(plain, "[^a-z0-9]+", -1), lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$") & ~w.isin(*GENERIC_WORDS))


def names_agree(name: Column, title: Column) -> Column:
    """Whether any word of the name is in the title, or, if long, within its joined words."""
    words, has = name_words(name), name_words(title)
    joined = F.array_join(has, "")
    return (F.size(words) == 0) | F.exists(words, lambda w: F.array_contains(has, w) | ((F.length(w) >= 5) & F.contains(joined, w)))


def resolution_code(method: Column, cited_in: Column, agrees: Column) -> Column:
    """How a resolved citation was read, and whether its own cross-reference is wrong."""
    wrong = cited_in.isNotNull() & ~F.coalesce(agrees, F.lit(False))
    return F.concat(F.coalesce(method, F.lit("stated")), F.when(wrong, "+wrong_cross_reference").otherwise(""))


def open_code(status: Column, mismatch: Column, back_note: Column, is_back: Column, candidates: Column) -> Column:
    """Why a citation waits for the reviewer; null for resolved ones."""
    several = F.coalesce(F.size(candidates), F.lit(0)) > 0
    return (
        F.when(status == "resolved", F.lit(None).cast("string"))
        .when(mismatch.isNotNull(), F.concat(mismatch, F.lit("_of_a_judgment")))
        .when(status == "unconfirmed_suggestion", "suggested")
        .when(is_back & several, "back_to_several")
        .when(is_back & back_note.isNotNull(), "back_to_nothing")
        .when(is_back, "nothing_before")
        .when(several, "several_fit")
        .otherwise("undefined")
    )


def needs_review(statuses: Column) -> Column:
    return F.exists(statuses, lambda s: s != "resolved")


def only_choice(citations: Column) -> Column:
    return F.size(citations) == 1


def source_changed(before: Column, after: Column) -> Column:
    """Whether shown documents (array of struct url, excerpt, passage) differ."""
    differ = F.exists(F.zip_with(before, after, lambda a, b: a.eqNullSafe(b)), lambda same: ~same)
    return (F.size(before) != F.size(after)) | differ


def is_listed(text: Column, in_text: Column, citations: Column) -> Column:
    return (F.trim(text) != "") & (~in_text | (citations > 0))


def heading_type(text: Column) -> Column:
    """The kind of a court document by the first heading in its first 30,000 characters."""
    head = F.substring(text, 1, 30_000)
    places = [F.struct(F.nullif(F.regexp_instr(head, F.lit(p)), F.lit(0)).alias("at"), F.lit(kind).alias("kind")) for kind, p in HEADINGS.items()]
    found = F.filter(F.array(*places), lambda p: p["at"].isNotNull())
    return F.get(F.array_sort(found), F.lit(0))["kind"]


def heading_names(text: Column, name: Column) -> Column:
    """Whether all words of four letters or more of a name stand in a document's opening."""
    opening = F.lower(F.substring(text, 1, 6000))
    words = F.regexp_extract_all(F.lower(name), F.lit(r"\p{L}{4,}"), F.lit(0))
    return (F.size(words) > 0) & F.forall(words, lambda w: F.contains(opening, w))


def is_extract(html: Column) -> Column:
    """Whether numbered points are missing: the last number is beyond their count."""
    numbers = F.transform(F.regexp_extract_all(html, F.lit('id="point([0-9]+)"'), F.lit(1)), lambda n: n.cast("int"))
    return (F.size(numbers) > 0) & (F.array_max(numbers) > F.size(numbers))


def numbering_length(numbers: Column) -> Column:
    """How far numbers in order of place count 1, 2, 3."""
    return F.aggregate(numbers, F.lit(0), lambda acc, n: F.when(n == acc + 1, n).otherwise(acc))


def longest_spans(spans: Column) -> Column:
    """Spans (array of struct start, end) that don't overlap: from the left, the longest first."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"))))
    zero = F.struct(F.lit(-1).cast("int").alias("upto"), F.array().cast("array<struct<start:int,end:int>>").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        one = F.struct(s["start"].cast("int").alias("start"), (-s["back"]).cast("int").alias("end"))
        return F.when(s["start"] >= acc["upto"], F.struct(one["end"].alias("upto"), F.concat(acc["kept"], F.array(one)).alias("kept"))).otherwise(acc)

    return F.aggregate(order, zero, step, lambda acc: acc["kept"])


def compressed(numbers: Column) -> Column:
    """``4-6, 9`` from integers in any order."""
    parts = F.transform(levels(numbers, 1_000_000), lambda r: F.when(r["from"] == r["to"], r["from"].cast("string")).otherwise(F.concat(r["from"], F.lit("-"), r["to"])))
    return F.array_join(parts, ", ")


def pins_compared(cited: Column, reported: Column) -> Column:
    """struct(wrong, missing): reported but not cited, cited but not reported."""
    return F.struct(compressed(F.array_except(reported, cited)).alias("wrong"), compressed(F.array_except(cited, reported)).alias("missing"))
