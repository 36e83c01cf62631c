"""Text as Column expressions: segments, windows, tokens, similarity, offsets of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EN_SHARE = ("the", "of", "and", "that", "which", "is", "are", "to")
#: Space as the detectors mean it, with the no-break spaces that Java's class leaves out.
SPACE = r"[\s   ]"


def matches(text: Column, pattern: str) -> Column:
    """array of struct(start, end, hit), code points: the gaps between the matches, summed."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

    both = F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    return F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def segments(text: Column) -> Column:
    """Half-open stretches between semicolons: array of struct(start, end)."""
    sizes = F.transform(F.split(text, ";", -1), lambda s: F.length(s))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, n: Column) -> Column:
        one = F.struct(acc["at"].alias("start"), (acc["at"] + n).alias("end"))
        return F.struct((acc["at"] + n + 1).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def context(text: Column, start: Column, end: Column, radius: int = 180) -> Column:
    """The text around a citation, white space collapsed, an ellipsis where it is cut."""
    low, high = F.greatest(start - radius, F.lit(0)), F.least(end + radius, F.length(text))
    inner = F.trim(F.regexp_replace(F.substring(text, low + 1, high - low), f"{SPACE}+", " "))
    return F.concat(F.when(low > 0, "…").otherwise(""), inner, F.when(high < F.length(text), "…").otherwise(""))


def tokens(text: Column) -> Column:
    unified = F.regexp_replace(F.lower(text), "[‐-―]", "-")
    return F.array_distinct(F.regexp_extract_all(unified, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets of tokens; an empty union counts as one element."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def coverage(a: Column, b: Column) -> Column:
    """The share of ``a`` that ``b`` holds."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def english_share(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    known = F.filter(words, lambda w: w.isin(*EN_SHARE))
    return F.when(F.size(words) > 0, F.size(known) / F.size(words)).otherwise(F.lit(0.0))


def plain_text(html: Column) -> Column:
    """Tags away, the commonest entities decoded, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for name, sign in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(sign))
    return F.trim(F.regexp_replace(out, f"{SPACE}+", " "))


def normal_notes(texts: DataFrame, notes: str = "notes") -> DataFrame:
    """One row for each note of ``notes`` (array): note_pos from 1, control characters blanked,
    trimmed; empty ones stay, for positions count."""
    out = texts.select("doc_id", F.posexplode(notes).alias("_p", "text"))
    return out.select("doc_id", (F.col("_p") + 1).alias("note_pos"), F.trim(F.regexp_replace("text", r"[\x00-\x1F\x7F]", " ")).alias("text"))


def levels(numbers: Column, most: int = 8) -> Column:
    """Runs of successive integers, at most ``most``: array of struct(from, to)."""
    ordered = F.array_sort(F.array_distinct(numbers))
    starts = F.filter(ordered, lambda n: ~F.array_contains(ordered, n - 1))
    ends = F.filter(ordered, lambda n: ~F.array_contains(ordered, n + 1))
    return F.slice(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("from"), b.alias("to"))), 1, most)
