"""Provisions cut out of an act's HTML: recital, article, paragraph, lettered point."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.operators.passages import bounded

# fixed values: how acts mark their parts
ARTICLE = re.compile(r"<p[^>]*>\s*Article\s+([0-9]+)\s*</p>", re.I)
RECITAL = re.compile(r"<p[^>]*>\s*\(\s*([0-9]+)\s*\)", re.I)
PARAGRAPH = re.compile(r"<p[^>]*>\s*([0-9]+)\.\s", re.I)
NUMBERED = re.compile(r"<p[^>]*>\s*\(([0-9]+)\)", re.I)
LETTERED = re.compile(r"<p[^>]*>\s*\(([a-z]{1,3})\)", re.I)
DIVISION = re.compile(r"<p[^>]*>\s*(?:CHAPTER|SECTION|TITLE|PART)\s+[IVXLC0-9]+", re.I)


def plain(html: str) -> str:
    return re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", " ", html))).strip()


def part(html: str, heading: re.Pattern, first: int, last: int | None = None) -> str | None:
    """From the heading ``first`` up to the next one whose number is beyond ``last``."""
    marks = [(int(m[1]), m.start()) for m in heading.finditer(html)]
    start = next((at for n, at in marks if n == first), None)
    if start is None:
        return None
    return html[start : next((at for n, at in marks if at > start and n > (last or first)), len(html))]


def lettered(html: str, letter: str) -> str | None:
    marks = [(m[1].lower(), m.start()) for m in LETTERED.finditer(html)]
    at = next((i for i, m in enumerate(marks) if m[0] == letter.lower()), None)
    return None if at is None else html[marks[at][1] : marks[at + 1][1] if at + 1 < len(marks) else len(html)]


def provision(html: str, kind: str, start: int, paragraph: int | None = None, point: str | None = None, end: int | None = None) -> str | None:
    """The narrowest cited part that is found; nothing if the article or recital isn't."""
    if kind == "point":
        found = part(html, RECITAL, start, end)
        return plain(found) if found else None
    article = part(html, ARTICLE, start, end)
    if article is None:
        return None
    division = DIVISION.search(article, 1)
    article = article[: division.start()] if division else article
    inner = (part(article, PARAGRAPH, paragraph) or part(article, NUMBERED, paragraph)) if paragraph else article
    if inner is None:
        return plain(article)
    return plain((lettered(inner, point) if point else None) or inner)


def provisions(rows: DataFrame) -> DataFrame:
    """Rows (key, html, kind, start, paragraph, point, end) to key, passage, excerpt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            args = zip(*(batch.column(c).to_pylist() for c in ("html", "kind", "start", "paragraph", "point", "end")), strict=True)
            found = [provision(*a) if a[0] and a[2] is not None else None for a in args]
            kinds = ["cited" if f else "opening" if h else None for f, h in zip(found, batch.column("html").to_pylist(), strict=True)]
            texts = [bounded(f) if f else plain(h)[:900] if h else None for f, h in zip(found, batch.column("html").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("key"), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=["key", "passage", "excerpt"])

    return rows.select(F.col("key").cast("string").alias("key"), "html", "kind", "start", "paragraph", "point", "end").mapInArrow(run, "key string, passage string, excerpt string")
