"""Notes out of body text and HTML, as Column expressions and windows: one row for each note,
numbered before anything is filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.functions.text import plain_text
from citelake.operators.windows import last_numbering

#: A typed note: up to three digits, blank, a capital or a quotation mark.
TYPED = r"^([0-9]{1,3})[ \t ]+([A-Z“‘\"'](?s:.*))$"
BREAKS = r"[\r\n\u000b\f  ]"
SHORTEST, LONGEST = 30, 2000
SPAN_SHORTEST, SPAN_LONGEST = 8, 600
MODERN = r"(?is)<p class=\"(?:coj-|oj-)?note\"[^>]*>(.*?)</p>"
PARAGRAPH = r"(?is)<p[ >].*?</p>"
GENUINE = r"(?i)<!--\s*(?:CONVEX|fmx2xhtml)(?![A-Za-z0-9_])|class=\"(?:coj-|note)|<meta\s+name=\"DC\.title\"\s+content=\"EUR-Lex(?![A-Za-z0-9_])"


def paragraphs(body: Column) -> Column:
    return F.transform(F.split(body, BREAKS, -1), lambda p: F.trim(p))


def typed_notes(docs: DataFrame, body: str = "body") -> DataFrame:
    """doc_id, place, note_label, text: paragraphs that read as typed notes of fair length."""
    rows = docs.select("doc_id", F.posexplode(paragraphs(F.col(body))).alias("place", "p")).where(F.col("p").rlike(TYPED))
    rows = rows.select("doc_id", "place", F.regexp_extract("p", TYPED, 1).cast("int").alias("note_label"), F.regexp_extract("p", TYPED, 2).alias("text"))
    return rows.where(F.length("text").between(SHORTEST, LONGEST))


def prose(body: Column) -> Column:
    """The paragraphs that are neither empty nor typed notes."""
    return F.filter(paragraphs(body), lambda p: (p != "") & ~p.rlike(TYPED))


def bracketed(text: Column) -> Column:
    """Outermost balanced brackets' insides of fair length that hold a letter."""
    steps = F.transform(F.split(text, ""), lambda c: F.when(c == "(", 1).when(c == ")", -1).otherwise(0))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("start"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        opens = (c == 1) & (acc["depth"] == 0)
        closes = (c == -1) & (acc["depth"] == 1)
        found = F.struct(acc["start"].alias("start"), acc["at"].alias("end"))
        return F.struct(
            F.greatest(acc["depth"] + c, F.lit(0)).alias("depth"),
            (acc["at"] + 1).alias("at"),
            F.when(opens, acc["at"] + 1).otherwise(acc["start"]).alias("start"),
            F.when(closes, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"),
        )

    spans = F.aggregate(steps, zero, step, lambda acc: acc["out"])
    inner = F.transform(spans, lambda s: F.trim(F.substring(text, s["start"] + 1, s["end"] - s["start"])))
    return F.filter(inner, lambda s: F.length(s).between(SPAN_SHORTEST, SPAN_LONGEST) & s.rlike("[A-Za-z]"))


def is_genuine(html: Column) -> Column:
    return F.coalesce(html.rlike(GENUINE), F.lit(False))


def html_notes(docs: DataFrame, html: str = "html") -> DataFrame:
    """doc_id, note_pos, text of marked-up notes; markers such as (1) are left out, and notes
    whose marker isn't a number are skipped."""
    marker = r"(?is)^\s*(?:\(\s*<span class=\"(?:coj-)?note\"[^>]*>.*?</span>\s*\)|<a[^>]*>.*?</a>\s*[).–-]*)"
    star = r"(?is)^\s*<a[^>]*>\s*\(?\s*<span class=\"oj-super\"[^>]*>(?!\s*[0-9]+\s*<)[^<]*</span>"
    rows = docs.where(is_genuine(F.col(html))).select("doc_id", F.posexplode(F.regexp_extract_all(html, F.lit(MODERN), F.lit(1))).alias("place", "inner"))
    rows = rows.where(~F.col("inner").rlike(star)).select("doc_id", "place", plain_text(F.regexp_replace("inner", marker, "")).alias("text")).where("text <> ''")
    order = Window.partitionBy("doc_id").orderBy("place")
    return rows.select("doc_id", F.row_number().over(order).alias("note_pos"), "text")


def legacy_notes(docs: DataFrame, html: str = "html", least: int = 10) -> DataFrame:
    """doc_id, note_pos, text of ``(n) text`` paragraphs: the last run that starts anew."""
    shape = r"^\(([0-9]{1,4})\)\s+(.+)$"
    rows = docs.select("doc_id", F.posexplode(F.regexp_extract_all(html, F.lit(PARAGRAPH), F.lit(0))).alias("place", "p"))
    rows = rows.select("doc_id", "place", plain_text(F.col("p")).alias("t")).where(F.col("t").rlike(shape))
    rows = rows.select("doc_id", "place", F.regexp_extract("t", shape, 1).cast("int").alias("number"), F.regexp_extract("t", shape, 2).alias("text"))
    # the first paragraph counts as a start only where the numbers start anew later
    order = Window.partitionBy("doc_id").orderBy("place")
    marked = rows.withColumn("_anew", F.col("number") <= F.coalesce(F.lag("number").over(order), F.lit(0)))
    some = marked.withColumn("_some", F.max("_anew").over(Window.partitionBy("doc_id"))).where("_some").drop("_anew", "_some")
    kept = last_numbering(some, "doc_id", "place", "number", least)
    return kept.select("doc_id", F.row_number().over(order).alias("note_pos"), "text")


def body_lines(items: DataFrame) -> DataFrame:
    """Lines of (doc_id, page, y, x, str, size) at or above the most frequent size, in order."""
    lines = items.groupBy("doc_id", "page", F.round("y").alias("row")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "str"))), lambda i: i["str"]), "").alias("line"), F.max("size").alias("size"), F.sum(F.length("str")).alias("chars")
    )
    sizes = lines.groupBy("doc_id", "size").agg(F.count("*").alias("n"), F.min(F.struct("page", (-F.col("row")).alias("r"))).alias("first"))
    body = sizes.groupBy("doc_id").agg(F.min_by("size", F.struct((-F.col("n")).alias("m"), "first")).alias("body"))
    return lines.join(body, "doc_id").where(F.col("size") >= F.col("body")).select("doc_id", "page", "row", "line")


def register(rows: DataFrame, case: str = "case_key", json: str = "json") -> DataFrame:
    """Decisions of a case register: case_key, url, description, language, document_date.

    Attachments lie at any depth; each is an object with ``attachmentLink``.  The walk needs
    recursion, which SQL on variants lacks, and runs on one case at a time."""
    import json as parser
    from collections.abc import Iterator

    import pyarrow as pa

    def decoded(value):
        for item in value if isinstance(value, list) else [value]:
            if isinstance(item, str) and item.strip()[:1] in ("{", "["):
                try:
                    item = parser.loads(item)
                except ValueError:
                    pass
            yield item

    def label(value):
        for item in decoded(value):
            out = item if isinstance(item, str) else (item.get("label", item.get("code")) if isinstance(item, dict) else None)
            if isinstance(out, str) and out:
                return out
        return None

    def walk(node):
        if isinstance(node, list):
            for x in node:
                yield from walk(x)
        elif isinstance(node, dict):
            if "attachmentLink" in node:
                yield node
            for value in node.values():
                for x in decoded(value):
                    if isinstance(x, dict | list):
                        yield from walk(x)

    def described(a):
        category = label(a.get("attachmentCategory"))
        if category:
            return category if any(w in ("decision", "decisions") for w in "".join(c if c.isalnum() else " " for c in category.lower()).split()) else None
        if label(a.get("metadataType")) != "METADATA_DECISION_ATTACHMENT":
            return None
        name = label(a.get("attachmentName"))
        return (name.split(" - ")[0].strip() or name) if name else "Decision"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    tree = parser.loads(text) if text else None
                except ValueError:
                    continue  # no JSON: the case has no decisions
                seen = set()
                for a in walk(tree):
                    url, what = label(a.get("attachmentLink")), described(a)
                    if what and url and url.startswith("https://") and url.lower().endswith(".pdf") and url not in seen:
                        seen.add(url)
                        out.append((key, url, what, label(a.get("attachmentLanguage")), label(a.get("attachmentDocumentDate"))))
            yield pa.record_batch([pa.array([r[i] for r in out], pa.string()) for i in range(5)], names=["case_key", "url", "description", "language", "document_date"])

    return rows.select(F.col(case).cast("string"), json).mapInArrow(run, "case_key string, url string, description string, language string, document_date string")
