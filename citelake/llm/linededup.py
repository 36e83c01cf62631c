"""Removal of passages of lines that repeat across documents, with DataFrame functions
only.

A passage is a long line by itself, or two lines or more of ``MIN_CHARS`` characters or more.
From each line on the shortest such window of lines is hashed, and up to each line the shortest
one that ends with it; both depend on their own lines only, so that documents that share
a passage share the windows that cover it, wherever it stands.  Windows of long lines
only are left out, each line is one by itself.  Windows of more than one document are
compared byte for byte with the first document's and removed; the document with the smallest
doc_id keeps them.  So exactly the lines of all passages that a document with a smaller doc_id
holds go, and nothing needs to be extended.

Defined results: null texts stay null, documents with null doc_id stay as they are and
take no part; rows of equal doc_id and text are one document given twice and are treated
alike; a document whose lines are all removed has the empty text; other columns stay,
``lines_removed`` and ``removed`` (start-end ranges of lines, ends exclusive) are added
and replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.llm._common import materialize

#: A line of as many words (or characters, for scripts without blanks) is a chunk by itself.
LONG_WORDS = 16
LONG_CHARS = 200
#: Least characters of a passage of several lines, line ends between them included.
MIN_CHARS = 40


def _is_long(line: Column) -> Column:
    blanks = F.length(line) - F.length(F.replace(line, F.lit(" ")))
    return (blanks + 1 >= LONG_WORDS) | (F.length(line) >= LONG_CHARS)


def _shortest(lengths: Column, first: Column, second: Column) -> Column:
    """Lines of the shortest window of two lines or more with ``MIN_CHARS``, from lines of ``first``
    and ``second`` characters on through ``lengths``; null if there is none."""
    start = F.struct((first + second + 1).alias("chars"), F.lit(2).alias("len"))
    more = lambda w, n: F.when(w["chars"] >= MIN_CHARS, w).otherwise(F.struct((w["chars"] + n + 1).alias("chars"), (w["len"] + 1).alias("len")))
    found = F.aggregate(lengths, start, more, lambda w: F.when(w["chars"] >= MIN_CHARS, w["len"]))
    return F.when(second.isNull(), None).when(first + second + 1 >= MIN_CHARS, 2).otherwise(found)


def _chunks(lined: DataFrame) -> DataFrame:
    """Windows and long lines: doc_id, _text_hash, start, len, hash.  Each array is
    a column of its own: within a lambda it would be made anew for each element."""
    hashed = lined.select(
        "doc_id",
        "_text_hash",
        F.transform("_lines", lambda x: F.xxhash64(x)).alias("_hashes"),
        F.transform("_lines", lambda x: _is_long(x)).alias("_long"),
        F.transform("_lines", lambda x: F.length(x)).alias("_chars"),
    )
    # each line end counts, so that MIN_CHARS + 1 lines always suffice
    most = MIN_CHARS - 1
    low = lambda i: F.greatest(i - 1 - most, F.lit(0))
    onward = F.transform("_chars", lambda n, i: _shortest(F.slice("_chars", i + 3, F.lit(most)), n, F.get("_chars", i + 1)))
    upto = F.transform("_chars", lambda n, i: _shortest(F.reverse(F.slice("_chars", low(i) + 1, F.greatest(i - 1 - low(i), F.lit(0)))), n, F.get("_chars", i - 1)))
    sized = hashed.select("doc_id", "_text_hash", "_hashes", "_long", onward.alias("_onward"), upto.alias("_upto"))

    def window(start: Column, size: Column) -> Column:
        return F.struct(start.alias("start"), size.alias("len"), F.xxhash64(F.slice("_hashes", start + 1, size)).alias("hash"))

    def has_short(start: Column) -> Column:
        return ~(F.get("_long", start) & F.get("_long", start + 1))

    forward = F.transform("_onward", lambda n, i: F.when(n.isNotNull() & has_short(i), window(i, n)))
    new = lambda n, i: n.isNotNull() & ~F.get("_onward", i + 1 - n).eqNullSafe(n) & has_short(i - 1)
    backward = F.transform("_upto", lambda n, i: F.when(new(n, i), window(i + 1 - n, n)))
    alone = F.transform("_long", lambda x, i: F.when(x, window(i, F.lit(1))))
    every = F.filter(F.concat(forward, backward, alone), lambda c: c.isNotNull())
    return sized.select("doc_id", "_text_hash", F.explode(every).alias("c")).select("doc_id", "_text_hash", "c.start", "c.len", "c.hash")


def removable(docs: DataFrame) -> DataFrame:
    """Ranges of lines to remove, apart from each other: doc_id, _text_hash, ranges array of struct(start, end)."""
    base = docs.select("doc_id", "text").withColumn("_text_hash", F.xxhash64("text")).where("text is not null and doc_id is not null")
    lined = base.withColumn("_lines", F.split("text", "\n", -1))
    chunks = materialize(_chunks(lined), "chunks")
    repeated = (
        chunks.groupBy("hash")
        .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("_last_doc"))
        .where("first_doc < _last_doc")
        .drop("_last_doc")
    )
    by_doc = (
        chunks.join(repeated, "hash")
        .groupBy("doc_id", "_text_hash")
        .agg(F.collect_list(F.struct("start", "len", "hash", "first_doc")).alias("_found"))
    )
    where_ = (
        base.join(by_doc, ["doc_id", "_text_hash"])
        .withColumn("_lines", F.split("text", "\n", -1))
        .select("doc_id", "_text_hash", "_lines", F.explode("_found").alias("c"))
    )
    occurrences = where_.select(
        F.col("c.hash").alias("hash"),
        "doc_id",
        "_text_hash",
        F.col("c.start").alias("start"),
        F.col("c.len").alias("len"),
        (F.col("doc_id") == F.col("c.first_doc")).alias("_is_first"),
        F.array_join(F.slice("_lines", F.col("c.start") + 1, F.col("c.len")), "\n").alias("body"),
    )
    occurrences = materialize(occurrences, "occurrences")
    first = occurrences.where("_is_first").select("hash", "len", "body").distinct()
    # the hot windows' rows lie on one side only; adaptive execution splits them
    same = occurrences.where("not _is_first").join(first, ["hash", "len", "body"])
    ranges = same.select("doc_id", "_text_hash", "start", (F.col("start") + F.col("len")).alias("end"))
    by_place = Window.partitionBy("doc_id", "_text_hash").orderBy("start", "end")
    before = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    apart = ranges.withColumn("_new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    runs = apart.groupBy("doc_id", "_text_hash", "_run").agg(F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("range"))
    return runs.groupBy("doc_id", "_text_hash").agg(F.array_sort(F.collect_list("range")).alias("_ranges"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the passages, and ``lines_removed`` and ``removed``."""
    keep = [c for c in docs.columns if c not in ("lines_removed", "removed")]
    found = removable(docs)
    lined = docs.select(*keep).withColumn("_text_hash", F.xxhash64("text"))
    joined = lined.join(found, ["doc_id", "_text_hash"], "left").withColumn("_lines", F.split("text", "\n", -1))
    kept = F.filter("_lines", lambda x, i: ~F.exists("_ranges", lambda r: (i >= r["start"]) & (i < r["end"])))
    joined = joined.withColumn("_kept", F.when(F.col("_ranges").isNotNull(), kept))
    text = F.when(F.col("_ranges").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n"))
    return joined.select(
        *[F.col(c) if c != "text" else text.alias("text") for c in keep],
        F.when(F.col("_ranges").isNull(), 0).otherwise(F.size("_lines") - F.size("_kept")).cast("long").alias("lines_removed"),
        F.coalesce(F.array_join(F.transform("_ranges", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ","), F.lit("")).alias("removed"),
    )
