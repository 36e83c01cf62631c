"""Audits of a reading against a key: alignment of notes, outcomes, markers, blind samples."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIMILAR, WITHIN = 0.5, 0.85


def token_set(text: str | None) -> frozenset[str]:
    return frozenset(re.findall(r"[^\W_]+", re.sub("[‑–—]", "-", (text or "").lower())))


def _jaccard(a: frozenset, b: frozenset) -> float:
    shared = len(a & b)
    return shared / max(1, len(a) + len(b) - shared)


def aligned(published: list[tuple[int, str]], ours: list[tuple[int, str, bool]]) -> list[tuple[int, int | None, str]]:
    """Which of our notes is which published one: (number, place or none, how).

    Footnotes are in the same order on both sides, so the best monotone alignment is taken;
    what was found in the body follows by its text alone; and a note still left may be part of
    the one before it."""
    want = [token_set(t) for _, t in published]
    have = [token_set(t) for _, t, _ in ours]
    ordered = [j for j, o in enumerate(ours) if o[2]]
    gain = np.zeros((len(want) + 1, len(ordered) + 1))
    how = np.zeros(gain.shape, np.int8)
    for i in range(1, len(want) + 1):
        for k in range(1, len(ordered) + 1):
            s = _jaccard(want[i - 1], have[ordered[k - 1]])
            options = (gain[i - 1, k - 1] + (s if s >= SIMILAR else -1), gain[i - 1, k], gain[i, k - 1])
            how[i, k] = max(range(3), key=lambda o: (options[o], -o))
            gain[i, k] = options[how[i, k]]
    place: dict[int, int] = {}
    i, k = len(want), len(ordered)
    while i and k:
        if how[i, k] == 0:
            place[i - 1] = ordered[k - 1]
        i, k = i - (how[i, k] != 2), k - (how[i, k] != 1)
    kind = dict.fromkeys(place, "order")
    for j in (j for j, o in enumerate(ours) if not o[2]):
        rest = [(_jaccard(w, have[j]), -i) for i, w in enumerate(want) if i not in place]
        if rest and max(rest)[0] >= SIMILAR:
            place[-max(rest)[1]], kind[-max(rest)[1]] = j, "text"
    for i, w in enumerate(want):
        before = place.get(i - 1)
        if i not in place and before is not None and len(w & have[before]) / max(1, len(w)) >= WITHIN:
            place[i], kind[i] = before, "merged"
    return [(number, ours[place[i]][0] if i in place else None, kind.get(i, "lost")) for i, (number, _) in enumerate(published)]


def alignment(published: DataFrame, ours: DataFrame) -> DataFrame:
    """(doc_id, number, note_pos, how) for published (doc_id, number, text) and read notes
    (doc_id, note_pos, text, in_order); one document at a time."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.sort_by("number"), b.sort_by("note_pos")
        want = list(zip(a["number"].to_pylist(), a["text"].to_pylist(), strict=True))
        have = list(zip(*(b[c].to_pylist() for c in ("note_pos", "text", "in_order")), strict=True))
        found = aligned(want, have)
        columns = [pa.array([a["doc_id"][0].as_py()] * len(found) if found else [], pa.int64())]
        columns += [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.table(columns, names=["doc_id", "number", "note_pos", "how"])

    left = published.select("doc_id", F.col("number").cast("long").alias("number"), "text")
    right = ours.select("doc_id", F.col("note_pos").cast("long").alias("note_pos"), "text", "in_order")
    return left.groupBy("doc_id").cogroup(right.groupBy("doc_id")).applyInArrow(run, "doc_id long, number long, note_pos long, how string")


def latest_established(rows: DataFrame, keys: list[str], idx: str, pin: str) -> DataFrame:
    """Each authority of a note once, with its latest place and pinpoint."""
    return rows.groupBy(*keys).agg(F.max(idx).alias(idx), F.max_by(pin, F.struct(idx, pin)).alias(pin))


def outcome_counts(rows: DataFrame, outcome: str) -> DataFrame:
    return rows.groupBy(F.col(outcome).alias("outcome")).agg(F.count("*").alias("n"))


def two_markers(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """What two markers of the same rows agree on: rows, share."""
    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    return both.agg(F.count("*").alias("n"), F.avg(F.col("_a").eqNullSafe(F.col("_b")).cast("double")).alias("agreement"))


def outstanding(rows: DataFrame, group: str, note: str, named: int = 12) -> DataFrame:
    """Notes that wait for a decision: the first ``named`` of them, and how many more.  The
    list is cut before it is collected."""
    order = Window.partitionBy(group).orderBy(note)
    placed = rows.select(group, note).withColumn("_k", F.row_number().over(order))
    some = F.array_sort(F.collect_list(F.when(F.col("_k") <= named, F.col(note))))
    return placed.groupBy(group).agg(some.alias("notes"), F.greatest(F.count("*") - named, F.lit(0)).alias("more"))


def blind(sheet: DataFrame, stratum: str, key: str, size: int, seed: int) -> DataFrame:
    """A second, blind draw: each stratum in proportion to its share of the sheet."""
    shares = sheet.groupBy(stratum).agg(F.count("*").alias("_n"))
    total = shares.agg(F.sum("_n").alias("_all"))
    shares = shares.join(F.broadcast(total)).select(stratum, F.floor(F.lit(size) * F.col("_n") / F.col("_all") + 0.5).alias("share"))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    placed = sheet.withColumn("draw", F.row_number().over(Window.partitionBy(stratum).orderBy(draw, key)))
    return placed.join(shares, stratum).where(F.col("draw") <= F.col("share"))


def promoted(queue: DataFrame, group: str, first: Column, seq: str) -> DataFrame:
    """Order of a queue after the focused note's targets moved ahead, others as they were."""
    order = Window.partitionBy(group).orderBy(F.coalesce(first, F.lit(False)).desc(), seq)
    return queue.withColumn("turn", F.row_number().over(order))


def newest(landed: DataFrame, keys: list[str], when: str, tie: str) -> DataFrame:
    """The store's rows after all landings: the newest of each key, named by its hash."""
    named = landed.withColumn("name", F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]), 256))
    return named.groupBy("name", *keys).agg(F.max(F.struct(when, tie)).alias("_last")).select("name", *keys, f"_last.{when}", f"_last.{tie}")


def read_or_skipped(manifest: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """Every entry of the manifest, with the reason where its document is absent."""
    here = available.select(key).distinct().withColumn("_here", F.lit(True))
    return manifest.join(here, key, "left").withColumn("skipped", F.when(F.col("_here").isNull(), "not available")).drop("_here")
