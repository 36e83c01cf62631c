"""Shards of equal counts that keep linked documents together: balanced label propagation.

Documents are linked when their texts are equal.  Each starts in a shard by its hash.  In
each round, by joins, every linked document asks to move to the shard where most of
its group is; a shard takes at most its quota, and the unlinked documents, which any
shard can have, make room.  A group larger than a share of the quota is split into chunks of
that share first, each a group of its own.  At last all documents are numbered by
shard, group and doc_id, and the numbers are cut into equal ranges, which differ from the
propagated shards by the few documents by which these miss their quotas.

The law is ``rows``: counts differ by one at most.  Requests and counts are summed by pairs
of shards before the driver sees them (24 x 24 numbers, whatever the corpus).

Defined results: a null text has size 8 and the checksum of the empty text, and is
linked with nothing; rows with equal doc_id are rows of their own; any table of fewer
rows than shards fills the first ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.llm._common import materialize, ranked, release

SHARDS = 24
ROUNDS = 6
#: Largest part of a shard's quota that one group fills.
SHARE = 0.25


def _draw(*columns: Column) -> Column:
    """A number in [0, 1) that the columns decide."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _accepted(asks: dict[tuple[int, int], int], fixed: dict[int, int], quota: float, shards: int) -> list[tuple[int, int, float]]:
    """(from, to, share accepted): what a shard's linked documents leave of its quota."""
    out = []
    for to in range(shards):
        asked = sum(n for (_, t), n in asks.items() if t == to)
        if asked:
            room = max(0.0, quota - fixed.get(to, 0))
            out += [(s, to, min(1.0, room / asked)) for (s, t) in asks if t == to]
    return out


def propagated(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Rows (_row, _group, _shard), one for each of ``docs`` (_row, _hash): groups of equal
    hashes and the propagated shards."""
    spark = docs.sparkSession
    n = docs.count()
    quota = n / shards
    most = max(1, int(quota * SHARE))
    sizes = docs.where("_hash is not null").groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1")
    chunk = F.pmod(F.xxhash64("_row", F.lit(5)), F.ceil(F.col("_n") / F.lit(most)).cast("long"))
    linked = docs.join(sizes, "_hash").select("_row", F.xxhash64("_hash", chunk).alias("_group"))
    linked = materialize(linked.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int")), "linked")
    for turn in range(rounds):
        votes = linked.groupBy("_group", "_shard").agg(F.count("*").alias("_votes"))
        # the most votes; among equals the one that the group's hash prefers in this turn
        best = votes.groupBy("_group").agg(F.max_by("_shard", F.struct("_votes", F.xxhash64("_group", "_shard", F.lit(turn)))).alias("_to"))
        wish = linked.join(best, "_group")
        counts = wish.groupBy("_shard", "_to").agg(F.count("*").alias("n")).collect()
        asks = {(r["_shard"], r["_to"]): r["n"] for r in counts if r["_shard"] != r["_to"]}
        if not asks:
            break
        fixed = {r["_shard"]: r["n"] for r in counts if r["_shard"] == r["_to"]}
        rows = _accepted(asks, fixed, quota, shards)
        # 24 x 24 rows at most; a group moves or stays as a whole, from all its shards
        least: dict[int, float] = {}
        for _, to, share in rows:
            least[to] = share
        table = F.create_map(*[x for to, share in least.items() for x in (F.lit(to), F.lit(float(share)))])
        goes = _draw(F.col("_group"), F.lit(turn)) < F.coalesce(F.try_element_at(table, F.col("_to")), F.lit(0.0))
        moved = materialize(wish.select("_row", "_group", F.when(goes, F.col("_to")).otherwise(F.col("_shard")).alias("_shard")), "linked")
        release(linked)
        linked = moved
    taken = {r["_shard"]: r["n"] for r in linked.groupBy("_shard").agg(F.count("*").alias("n")).collect()}
    # unlinked documents fill each shard up to its quota, by hash
    rooms = [max(0.0, quota - taken.get(s, 0)) for s in range(shards)]
    total, edges, at = sum(rooms) or 1.0, [], 0.0
    for room in rooms:
        at += room / total
        edges.append(at)
    place = F.lit(shards - 1)
    draw = _draw(F.col("_row"), F.lit(77))
    for s in range(shards - 2, -1, -1):
        place = F.when(draw < edges[s], s).otherwise(place)
    free = docs.join(linked.select("_row"), "_row", "left_anti").select("_row", F.xxhash64("_row", F.lit(9)).alias("_group"), place.cast("int").alias("_shard"))
    return linked.unionByName(free)


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, cut for each row."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.unhex(F.md5(text))).alias("_hash"),
    )
    base = materialize(base.withColumn("_row", F.monotonically_increasing_id()), "rows")
    n = base.count()
    labels = propagated(base.select("_row", "_hash"), shards)
    laid = base.join(labels, "_row").withColumn("_all", F.lit(0))
    numbered = ranked(laid, "_all", ["_shard", "_group", "_hash", "doc_id", "_row"], "_at")
    low, extra = divmod(n, shards)
    # the first ``extra`` shards have one row more
    head = extra * (low + 1)
    shard = F.when(F.col("_at") < head, F.floor(F.col("_at") / F.lit(low + 1))).otherwise(extra + F.floor((F.col("_at") - head) / F.lit(max(low, 1))))
    start = F.col("shard") * low + F.least(F.col("shard"), F.lit(extra))
    return numbered.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("_at") - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
