"""Nearest neighbours along shifted space-filling curves.

Vectors are rotated and projected to ``DIMS`` numbers; each of ``CURVES`` random projections
and shifts orders them along a Hilbert curve.  The order is range-partitioned and cut
into blocks of neighbouring keys; a query is compared with the blocks around its own on
every curve, and the finds are merged and reranked by exact inner products in double precision.

Equal vectors are one, with its ``k`` + 1 smallest ids; a list of vectors is made for each that a
query has, and expanded to ids at last.  So ties of any number of copies go to the smallest ids.

Recall is measured against brute force on a bounded sample of the queries (``AUDIT``), and
curves are added, ``CURVES`` at a time and merged into what is found, until it is ``RECALL`` or
more.  Only where ``MOST_CURVES`` don't suffice do the queries go on to all blocks of a curve,
block against block, which is exact.  What is done follows the measured recall alone.

Defined results: vectors that are null, empty, zero, of a length other than the first by
vec_id, or that hold null or non-finite components take no part; ties go to the smaller
vec_id; rows with the same vec_id and vector are one row given twice; of rows with the same vec_id
and other vectors each counts as a candidate, and as queries they have one list; a query
excludes its own id; null vec_ids take no part; products that overflow take no part; fewer candidates than asked are all returned; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.llm._common import batches_of, materialize, ranked, release, shuffle_partitions

CURVES, MOST_CURVES = 4, 32
DIMS, BITS = 8, 7
BLOCK = 1024
QUERIES = 512
#: Blocks of a task's slice: a query leaves one list for each slice.
SLICE = 64
#: Pairs whose scores are summed at once.
PAIRS = 50_000
AUDIT = 128
RECALL = 0.93
NEAREST = 20
SEED = 20240601


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components and isn't zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer points (n x dims, values below 2^bits), by
    Skilling's transform (AIP Conf. Proc. 707, 2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            has = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & low
            x[0] = np.where(has, x[0] ^ low, x[0] ^ t)
            x[i] = np.where(has, x[i], x[i] ^ t) if i else x[i]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projections(width: int, curves: int = MOST_CURVES, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Random orthogonal projections (curves x width x dims) and shifts (curves x dims)."""
    rnd = np.random.default_rng(SEED)
    out = [np.linalg.qr(rnd.normal(size=(width, width)))[0][:, :dims] for _ in range(curves)]
    out = [np.pad(p, ((0, 0), (0, dims - p.shape[1]))) for p in out]
    return np.stack(out), rnd.random((curves, dims))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _top(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's k best in a block, itself among them.

    A matrix product rounds by its shape, so that equal vectors may differ in the last
    bits; it only chooses, with a margin, whose scores are then summed one by one."""
    scores = queries @ vectors.T
    m = min(k, len(ids))
    edge = np.partition(scores, len(ids) - m, axis=1)[:, len(ids) - m]
    margin = 1e-12 * np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1).max()
    q, c = np.nonzero((scores >= (edge - margin)[:, None]) & np.isfinite(scores))
    value = np.empty(len(q))
    for at in range(0, len(q), PAIRS):
        part = slice(at, at + PAIRS)
        value[part] = (queries[q[part]] * vectors[c[part]]).sum(axis=1)
    found, near = query_ids[q], ids[c]
    order = np.lexsort((near, -value, found))
    return _first(found[order], near[order], value[order], k)


FOUND = "query_id long, vec_id long, score double"


def _searched(pairs: DataFrame, width: int, k: int) -> DataFrame:
    """Finds of pairs of blocks (ids, vectors, query_ids, queries as arrays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task keeps one list for each query of its groups, however many blocks it sees
        best: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                ids, query_ids = (np.array(batch.column(c)[i].values) for c in ("ids", "query_ids"))
                vectors, queries = (np.frombuffer(b"".join(batch.column(c)[i].as_py()), np.float64).reshape(-1, width) for c in ("vectors", "queries"))
                out = _top(ids, vectors, query_ids, queries, k)
                group = query_ids.tobytes()
                best[group] = _merge(best[group], out, k) if group in best else out
                if len(best) > 64:
                    yield _batch(best.pop(next(iter(best))))
        for out in best.values():
            yield _batch(out)

    return pairs.select("ids", "vectors", "query_ids", "queries").mapInArrow(run, FOUND)


def _batch(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])


def _merge(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, near, value = (np.concatenate(x) for x in zip(a, b, strict=True))
    order = np.lexsort((near, -value, found))
    return _first(found[order], near[order], value[order], k)


def _first(found: np.ndarray, near: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each query, from rows sorted by query."""
    start = np.r_[True, found[1:] != found[:-1]] if len(found) else np.zeros(0, bool)
    rank = np.arange(len(found)) - np.maximum.accumulate(np.where(start, np.arange(len(found)), 0))
    keep = rank < k
    return found[keep], near[keep], value[keep]


def _packed(rows: DataFrame, keys: list[str], ids: str, vectors: str) -> DataFrame:
    """Rows of a block as two arrays; blocks are bounded by their construction."""
    packed = rows.groupBy(*keys).agg(F.collect_list(F.struct("vec_id", "bytes")).alias("_all"))
    return packed.select(*keys, F.col("_all.vec_id").alias(ids), F.col("_all.bytes").alias(vectors))


def _merged(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best of all finds: pre-merged lists never exceed the blocks' k."""
    best = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    return found.groupBy("query_id").agg(best.alias("_best"))


def _ordered(good: DataFrame, width: int, curves: range) -> DataFrame:
    """curve, block, vec_id, bytes: each row in its block on each of the ``curves``."""
    matrices, shifts = (x[curves.start : curves.stop] for x in projections(width))
    first = curves.start

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"), width)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            raw = [v.tobytes() for v in x]
            for c, (matrix, shift) in enumerate(zip(matrices, shifts, strict=True)):
                # projections of unit vectors lie within a few standard deviations of 0
                place = np.tanh(unit @ matrix * np.sqrt(width) / 2) / 2 + 0.5
                cells = np.minimum(((place + shift) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
                yield pa.record_batch([batch.column("vec_id"), batch.column("asked"), pa.array(np.full(len(x), first + c, np.int32)), pa.array(hilbert(cells, BITS)), pa.array(raw, pa.binary())], names=["vec_id", "asked", "curve", "key", "bytes"])

    keyed = good.select("vec_id", "asked", "embedding").mapInArrow(key, "vec_id long, asked boolean, curve int, key long, bytes binary")
    order = ranked(keyed, "curve", ["key", "vec_id"], "_place")
    out = materialize(order.select("curve", F.floor(F.col("_place") / BLOCK).cast("int").alias("block"), "vec_id", "asked", "bytes"), "curves")
    release(order)
    return out


def _near(order: DataFrame, width: int, k: int, radius: int) -> DataFrame:
    """Finds in the blocks around each query's own."""
    blocks = _packed(order, ["curve", "block"], "ids", "vectors")
    near = order.where("asked").withColumn("block", F.explode(F.array(*[F.col("block") + d for d in range(-radius, radius + 1)])))
    asked = _packed(near, ["curve", "block"], "query_ids", "queries")
    return _searched(blocks.join(asked, ["curve", "block"]), width, k)


def _finds(lists: DataFrame) -> DataFrame:
    found = lists.select("query_id", F.explode("_best").alias("b"))
    return found.select("query_id", F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def _exact_sample(good: DataFrame, width: int, k: int) -> DataFrame:
    """The true lists of a bounded sample of the queries: query_id, _exact."""
    spark = good.sparkSession
    sample = good.where("asked").orderBy(F.xxhash64("vec_id"), "vec_id").limit(AUDIT).collect()
    ids = np.array([r["vec_id"] for r in sample], np.int64)
    shared = spark.sparkContext.broadcast((ids, np.array([r["embedding"] for r in sample], np.float64).reshape(-1, width)))

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(shared.value[0]):
            for batch in batches:
                yield _batch(_top(batch.column("vec_id").to_numpy(), _matrix(batch.column("embedding"), width), *shared.value, k))

    return materialize(_merged(good.select("vec_id", "embedding").mapInArrow(audit, FOUND), k).select("query_id", F.col("_best").alias("_exact")), "audit")


def _recall(lists: DataFrame, exact: DataFrame) -> float:
    """The share of the sample's true neighbours that the lists hold."""
    # as many rows as the sample has, at most
    hit = F.broadcast(exact).join(lists, "query_id", "left").select(F.size(F.array_intersect(F.coalesce("_best.vec_id", F.array().cast("array<bigint>")), "_exact.vec_id")).alias("hit"), F.size("_exact").alias("all"))
    counts = hit.agg(F.sum("hit"), F.sum("all")).first()
    return counts[0] / counts[1] if counts[1] else 1.0


def neighbours(table: DataFrame, k: int = NEAREST, every: int = 20, radius: int = 1) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row whose id ``every`` divides."""
    spark = table.sparkSession
    good = table.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", "embedding")
    first = good.orderBy("vec_id").select(F.size("embedding")).first()
    width = first[0] if first else 1
    text = F.md5(F.concat_ws(",", F.transform("embedding", lambda x: x.cast("double").cast("string"))))
    good = materialize(good.where(F.size("embedding") == width).select("vec_id", text.alias("key"), "embedding"), "good")
    ids = materialize(ranked(good.select("key", "vec_id").distinct(), "key", ["vec_id"], "_copy"), "ids")
    query = F.col("vec_id") % every == 0
    asked = ids.groupBy("key").agg(F.max(query).alias("asked"))
    few = ids.where(F.col("_copy") <= k).groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("copies"))
    # vectors are numbered by their smallest ids, so that ties of scores go by these
    one = ids.where("_copy = 0").join(asked, "key").withColumn("_all", F.lit(0))
    one = ranked(one, "_all", ["vec_id", "key"], "number").select("key", F.col("vec_id").alias("_id"), "asked", "number")
    first = good.withColumnRenamed("vec_id", "_id").dropDuplicates(["key", "_id"]).join(one, ["key", "_id"])
    numbered = materialize(first.select(F.col("number").alias("vec_id"), "asked", "key", "embedding").join(few, "key"), "numbered")
    good, members, wanted = numbered, numbered.select("vec_id", "key", "copies"), k
    k = wanted + 1
    exact = _exact_sample(good, width, k)
    found = order = None
    for start in range(0, MOST_CURVES, CURVES):
        if order is not None:
            release(order)
        order = _ordered(good, width, range(start, start + CURVES))
        with batches_of(spark, 16):
            finds = _near(order, width, k, radius)
            more = materialize(_merged(finds if found is None else finds.unionByName(_finds(found)), k), "found")
        if found is not None:
            release(found)
        found = more
        if (recall := _recall(found, exact)) >= RECALL:
            break
    else:
        release(found)
        found = _all_blocks(order.where(F.col("curve") == start), width, k)
    # vectors to ids: few of each, so a query has wanted + 1 times as many at most
    each = found.select("query_id", F.explode("_best").alias("b")).select(F.col("query_id").alias("_query"), F.col("b.vec_id").alias("vec_id"), F.col("b.s").alias("s"))
    entries = F.transform("copies", lambda i: F.struct(F.col("s"), i.alias("vec_id")))
    lists = each.join(members.select("vec_id", "copies"), "vec_id").groupBy("_query").agg(F.flatten(F.collect_list(entries)).alias("_all"))
    lists = lists.join(members.select(F.col("vec_id").alias("_query"), "key"), "_query")
    mine = ids.where(query).select(F.col("vec_id").alias("query_id"), "key").join(lists, "key")
    # a vec_id given with several vectors has one list
    mine = mine.groupBy("query_id").agg(F.flatten(F.collect_list("_all")).alias("_all"))
    own = F.filter("_all", lambda e: e["vec_id"] != F.col("query_id"))
    best = mine.select("query_id", F.posexplode(F.slice(F.array_sort(F.array_distinct(own)), 1, wanted)).alias("_rank", "b"))
    out = best.select("query_id", (F.col("_rank") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
    out._curves, out._recall = start + CURVES, recall
    return out


def _all_blocks(rows: DataFrame, width: int, k: int) -> DataFrame:
    """The stated queries against all rows, block against block."""
    spark = rows.sparkSession
    asked = ranked(rows.where("asked").withColumn("_all", F.lit(0)), "_all", ["vec_id"], "_place")
    asked = _packed(asked.withColumn("group", F.floor(F.col("_place") / QUERIES).cast("int")), ["group"], "query_ids", "queries")
    asked = materialize(asked, "queries")
    groups = asked.count()
    blocks = _packed(rows, ["block"], "ids", "vectors").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(max(groups - 1, 0)))))
    # a task takes a slice of the blocks for a group of queries
    pairs = blocks.join(asked, "group").repartition(shuffle_partitions(spark), "group", F.floor(F.col("block") / SLICE))
    with batches_of(spark, 16):
        return materialize(_merged(_searched(pairs, width, k), k), "found")
