"""Near-duplicate vectors by NN-descent and exact counts.

Equal vectors of one label are collapsed first.  Each vector starts with its nearest ones
in blocks of several random orderings (signs of projections, range-partitioned).  Rounds of
NN-descent follow: the neighbours of each vector, forward and a sample of backward ones,
are compared with each other, and each keeps its ``LIST`` best.  Edges of the threshold or
more give components.  A list that holds only such edges is saturated, it may hide others,
within its component and to other ones.  Whatever edge a list dropped has saturated lists at
both ends; therefore all saturated vectors of a label are compared, blocks with blocks, and
components that they link are one.  Then lists of whole components are enlarged to the
component, as blocks that give counts and not pairs, and no cluster's size is capped.

Recall is audited on bounded samples of vectors with few and with many links found, against all
vectors of their label, as the mean over vectors; rounds go on, with lists twice as long, while
either is below ``RECALL``.  Where it stays so, or where too few vectors of the first sample have
links to tell, all vectors of a label are compared, blocks with blocks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and
rows without a label, have no links and are their own component; vectors of different
lengths never link; rows with the same vec_id are rows of their own; a null vec_id has a null
component unless linked, and is kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm._common import batches_of, materialize, ranked, release
from citelake.llm._graph import components, forest
from citelake.llm.ann import usable

THRESHOLD = 0.93
LIST = 10
ORDERS = 6
BITS = 48
BLOCK = 512
ROUNDS, MOST_ROUNDS = 2, 6
AUDIT = 256
#: Vectors with fewer links than LIST that are audited, and how many of them must have links to tell.
AUDIT_SMALL, TELLING = 2048, 16
RECALL = 0.995
SEED = 77

EDGES = "a long, b long, sim double"


def _unit(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


#: A matrix product rounds by its shape; this near the threshold pairs are summed one by one.
EDGE = 1e-9


def _linked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which unit vectors have the threshold's cosine, the same whatever block they lie in."""
    sims = left @ right.T
    out = sims >= THRESHOLD
    i, j = np.nonzero(np.abs(sims - THRESHOLD) < EDGE)
    for at in range(0, len(i), 50_000):
        x, y = i[at : at + 50_000], j[at : at + 50_000]
        out[x, y] = (left[x] * right[y]).sum(axis=1) >= THRESHOLD
    return out


def _rows(out: list[tuple]) -> pa.RecordBatch:
    a, b, s = (np.concatenate([x[i] for x in out]) if out else np.empty(0) for i in range(3))
    return pa.record_batch([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(s.astype(np.float64))], names=["a", "b", "sim"])


def _best(ids: np.ndarray, unit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's k nearest others among the given ones."""
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    m = min(k, len(ids) - 1)
    if m < 1:
        return np.empty(0), np.empty(0), np.empty(0)
    near = np.argpartition(sims, len(ids) - m, axis=1)[:, len(ids) - m :]
    row = np.repeat(np.arange(len(ids)), m)
    return ids[row], ids[near.ravel()], sims[row, near.ravel()]


def _compared(groups: DataFrame, k: int) -> DataFrame:
    """Edges among the members (array of struct(id, unit)) of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                members = batch.column("members")[i].values
                ids, first = np.unique(members.field("id").to_numpy(), return_index=True)
                if len(ids) > 1:
                    raw = members.field("unit").to_pylist()
                    out.append(_best(ids, _unit([raw[j] for j in first]), k))
                if sum(len(x[0]) for x in out) > 100_000:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    return groups.select("members").mapInArrow(run, EDGES)


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """The k best edges of each vector.  Every group gave k at most for a vector, and the
    groups it is in are few, so the sets stay small."""
    best = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("sim")).alias("s"), "b"))), 1, k)
    listed = edges.groupBy("a").agg(best.alias("_best")).select("a", F.explode("_best").alias("e"))
    return listed.select("a", F.col("e.b").alias("b"), (-F.col("e.s")).alias("sim"))


def _started(vectors: DataFrame, k: int) -> DataFrame:
    """Edges within blocks of random orderings of each label's vectors."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            raw = batch.column("unit").to_pylist()
            keys = np.zeros((ORDERS, len(raw)), np.int64)
            sizes = np.array([len(x) // 8 for x in raw])
            for width in np.unique(sizes):
                at = np.flatnonzero(sizes == width)
                if width not in planes:
                    planes[width] = np.random.default_rng(SEED + int(width)).normal(size=(ORDERS, width, BITS))
                unit = _unit([raw[i] for i in at])
                for t in range(ORDERS):
                    keys[t, at] = ((unit @ planes[width][t] > 0).astype(np.int64) << np.arange(BITS)).sum(axis=1)
            for t in range(ORDERS):
                ids = pa.array(np.full(len(raw), t, np.int32))
                yield pa.record_batch([batch.column("id"), batch.column("label"), batch.column("unit"), ids, pa.array(keys[t])], names=["id", "label", "unit", "turn", "key"])

    keyed = vectors.select("id", "label", "unit").mapInArrow(key, "id long, label string, unit binary, turn int, key long")
    # a label's vectors and those of other lengths stay apart by the order, blocks that hold two labels lose nothing
    placed = ranked(keyed.withColumn("_size", F.length("unit")), "turn", ["label", "_size", "key", "id"], "_place")
    block = F.floor(F.col("_place") / BLOCK)
    groups = placed.groupBy("turn", block.alias("block"), "label", "_size").agg(F.collect_list(F.struct("id", "unit")).alias("members"))
    return _compared(groups, k)


def _descended(edges: DataFrame, vectors: DataFrame, k: int, turn: int) -> DataFrame:
    """One round: neighbours of each vector, forward and sampled backward ones, compared."""
    indegree = edges.groupBy("b").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("a", "b", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
    backward = edges.join(indegree, "b").where(draw * F.col("n") < k).select(F.col("b").alias("centre"), F.col("a").alias("id"))
    forward = edges.select(F.col("a").alias("centre"), F.col("b").alias("id"))
    own = edges.select(F.col("a").alias("centre"), F.col("a").alias("id"))
    pairs = forward.unionByName(backward).unionByName(own).distinct()
    groups = pairs.join(vectors.select("id", "unit"), "id").groupBy("centre").agg(F.collect_list(F.struct("id", "unit")).alias("members"))
    return _compared(groups, k)


def _joined(vectors: DataFrame, parts: DataFrame) -> DataFrame:
    """Links between different components of ``vectors``, all of a label compared: edges (a, b) of
    components that join the same as all links."""
    placed_by = F.concat(F.length("unit").cast("string"), F.lit(" "), F.col("label"))
    rows = vectors.join(parts, "id", "left").select(F.coalesce("component", "id").alias("component"), placed_by.alias("group"), "id", "unit")
    placed = ranked(rows, "group", ["component", "id"], "_place").withColumn("block", F.floor(F.col("_place") / BLOCK).cast("int"))
    blocks = placed.groupBy("group", "block").agg(F.collect_list(F.struct("component", "unit")).alias("members"), F.min("component").alias("low"), F.max("component").alias("high"))
    blocks = materialize(blocks, "blocks")
    number = blocks.groupBy("group").agg(F.count("*").alias("_blocks"))
    left = blocks.join(number, "group").withColumn("other", F.explode(F.sequence(F.col("block"), (F.col("_blocks") - 1).cast("int"))))
    right = blocks.select("group", F.col("block").alias("other"), F.col("members").alias("others"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    differ = F.least("low", "_low") < F.greatest("high", "_high")
    pairs = left.join(right, ["group", "other"]).where(differ).select("members", "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column("members")[i].values, batch.column("others")[i].values
                mine, theirs = a.field("component").to_numpy(), b.field("component").to_numpy()
                linked = _linked(_unit(a.field("unit").to_pylist()), _unit(b.field("unit").to_pylist()))
                linked &= mine[:, None] != theirs[None, :]
                start, end = forest(linked, mine, theirs)
                yield pa.record_batch([pa.array(start), pa.array(end)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").distinct()


def _counted(vectors: DataFrame, parts: DataFrame) -> DataFrame:
    """Exact links within components: id, links (weighted by copies), other than its copies."""
    rows = vectors.join(parts, "id").select("id", "component", "unit", "copies")
    placed = ranked(rows, "component", ["id"], "_place").withColumn("block", F.floor(F.col("_place") / BLOCK).cast("int"))
    blocks = materialize(placed.groupBy("component", "block").agg(F.collect_list(F.struct("id", "unit", "copies")).alias("members")), "blocks")
    number = blocks.groupBy("component").agg(F.count("*").alias("_blocks"))
    left = blocks.join(number, "component").withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("_blocks") - 1).cast("int"))))
    right = blocks.select("component", F.col("block").alias("other"), F.col("members").alias("others"))
    pairs = left.join(right, ["component", "other"]).select("members", "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column("members")[i].values, batch.column("others")[i].values
                ids, others = a.field("id").to_numpy(), b.field("id").to_numpy()
                linked = _linked(_unit(a.field("unit").to_pylist()), _unit(b.field("unit").to_pylist()))
                linked[ids[:, None] == others[None, :]] = False
                yield pa.record_batch([pa.array(ids), pa.array(linked @ b.field("copies").to_numpy().astype(np.int64))], names=["id", "links"])

    return pairs.mapInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def _recall(vectors: DataFrame, counts: DataFrame) -> float | None:
    """Mean share of a vector's links that the counts hold: the lower one of bounded samples
    of vectors with few and with many of them; None if too few have links to tell."""
    sized = vectors.join(counts, "id", "left").select("id", "label", "unit", (F.coalesce("links", F.lit(0)) >= LIST).alias("many"))
    few = sized.where("not many").orderBy(F.xxhash64("id"), "id").limit(AUDIT_SMALL).collect()
    sample = few + sized.where("many").orderBy(F.xxhash64("id"), "id").limit(AUDIT).collect()
    if not sample:
        return 1.0
    by: dict[tuple[str, int], list] = {}
    for r in sample:
        by.setdefault((r["label"], len(r["unit"])), []).append((r["id"], bytes(r["unit"])))
    shared = vectors.sparkSession.sparkContext.broadcast({g: (np.array([i for i, _ in x]), _unit([u for _, u in x])) for g, x in by.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, raw = batch.column("label").to_pylist(), batch.column("unit").to_pylist()
            copies, ids = batch.column("copies").to_numpy(), batch.column("id").to_numpy()
            groups: dict[tuple[str, int], list[int]] = {}
            for i, (label, u) in enumerate(zip(labels, raw, strict=True)):
                groups.setdefault((label, len(u)), []).append(i)
            for g, at in groups.items():
                if g in shared.value:
                    queries, unit = shared.value[g]
                    linked = _linked(unit, _unit([raw[i] for i in at]))
                    linked[queries[:, None] == ids[at][None, :]] = False
                    yield pa.record_batch([pa.array(queries), pa.array(linked @ copies[at])], names=["id", "true_links"])

    true = vectors.select("id", "label", "unit", "copies").mapInArrow(run, "id long, true_links long").groupBy("id").agg(F.sum("true_links").alias("true_links"))
    both = true.where("true_links > 0").join(counts, "id", "left").select("id", (F.coalesce("links", F.lit(0)) / F.col("true_links")).alias("share")).collect()
    small = {r["id"] for r in few}
    shares = [[r["share"] for r in both if (r["id"] in small) == own] for own in (True, False)]
    if len(few) == AUDIT_SMALL and len(shares[0]) < TELLING:
        return None
    return min((float(np.mean(x)) for x in shares if x), default=1.0)


def linked(table: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``table`` (vec_id, embedding, label)."""

    def normed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("embedding").to_pylist():
                x = np.array(v, np.float64)
                x = x / np.abs(x).max()  # neither overflows nor vanishes when squared
                out.append((x / np.linalg.norm(x)).tobytes())
            yield pa.record_batch([batch.column("_row"), batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], names=["_row", "vec_id", "label", "unit"])

    rows = materialize(table.select("vec_id", "embedding", F.col("label").cast("string").alias("label")).withColumn("_row", F.monotonically_increasing_id()), "rows")
    good = rows.where(F.col("label").isNotNull() & usable(F.col("embedding")))
    units = materialize(good.mapInArrow(normed, "_row long, vec_id long, label string, unit binary"), "units")
    same = units.groupBy("label", "unit").agg(F.min("_row").alias("id"), F.count("*").alias("copies"))
    vectors = materialize(same, "vectors")
    member = units.join(vectors, ["label", "unit"]).select("_row", "vec_id", "id", "copies")
    k, turn = LIST, 0
    spark = table.sparkSession
    with batches_of(spark, 64):
        edges = materialize(_lists(_started(vectors, k), k), "edges")
    parts = counts = None
    while True:
        while turn < ROUNDS or parts is not None:
            with batches_of(spark, 1024):
                more = materialize(_lists(edges.unionByName(_descended(edges, vectors, k, turn)), k), "edges")
            release(edges)
            edges, turn = more, turn + 1
            if parts is not None:
                break
        near = edges.where(F.col("sim") >= THRESHOLD).select("a", "b")
        parts = materialize(components(near), "parts")
        # a list of more than LIST now may have been full before
        saturated = near.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= LIST).select(F.col("a").alias("id"))
        with batches_of(spark, 32):
            links = materialize(_joined(vectors.join(saturated, "id"), parts), "links")
        if not links.isEmpty():
            parts = materialize(components(near.unionByName(links).unionByName(parts.select(F.col("id").alias("a"), F.col("component").alias("b")))), "parts")
        with batches_of(spark, 32):
            counts = materialize(_counted(vectors, parts), "counts")
        recall = _recall(vectors, counts)
        if recall is not None and recall >= RECALL:
            break
        if recall is None or turn >= MOST_ROUNDS:
            with batches_of(spark, 32):
                links = materialize(_joined(vectors, parts), "links")
            parts = materialize(components(links.unionByName(parts.select(F.col("id").alias("a"), F.col("component").alias("b")))), "parts")
            with batches_of(spark, 32):
                counts = materialize(_counted(vectors, parts), "counts")
            break
        k *= 2
    placed = member.join(parts, "id", "left").join(counts, "id", "left").withColumn("_part", F.coalesce("component", "id"))
    least = placed.groupBy("_part").agg(F.min("vec_id").alias("component_id"))
    done = placed.join(least, "_part").select("_row", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("_row", "vec_id").join(done, "_row", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
