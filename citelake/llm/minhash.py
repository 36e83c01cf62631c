"""Near-duplicate documents by weighted MinHash (BagMinHash) and exact verification.

A document is the multiset of its five-word shingles.  Each shingle has, for each
discretised stretch of weights (the first occurrence, the second, the third and fourth,
the fifth to eighth and so on), a Poisson process of points in time and weight that its
hash decides; a document takes the points below its own weight.  Each point falls
into one of ``SIGNATURE`` places, and a place keeps the earliest point.  Two documents agree in
a place with the probability of their weighted Jaccard similarity.  Points are made in
order of time and only while they can still be earlier than the latest kept one.

Signatures are cut into bands; documents that share a band share a bucket.  Equal multisets are
collapsed to one node first.  Then, by exact multiset overlap:

1. each node is compared with the smallest one of all that share a bucket with it, so that
   copies and near copies of thousands cost one comparison each;
2. nodes of buckets that still hold several classes go, by size, into blocks of bounded volume
   within the largest such bucket of each, and a block's nodes are compared in memory;
3. buckets that still hold several classes and more than one block are searched whole: nodes go
   into blocks anew, large classes apart, and each two blocks that meet in a bucket there with
   different classes are compared once, unless their sizes differ too much for the threshold.

A comparison of blocks counts common elements as a product of incidence matrices and leaves only
edges of a spanning forest, at most one for each node of it; no pairs are emitted.

Defined results: words are runs of letters, digits and underscores in lower case;
documents of one to four words have one shingle; documents without words (null, empty,
signs only) are classes of their own and kept; equal multisets are one class; rows with
null doc_id are left out of ``classes`` and kept by ``without_near_copies``; a doc_id given
with several texts is one document that is near all that any of its texts is near; of rows with
the same doc_id all stay there if the class keeps that doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm._common import TEXTS, batches_of, materialize, ranked, release, sliced
from citelake.llm._graph import components, forest
from citelake.llm._text import mixed, tokens, uniform

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 5
SIGNATURE = BANDS * ROWS
#: Most nodes of a block, and most elements of one with more than one node.
BLOCK, VOLUME = 256, 1 << 16
#: Numbers of an incidence matrix at once.
CELLS = 1 << 22


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of several texts: text, hash, multiplicity; by text and hash."""
    words, _, sizes = tokens(texts, signs=False)
    # short ones are padded, so that they have one shingle
    short = np.flatnonzero((sizes > 0) & (sizes < size))
    ends = np.cumsum(sizes)[short]
    words = np.insert(words, np.repeat(ends, size - sizes[short]), 0)
    sizes[short] = size
    text = np.repeat(np.arange(len(sizes)), sizes)
    if len(words) < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    n = len(words) - size + 1
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]) if k in (2, size - 1) else h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    inside = text[:n] == text[size - 1 :]
    h, text = h[inside], text[:n][inside]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    return text[at], h[at], np.diff(np.append(at, len(h)))


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, places: int = SIGNATURE) -> np.ndarray:
    """BagMinHash signatures of ``n`` multisets: times of the earliest points, n x places."""
    kept = np.full(n * places, np.inf)
    # stretches of weights: [0,1), [1,2), [2,4), [4,8) ... up to each weight
    doc, seed, low, width, top = [text], [element], [np.zeros(len(text))], [np.ones(len(text))], [weight.astype(float)]
    level, start = 1, 1
    while True:
        more = weight > start
        if not more.any():
            break
        doc.append(text[more])
        seed.append(mixed(element[more] + np.uint64(level * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)))
        low.append(np.full(more.sum(), float(start)))
        width.append(np.full(more.sum(), float(start)))
        top.append(weight[more].astype(float))
        level, start = level + 1, start * 2
    doc, seed, low, width, top = map(np.concatenate, (doc, seed, low, width, top))
    time, count = np.zeros(len(doc)), 0
    while len(doc):
        many = int(min(64, max(1, 30_000 // len(doc))))
        step = np.arange(1, many + 1, dtype=np.uint64)[None, :] + np.uint64(count)
        draws = mixed(seed[:, None] + step * np.uint64(0x9E3779B97F4A7C15))
        times = -np.log(uniform(draws)) / width[:, None]
        times[:, 0] += time
        np.cumsum(times, axis=1, out=times)
        other = mixed(draws + np.uint64(0x8CB92BA72F3D8DD7))
        place = (other % np.uint64(places)).astype(np.int64)
        # a point lies at a weight within its stretch; the document takes it if it has that weight
        whole = low + width <= top
        takes = np.ones(times.shape, bool)
        if not whole.all():
            part = ~whole
            takes[part] = low[part, None] + width[part, None] * uniform(mixed(other[part])) < top[part, None]
        flat = (doc[:, None] * places + place)[takes]
        np.minimum.at(kept, flat, times[takes])
        latest = kept.reshape(n, places).max(axis=1)
        time, count = times[:, -1], count + many
        on = time < latest[doc]
        doc, seed, low, width, top, time = doc[on], seed[on], low[on], width[on], top[on], time[on]
    return kept.reshape(n, places)


def bands_of(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A hash of each band, n x bands; the band's number is part of it."""
    rows = signature.shape[1] // bands
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(signature), bands)).copy()
    for k in range(rows):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, k])
    return h.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in sliced(whole, "text"):
            n = batch.num_rows
            text, element, weight = shingles(batch.column("text").to_pylist())
            bands = bands_of(signatures(text, element, weight, n))
            # the multiset's own hash, in two halves: equal ones are one class
            sums = np.zeros((2, n), np.uint64)
            for k in (0, 1):
                part = mixed(element * np.uint64(2 * k + 1) + weight.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                np.add.at(sums[k], text, mixed(part + np.uint64(k)))
            none = np.ones(n, bool)
            none[text] = False
            size = np.bincount(text, weight, minlength=n).astype(np.int64)
            columns = [
                batch.column("doc_id"),
                batch.column("text_hash"),
                pa.array(sums[0].view(np.int64), mask=none),
                pa.array(sums[1].view(np.int64), mask=none),
                pa.array(size),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel())),
            ]
            yield pa.record_batch(columns, names=["doc_id", "text_hash", "key1", "key2", "size", "bands"])


def elements(text: str) -> np.ndarray:
    """A multiset as a set: each occurrence of a shingle is an element."""
    _, h, n = shingles([text])
    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.sort(np.repeat(h, n) + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in sliced(whole, "text"):
            raw = [elements(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("node"), pa.array(raw, pa.binary())], names=["node", "elements"])


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets (their ``elements``)."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def near(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Which of the multisets of ``left`` and ``right`` (``left`` itself, if none) overlap enough."""
    every = left if right is None else left + right
    sizes = np.fromiter(map(len, every), np.int64, len(every))
    _, place, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(every)), sizes)
    # only elements of more than one are of use
    number = np.cumsum(count > 1) - 1
    use = count[place] > 1
    of, place = of[use], number[place[use]]
    order = np.argsort(place, kind="stable")
    of, place = of[order], place[order]
    cut = len(left)
    shared = np.zeros((cut, cut if right is None else len(right)), np.float32)
    width = max(1, CELLS // len(every))
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(place, (low, low + width))
        cells = np.zeros((len(every), min(width, int(place[b - 1]) + 1 - low)), np.float32)
        cells[of[a:b], place[a:b] - low] = 1
        shared += cells[:cut] @ (cells if right is None else cells[cut:]).T
    other = sizes[:cut] if right is None else sizes[cut:]
    out = shared / (sizes[:cut, None] + other[None, :] - shared.astype(np.float64)) >= THRESHOLD
    if right is None:
        np.fill_diagonal(out, True)
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [overlap(x, y) >= THRESHOLD for x, y in zip(_arrays(batch.column("elements_a")), _arrays(batch.column("elements_b")), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between the classes of each block's members (array of struct(label, elements))."""
    for batch in batches:
        for members in batch.column("members"):
            label = members.values.field("label").to_numpy()
            a, b = forest(near(_arrays(members.values.field("elements"))), label, label)
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one, two in zip(batch.column("members"), batch.column("others"), strict=True):
            one, two = one.values, two.values
            linked = near(_arrays(one.field("elements")), _arrays(two.field("elements")))
            a, b = forest(linked, one.field("label").to_numpy(), two.field("label").to_numpy())
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def _mixed(placed: DataFrame, label: DataFrame) -> DataFrame:
    """``placed`` (bucket, node, size) with labels, where a bucket's nodes have several: n of them."""
    known = placed.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = known.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("bucket", "n")
    return known.join(several, "bucket").select("bucket", "node", "size", "label", "n")


def _blocked(known: DataFrame, apart: bool) -> DataFrame:
    """The block of each node of ``known``: by its largest bucket, large classes ``apart``, size."""
    homes = known.groupBy("node", "size", "label").agg(F.max(F.struct("n", "bucket"))["bucket"].alias("home"))
    if apart:
        large = homes.groupBy("home", "label").agg(F.count("*").alias("n")).where(F.col("n") >= BLOCK)
        homes = homes.join(large.select("home", "label", F.col("label").alias("big")), ["home", "label"], "left")
    else:
        homes = homes.withColumn("big", F.lit(None).cast("long"))
    placed = ranked(materialize(homes, "homes"), "home", ["big", "size", "node"], "_place")
    power = F.ceil(F.log2(F.greatest("size", F.lit(1)))).cast("int")
    most = F.least(F.greatest(F.floor(F.lit(VOLUME) / F.pow(F.lit(2.0), power)), F.lit(1)), F.lit(BLOCK))
    # equal hashes of two blocks would only make one larger block
    block = F.xxhash64("home", F.col("big").isNull(), "big", power, F.floor(F.col("_place") / most).cast("long"))
    return materialize(placed.select("node", "size", "label", block.alias("block")), "homes")


def _filled(homes: DataFrame, listed: DataFrame) -> DataFrame:
    """The blocks with their members' elements."""
    members = F.collect_list(F.struct("label", "elements")).alias("members")
    return homes.join(listed, "node").groupBy("block").agg(members, F.min("label").alias("low"), F.max("label").alias("high"))


def _met(known: DataFrame, homes: DataFrame) -> DataFrame:
    """Blocks that meet in a bucket with different classes: block, other."""
    counts = known.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("bucket").agg(F.max_by("label", "n").alias("main"))
    rows = known.select("bucket", "node", "label", "size").join(homes.select("node", "block"), "node")
    ends = rows.groupBy("bucket", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("size").alias("least"), F.max("size").alias("most"))
    ends = materialize(ends, "ends")
    # two blocks of nothing but the main class need no comparison: one of the two isn't such
    left = ends.join(main, "bucket").where((F.col("low") != F.col("main")) | (F.col("high") != F.col("main"))).drop("main")
    right = ends.select("bucket", *[F.col(c).alias(f"_{c}") for c in ends.columns if c != "bucket"])
    differ = F.least("low", "_low") < F.greatest("high", "_high")
    alike = (F.col("most") >= F.col("_least") * THRESHOLD) & (F.col("_most") >= F.col("least") * THRESHOLD)
    pairs = left.join(right, "bucket").where(differ & alike)
    return pairs.select(F.least("block", "_block").alias("block"), F.greatest("block", "_block").alias("other")).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` with a doc_id: doc_id, class_id (the smallest doc_id of
    its class), kept."""
    spark = docs.sparkSession
    base = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = base.mapInArrow(_signed, "doc_id long, text_hash long, key1 long, key2 long, size long, bands array<long>")
    with batches_of(spark, TEXTS):
        signed = materialize(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    worded = signed.where("key1 is not null")
    nodes = materialize(worded.groupBy("key1", "key2").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_doc")), "nodes")
    # a doc_id given with several texts is one document: its nodes are linked
    several = worded.groupBy("doc_id").agg(F.min("key1").alias("lo"), F.max("key1").alias("hi")).where("lo < hi").select("doc_id")
    same = worded.join(several, "doc_id").join(nodes, ["key1", "key2"]).select("doc_id", "node")
    same = same.join(same.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a < node").select("a", F.col("node").alias("b")).distinct()

    one = signed.join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    banded = one.select(F.explode("bands").alias("bucket"), F.col("row").alias("node"), "size")
    buckets = banded.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").select("bucket", "first")
    placed = materialize(banded.join(buckets, "bucket"), "placed")
    some = signed.join(placed.select(F.col("node").alias("row")).distinct(), "row", "left_semi").select("doc_id", "text_hash", F.col("row").alias("node"))
    listed = base.join(some, ["doc_id", "text_hash"]).select("node", "text").mapInArrow(_listed, "node long, elements binary")
    with batches_of(spark, TEXTS):
        listed = materialize(listed.dropDuplicates(["node"]), "listed")

    pairs = placed.groupBy("node").agg(F.min("first").alias("a")).where("a < node").select("a", F.col("node").alias("b"))
    with batches_of(spark, 256):
        both = pairs.join(listed.toDF("b", "elements_b"), "b").join(listed.toDF("a", "elements_a"), "a")
        links = materialize(both.select("a", "b", "elements_a", "elements_b").mapInArrow(_verified, "a long, b long"), "links")
    # a node's smallest companion, and that one's own, stand for its class
    up = links.select(F.col("b").alias("_a"), F.col("a").alias("_up"))
    label = links.select(F.col("b").alias("node"), F.col("a").alias("_a")).join(up, "_a", "left").select("node", F.coalesce("_up", "_a").alias("label"))
    placed = placed.select("bucket", "node", "size")
    known = materialize(_mixed(placed, materialize(label, "label")), "mixed")
    homes = _blocked(known, apart=False)
    with batches_of(spark, 16):
        found = _filled(homes, listed).where("low < high").select("members").mapInArrow(_within, "a long, b long")
        edges = materialize(found.distinct(), "edges")
    every = links.unionByName(edges).unionByName(same)
    part = materialize(components(every), "parts")
    label = part.select(F.col("id").alias("node"), F.col("component").alias("label"))
    several = known.join(homes.select("node", "block"), "node").groupBy("bucket").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo < hi")
    known = materialize(_mixed(known.select("bucket", "node", "size").join(several.select("bucket"), "bucket"), label), "mixed")
    if not known.isEmpty():
        homes = _blocked(known, apart=True)
        pairs = materialize(_met(known, homes), "pairs")
        with batches_of(spark, 16):
            blocks = materialize(_filled(homes, listed).select("block", "members"), "blocks")
            both = pairs.join(blocks, "block").join(blocks.toDF("other", "others"), "other").select("members", "others")
            edges = materialize(both.mapInArrow(_between, "a long, b long").distinct(), "edges")
        release(blocks)
        part = materialize(components(part.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(edges)), "parts")
    release(placed, listed)

    of = nodes.join(part.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("first_doc").alias("class_id"))
    of = of.join(least, "component").select("key1", "key2", "class_id")
    found = materialize(signed.select("doc_id", "key1", "key2").join(of, ["key1", "key2"], "left").select("doc_id", "class_id"), "found")
    # a row without words goes with its doc_id's other rows
    other = found.groupBy("doc_id").agg(F.min("class_id").alias("_class"), F.count("*").alias("n")).where("n > 1").select("doc_id", "_class")
    class_id = F.coalesce("_class", "class_id", "doc_id")
    return found.join(other, "doc_id", "left").select("doc_id", class_id.alias("class_id"), (class_id == F.col("doc_id")).alias("kept"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which each class keeps one, with all their columns."""
    gone = classes(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
