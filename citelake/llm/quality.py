"""Quality by importance resampling: documents are kept like draws from target text.

Two generative models over hashed n-grams, of target text (labelled rows of good quality
that are not toxic) and of raw text (all documents), give each document an importance
weight: the mean log ratio of its n-grams' probabilities, so that it doesn't hang on the
length.  Gumbel noise from the doc_id on the weights, and the k largest sums, make a draw
without replacement.

The models count every document.  Only which rows are known as target or as reject comes
from a bounded sample of the labels (``LABELLED`` rows, by hash).  A bucket's log ratio, positive
or negative, counts where the labelled target and the labelled rest differ beyond chance
in the same direction; elsewhere it is noise, or a passage copied often among the unlabelled,
and counts as zero.  ``k`` is the number of documents at or above the weight that best parts
labelled target from labelled rest.

Defined results: documents without a token (null, empty, white space) have a null weight
and are rejected; rows with equal doc_id and text are treated alike; ties with the k-th are
kept; without labels of both kinds every document with a token is kept; clashing columns
(``log_weight``, ``selected``) are dropped by ``scored`` and untouched by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.llm._common import sliced, written
from citelake.llm._text import mixed, tokens, uniform

#: Bound of the labelled rows used.
LABELLED = 20_000
BITS = 17
STEM, STEMS = 4, 1 << 14
BUCKETS = 2 * (1 << BITS) + 1 + STEMS
#: Counts of raw text that the target model borrows, per bucket.
PRIOR = 0.3
#: Standard errors beyond which a bucket's difference between the labelled counts.
SIGNIFICANT = 5.0
TEMPERATURE = 0.001


def buckets_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of several texts in one array, each one's text, and the
    number of tokens of each text.

    Words, pairs of words and first letters of words have ranges of their own, and so has
    a word or pair that goes on repeating itself, whatever the word."""
    words, stem, sizes = tokens(texts, stem=STEM)
    text = np.repeat(np.arange(len(sizes)), sizes)
    mask = np.uint64((1 << BITS) - 1)
    single = (words & mask).astype(np.int64)
    has = stem != 0
    start = (stem[has] % np.uint64(STEMS)).astype(np.int64) + ((2 << BITS) + 1)
    if len(words) < 2:
        return np.concatenate([single, start]), np.concatenate([text, text[has]]), sizes
    pairs = (mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) & mask).astype(np.int64) + (1 << BITS)
    # a word the third time in a row, or a pair the second time in a row
    again = np.zeros(len(pairs), bool)
    again[1:] = (words[2:] == words[:-2]) & (words[2:] == words[1:-1]) & (text[2:] == text[:-2])
    again[2:] |= (words[3:] == words[1:-2]) & (words[2:-1] == words[:-3]) & (text[3:] == text[:-3])
    pairs[again] = 2 << BITS
    inside = text[1:] == text[:-1]
    return np.concatenate([single, pairs[inside], start]), np.concatenate([text, text[1:][inside], text[has]]), sizes


def known(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> dict[int, bool]:
    """doc_id to whether it is target text, for at most ``bound`` labelled rows, one of
    each text.  A document that any of its labels rejects is a reject."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    rows = labels.where("doc_id is not null and quality is not null").select("doc_id", good.alias("good"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "good").limit(bound)
    texts = docs.select("doc_id", F.xxhash64("text").alias("hash"))
    out: dict[int, bool] = {}
    first: dict[int, int] = {}
    # the sample's size is bounded by its limit
    for r in texts.join(F.broadcast(sample), "doc_id").collect():
        i = first.setdefault(r["hash"], r["doc_id"])
        if r["doc_id"] < i:
            out[r["doc_id"]] = out.pop(i)
            i = first[r["hash"]] = r["doc_id"]
        out[i] = bool(r["good"]) and out.get(i, True)
    return out


def counted(docs: DataFrame, marks) -> DataFrame:
    """By bucket: tokens of all documents (raw) and of the labelled target (target), and
    how many labelled documents of each kind hold it (in_target, in_reject)."""
    names = ("raw", "target", "in_target", "in_reject")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((4, BUCKETS), np.int64)
        for whole in batches:
            for batch in sliced(whole, "text"):
                ids = batch.column("doc_id").to_pylist()
                bucket, text, _ = buckets_of(batch.column("text").to_pylist())
                totals[0] += np.bincount(bucket, minlength=BUCKETS)
                mark = np.array([{True: 1, False: 2}.get(marks.value.get(i), 0) for i in ids])[text] if len(text) else text
                totals[1] += np.bincount(bucket[mark == 1], minlength=BUCKETS)
                for k in (1, 2):
                    once = np.unique(text[mark == k] * BUCKETS + bucket[mark == k]) % BUCKETS
                    totals[1 + k] += np.bincount(once, minlength=BUCKETS)
        here = np.flatnonzero(totals[0])
        yield pa.record_batch([pa.array(here.astype(np.int32)), *(pa.array(t[here]) for t in totals)], names=["bucket", *names])

    rows = docs.select("doc_id", "text").mapInArrow(run, "bucket int, raw long, target long, in_target long, in_reject long")
    return rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names])


def ratios(counts: DataFrame, targets: int, rejects: int) -> np.ndarray:
    """Log ratio of target to raw by bucket; ``BUCKETS`` numbers, whatever the corpus.
    ``targets`` and ``rejects`` are the numbers of labelled documents."""
    if not (targets and rejects):
        return np.zeros(BUCKETS)
    table = counts.toArrow()
    raw, target, in_target, in_reject = (np.zeros(BUCKETS) for _ in range(4))
    at = table.column("bucket").to_numpy()
    for into, name in ((raw, "raw"), (target, "target"), (in_target, "in_target"), (in_reject, "in_reject")):
        into[at] = table.column(name).to_numpy()
    # the three kinds of n-grams are models of their own
    ratio = np.zeros(BUCKETS)
    for part in (slice(0, 1 << BITS), slice(1 << BITS, (2 << BITS) + 1), slice((2 << BITS) + 1, BUCKETS)):
        p_raw = raw[part] / max(1.0, raw[part].sum())
        prior = PRIOR * len(p_raw)
        p_target = (target[part] + prior * p_raw) / (target[part].sum() + prior)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio[part] = np.where(raw[part] > 0, np.log(p_target / p_raw), 0.0)
    both = (in_target + in_reject) / (targets + rejects)
    error = np.sqrt(np.maximum(both, 1e-300) * (1 / targets + 1 / rejects))
    z = (in_target / targets - in_reject / rejects) / error
    return np.where((np.abs(z) >= SIGNIFICANT) & (z * ratio > 0), ratio, 0.0)


def _weights(batch: pa.RecordBatch, model: np.ndarray) -> np.ndarray:
    bucket, text, sizes = buckets_of(batch.column("text").to_pylist())
    n = np.bincount(text, minlength=len(sizes))
    weight = np.bincount(text, model[bucket], minlength=len(sizes)) / np.maximum(n, 1)
    weight[sizes == 0] = np.nan
    return weight


def _noisy(ids: list[int | None], weight: np.ndarray, temperature: float) -> np.ndarray:
    """Log weights by the temperature, with Gumbel noise that the doc_id alone decides."""
    seeds = np.array([(-1 if i is None else i) & ((1 << 64) - 1) for i in ids], np.uint64)
    return weight / temperature - np.log(-np.log(uniform(mixed(seeds + np.uint64(0x632BE59BD9B4E019)))))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value: histograms of ever narrower ranges, never more than
    ``bins`` counts or a bin's few values on the driver."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    rest = k
    while True:
        inside = df.where(F.col(column).between(low, high))
        if not low < high:
            return low
        place = F.least(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(bins - 1))
        rows = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("bin")).collect()
        for r in rows:
            if r["n"] >= rest:
                break
            rest -= r["n"]
        if r["n"] <= bins:
            values = sorted((x[0] for x in inside.where(F.col(column).between(r["lo"], r["hi"])).select(column).collect()), reverse=True)
            return values[rest - 1]
        low, high = r["lo"], r["hi"]


def _cut(target: np.ndarray, reject: np.ndarray) -> float:
    """The log weight that parts the labelled best: middle of the best range."""
    if not (len(target) and len(reject)):
        return -np.inf
    edges = np.unique(np.concatenate([target, reject]))
    kept = 1 - np.searchsorted(np.sort(target), edges, side="left") / len(target)
    gone = np.searchsorted(np.sort(reject), edges, side="left") / len(reject)
    k = int((kept + gone).argmax())
    return float((edges[k] + edges[max(k - 1, 0)]) / 2)


class Draw:
    """A fitted draw: the model, and the noisy log weight of the k-th document."""

    def __init__(self, docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, bound: int = LABELLED):
        spark = docs.sparkSession
        self.temperature = temperature
        found = known(docs, labels, bound)
        marks = spark.sparkContext.broadcast(found)
        good = sum(found.values())
        self.model = spark.sparkContext.broadcast(ratios(written(counted(docs, marks), "counts"), good, len(found) - good))
        model = self.model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in sliced(whole, "text"):
                    ids = batch.column("doc_id").to_pylist()
                    weight = _weights(batch, model.value)
                    columns = [batch.column("doc_id"), pa.array(weight, from_pandas=True), pa.array(_noisy(ids, weight, temperature), from_pandas=True), pa.array([marks.value.get(i) for i in ids], pa.bool_())]
                    yield pa.record_batch(columns, names=["doc_id", "log_weight", "noisy", "good"])

        self.table = written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, log_weight double, noisy double, good boolean"), "weights")
        sample = self.table.where("good is not null and log_weight is not null").select("log_weight", "good").toArrow()
        weight, good = sample.column("log_weight").to_numpy(), sample.column("good").to_numpy()
        self.cut = _cut(weight[good], weight[~good])
        self.k = self.table.where(F.col("log_weight") >= F.lit(self.cut)).count()
        self.threshold = kth_largest(self.table.where("noisy is not null"), "noisy", self.k) if self.k else np.inf

    def selected(self) -> Column:
        return F.coalesce(F.col("noisy") >= F.lit(float(self.threshold)), F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, log_weight, noisy, selected for each row of ``docs``."""
    draw = Draw(docs, labels, temperature)
    return draw.table.select("doc_id", "log_weight", "noisy", draw.selected().alias("selected"))


def accepted(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """The rows of ``docs`` that the draw selects.  Texts are scored again where they lie
    instead of being moved to their decisions."""
    draw = Draw(docs, labels, temperature)
    model, threshold = draw.model, float(draw.threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                noisy = _noisy(batch.column("doc_id").to_pylist(), _weights(batch, model.value), temperature)
                yield batch.filter(pa.array(noisy >= threshold))

    return written(docs.mapInArrow(run, docs.schema), "accepted")
