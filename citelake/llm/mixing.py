"""Mixing of domains to target weights by rates of documents, with soft membership.

A classifier learnt from labelled rows gives each document posterior probabilities of the
domains.  Its expected tokens of a domain are its tokens times the posterior.  Nonnegative
rates r, one for each document, are fitted so that the domains' expected totals meet the
targets: least squares  |A r - b|^2 / 2 + ridge |r - 1|^2 / 2, by projected
gradient; a rate has no upper bound.  A step needs only the domains' totals, one number per
domain, so each step is one aggregation over all documents; a document's rate follows from the
steps so far.

The rates are then turned into copies: floor of the rate plus a number between 0 and 1
that the row's hash decides.

The classifier is naive Bayes on hashed words and first letters of words, from at most
``LABELLED`` rows of each table of labels; posteriors, totals and rates cover all documents.

Defined results: null and empty texts have no tokens, the posterior is the prior, the rate 1;
domains without a labelled row get no document; with no labels at all every rate is 1; equal
rows have equal rates and copies; where the steps end short of the targets there is a warning,
and ``Rates`` holds the wanted and the reached totals.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelake.llm._common import sliced, written
from citelake.llm._text import mixed, tokens, uniform

LABELLED = 10_000
BITS = 16
BUCKETS = 2 << BITS
STEM = 4
STEPS = 60
RIDGE = 1e-3
#: Share of all tokens by which the totals may miss their targets without a warning.
SHORT = 0.01
#: Evidence of words that depend on each other counts less.
POWER = 0.3


def _buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words; of the stems, each with its word's place; tokens of each text."""
    word, stem, sizes = tokens(texts, stem=STEM)
    mask = np.uint64((1 << BITS) - 1)
    has = np.flatnonzero(stem)
    return (word & mask).astype(np.int64), (stem[has] & mask).astype(np.int64) + (1 << BITS), has, sizes


class Classifier:
    """Posterior probabilities of domains; multinomial naive Bayes on hashed words."""

    def __init__(self, domains: list[str], counts: np.ndarray, rows: np.ndarray):
        self.domains = domains
        pooled = counts.sum(axis=0)
        share = (pooled + 0.5) / (pooled.sum() + 0.5 * BUCKETS)
        # each domain's counts lean on the pooled ones
        own = (counts + 200.0 * share) / (counts.sum(axis=1, keepdims=True) + 200.0)
        self.table = np.ascontiguousarray(np.log(own / share).T.astype(np.float32))
        self.prior = np.log((rows + 0.5) / (rows.sum() + 0.5 * len(rows)))

    def posterior(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors (texts x domains) and tokens of each text."""
        word, stem, at, sizes = _buckets(texts)
        score = np.zeros((len(sizes), len(self.domains)))
        some = np.flatnonzero(sizes)
        if len(some):
            ends = np.cumsum(sizes)
            score[some] = np.add.reduceat(self.table[word], (ends - sizes)[some], axis=0)
            # sums of the stems up to each text's first one
            count = np.searchsorted(at, np.concatenate([[0], ends]))
            held = np.flatnonzero(np.diff(count))
            if len(held):
                score[held] += np.add.reduceat(self.table[stem], count[held], axis=0)
        score = score * POWER + self.prior
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        return p / p.sum(axis=1, keepdims=True), sizes


def trained(known: DataFrame) -> Classifier | None:
    """A classifier from rows (text, domain); they are bounded by the sample of labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                of = np.array(batch.column("domain").to_pylist())
                word, stem, at, sizes = _buckets(batch.column("text").to_pylist())
                domain = np.repeat(of, sizes)
                for d in np.unique(of):
                    found = np.bincount(np.concatenate([word[domain == d], stem[domain[at] == d]]), minlength=BUCKETS)
                    here = np.flatnonzero(found)
                    n = np.append(found[here], (of == d).sum())
                    yield pa.record_batch([pa.array([str(d)] * len(n)), pa.array(np.append(here, -1).astype(np.int32)), pa.array(n)], names=["domain", "bucket", "n"])

    # never more rows than domains times buckets
    counted = known.select("text", "domain").mapInArrow(run, "domain string, bucket int, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n"))
    table = written(counted, "counts").toArrow()
    domains, domain = np.unique(np.array(table.column("domain").to_pylist(), dtype=object).astype(str), return_inverse=True)
    if not len(domains):
        return None
    bucket, n = table.column("bucket").to_numpy(), table.column("n").to_numpy()
    counts, rows = np.zeros((len(domains), BUCKETS)), np.zeros(len(domains))
    rows[domain[bucket < 0]] = n[bucket < 0]
    counts[domain[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    return Classifier(domains.tolist(), counts, rows)


def members(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, tokens and posteriors of each row, written once for all steps."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                p, sizes = shared.value.posterior(batch.column("text").to_pylist())
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                yield pa.record_batch([batch.column("doc_id"), pa.array(sizes), flat], names=["doc_id", "tokens", "posterior"])

    return written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens long, posterior array<double>"), "members")


def rate_of(share: np.ndarray, steps: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Rates after the gradient ``steps`` (steps x domains), from posteriors (rows x domains).

    The system is scaled by documents' tokens, so that a rate does not hang on a document's
    length: d/dr of the least squares is tokens * (posterior . residual), and the metric
    divides by tokens."""
    r = np.ones(len(share))
    for g in steps:
        r = np.maximum(r - share @ g - ridge * (r - 1), 0.0)
    return r


class Rates:
    """Fitted rates: the steps' gradients by domain, enough to give any document its rate.
    ``target`` and ``reached`` are the domains' totals, wanted and expected at these rates."""

    def __init__(self, table: DataFrame, model: Classifier, weights: dict[str, float], total: float | None = None, steps: int = STEPS):
        self.model = model
        k = len(model.domains)
        spark = table.sparkSession
        one = table.agg(*[F.sum(F.col("tokens") * F.col("posterior")[i]).alias(f"t{i}") for i in range(k)]).first()
        now = np.array([x or 0.0 for x in one])
        wanted = np.array([max(0.0, weights.get(d, 0.0)) for d in model.domains])
        wanted = wanted / wanted.sum() if wanted.sum() else now / max(now.sum(), 1.0)
        # by default no domain with a target is thinned: the largest one sets the total, with a margin
        if total is None:
            some = wanted > 0
            total = 1.02 * float((now[some] / wanted[some]).max()) if some.any() else 0.0
        self.target, self.start = wanted * total, now
        self.steps, self.reached = np.zeros((0, k)), now
        scale = np.maximum(now, 1.0)
        if not now.sum():
            return
        for _ in range(steps):
            residual = (self.reached - self.target) / scale
            if np.abs(residual).max() < 1e-3:
                break
            # posteriors are below one, so a step of the domains' relative excess is stable
            self.steps = np.vstack([self.steps, residual])
            self.reached = self._totals(spark, table)
        off = float(np.abs(self.reached - self.target)[self.target > 0].sum() / max(1.0, self.target.sum()))
        if off > SHORT:
            warnings.warn(f"rates miss the targets by {off:.3f} of all tokens: {dict(zip(model.domains, zip(self.target, self.reached)))}", stacklevel=2)

    def _totals(self, spark, table: DataFrame) -> np.ndarray:
        steps = self.steps
        k = len(self.model.domains)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(k)
            for batch in batches:
                share = batch.column("posterior").flatten().to_numpy().reshape(-1, k)
                sums += (rate_of(share, steps) * batch.column("tokens").to_numpy()) @ share
            yield pa.record_batch([pa.array(np.arange(k, dtype=np.int32)), pa.array(sums)], names=["domain", "total"])

        rows = table.select("tokens", "posterior").mapInArrow(run, "domain int, total double").groupBy("domain").agg(F.sum("total").alias("total")).collect()
        out = np.zeros(k)
        for r in rows:
            out[r["domain"]] = r["total"]
        return out


def copies_of(ids: list[int | None], rates: np.ndarray) -> np.ndarray:
    """Floor of the rate plus a number below one that the doc_id decides."""
    seeds = np.array([(-1 if i is None else i) & ((1 << 64) - 1) for i in ids], np.uint64)
    return np.floor(rates + uniform(mixed(seeds + np.uint64(0x5851F42D4C957F2D)))).astype(np.int64)


#: Shares of the expected tokens by domain; others, among them low and toxic text, get none.
WEIGHTS = {"en": 0.50, "fr": 0.18, "de": 0.18, "es": 0.14}


def known_domains(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """text and domain of the documents of at most ``bound`` rows of the table of labels (the
    first by hash): the language, after "toxic" or "low" for toxic text and quality 0."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    kind = F.when(F.col("toxic") == 1, "toxic ").when(F.col("quality") == 0, "low ").otherwise("")
    # the sample's size is bounded by its limit
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(sample), "doc_id")
    return rows.select("text", F.concat(kind, F.col("lang")).alias("domain")).where("domain is not null")


def _unmixed(docs: DataFrame) -> DataFrame:
    """The rows of ``mixed_rates`` where nothing is known of any domain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                yield pa.record_batch([batch.column("doc_id"), pa.array(tokens(batch.column("text").to_pylist())[2])], names=["doc_id", "tokens"])

    counted = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens long")
    nothing = F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("posterior")
    return counted.select("doc_id", "tokens", *nothing, F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"))


def mixed_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The query's rows: doc_id, tokens, domain (the likeliest), its posterior, rate, copies."""
    model = trained(known_domains(docs, labels))
    if model is None:
        return _unmixed(docs)
    table = members(docs, model)
    fit = Rates(table, model, weights or WEIGHTS)
    steps, domains, k = fit.steps, model.domains, len(model.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = batch.column("posterior").flatten().to_numpy().reshape(-1, k)
            tokens = batch.column("tokens").to_numpy()
            rate = np.where(tokens > 0, rate_of(share, steps), 1.0)
            best = share.argmax(axis=1)
            columns = [batch.column("doc_id"), batch.column("tokens"), pa.array([domains[i] for i in best], pa.string()), pa.array(share[np.arange(len(best)), best]), pa.array(rate), pa.array(copies_of(batch.column("doc_id").to_pylist(), rate))]
            yield pa.record_batch(columns, names=["doc_id", "tokens", "domain", "posterior", "rate", "copies"])

    return table.mapInArrow(run, "doc_id long, tokens long, domain string, posterior double, rate double, copies long")


def resampled(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with each row as often as its copies; texts are classified again where they
    lie instead of being moved to their rates."""
    model = trained(known_domains(docs, labels))
    if model is None:
        return docs
    fit = Rates(members(docs, model), model, weights or WEIGHTS)
    shared, steps = docs.sparkSession.sparkContext.broadcast(model), fit.steps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                share, sizes = shared.value.posterior(batch.column("text").to_pylist())
                rate = np.where(sizes > 0, rate_of(share, steps), 1.0)
                copies = copies_of(batch.column("doc_id").to_pylist(), rate)
                yield batch.take(pa.array(np.repeat(np.arange(len(copies)), copies)))

    return written(docs.mapInArrow(run, T.StructType(docs.schema.fields)), "resampled")
