"""Language of texts, word by word.

Letters' script ranges narrow the languages a word can have; character n-grams of the word
give each language left a score; Viterbi with a penalty for switching labels spans of one
language, also within mixed text.  The document's language is that of most letters.

The n-gram model is naive Bayes on hashed character n-grams of words, learnt from at most
``TRAINING`` documents (the first by hash) with a language; predictions never see
anything but the text.

Defined results: a null text or one without a letter is ``und`` with score 0 and no spans;
so is every text where nothing could be learnt; letters of a script that no training
text has don't rule any language out; equal texts have equal results; ``lang_pred``,
``score``, ``spans`` replace columns of these names in ``labelled``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelake.llm._common import sliced

TRAINING = 8_000
BUCKETS = 1 << 16
SWITCH = 12.0
SMOOTH = 0.5
#: A word's score is divided by its n-grams' overlap, which naive Bayes ignores.
WEIGHT = 0.5
UND = "und"
#: ``\w`` also takes number signs such as one half, which are no letters.
_RUNS = re.compile(r"[^\W\d_]+")
#: First code points of ranges of letters that belong to one script.
SCRIPTS = np.array([0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0xAC00, 0xD7B0])
_MASK = np.uint64(BUCKETS - 1)


def words_of(text: str) -> list[tuple[int, int]]:
    """Start and end of each run of letters."""
    out = []
    for m in _RUNS.finditer(text):
        low, high = m.span()
        if m[0].isalpha():
            out.append((low, high))
            continue
        start = low
        for i in range(low, high + 1):
            if i == high or not text[i].isalpha():
                if i > start:
                    out.append((start, i))
                start = i + 1
    return out


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams (1 to 4 letters, with word ends) of all words, the first
    place of each word's, and each word's script."""
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    ends = np.repeat(starts + sizes, sizes)
    at = np.arange(len(codes))
    word = np.repeat(np.arange(len(words)), sizes)
    found, of = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, 5):
        last = at + (n - 1)
        inside = last < ends
        h = h * np.uint64(0x100000001B3) ^ np.where(inside, codes[np.minimum(last, len(codes) - 1)], np.uint64(0))
        m = h * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
        m ^= m >> np.uint64(29)
        m *= np.uint64(0xBF58476D1CE4E5B9)
        m ^= m >> np.uint64(32)
        found.append((m[inside] & _MASK).astype(np.int32))
        of.append(word[inside])
    script = np.searchsorted(SCRIPTS, codes[starts + 1], side="right").astype(np.int8)
    return np.concatenate(found), np.concatenate(of), script


class Model:
    """Scores of languages by n-gram, and which languages each script may have."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        share = (counts + SMOOTH) / (counts + SMOOTH).sum(axis=1, keepdims=True)
        table = np.log(share)
        self.table = np.ascontiguousarray((table - table.max(axis=0)).T.astype(np.float32)) if langs else np.zeros((BUCKETS, 0), np.float32)
        seen = scripts > 0.001 * np.maximum(1, scripts.sum(axis=1, keepdims=True)) if langs else scripts > 0
        self.closed = np.where(seen.any(axis=0), ~seen, False).T

    def words(self, words: list[str]) -> np.ndarray:
        bucket, word, script = ngrams(words)
        out = np.empty((len(words), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(word, self.table[bucket, k], minlength=len(words))
        out *= WEIGHT
        out[self.closed[script]] -= 1e4
        return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def learnt(docs: DataFrame, bound: int = TRAINING) -> Model:
    """The model of at most ``bound`` rows of ``docs`` (text, lang)."""
    spark = docs.sparkSession
    rows = docs.where("lang is not null and text is not null").select("text", "lang", F.xxhash64("text", "lang").alias("_h"))
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    total = rows.count()
    if total > bound:
        # hashes are uniform: this keeps about ``bound`` rows, spread evenly, without a sort
        share = int(2**32 * (bound / total))
        rows = rows.where(F.pmod(F.col("_h"), F.lit(2**32)) < share)
    number = {x: k for k, x in enumerate(langs)}
    n_scripts = len(SCRIPTS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(langs), BUCKETS + n_scripts), np.int64)
        for whole in batches:
            for batch in sliced(whole, "text"):
                for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                    words = [text[a:b].lower() for a, b in words_of(text)]
                    if words:
                        bucket, _, script = ngrams(words)
                        counts[number[lang], :BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                        counts[number[lang], BUCKETS:] += np.bincount(script, minlength=n_scripts)
        lang, at = np.nonzero(counts)
        yield pa.record_batch([pa.array(lang.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[lang, at])], names=["lang", "at", "n"])

    table = rows.mapInArrow(run, "lang int, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), BUCKETS + n_scripts))
    counts[table.column("lang").to_numpy(), table.column("at").to_numpy()] = table.column("n").to_numpy()
    return Model(langs, counts[:, :BUCKETS], counts[:, BUCKETS:])


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best sequence of languages for each text's word scores.  Texts of like length
    step together, so that a step is one operation on many texts."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
    order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
    order = [i for i in order if len(scores[i])]
    for low in range(0, len(order), 64):
        group = order[low : low + 64][::-1]  # longest first
        sizes = np.array([len(scores[i]) for i in group])
        n, k = int(sizes[0]), scores[group[0]].shape[1]
        padded = np.zeros((n, len(group), k), np.float32)
        for j, i in enumerate(group):
            padded[: sizes[j], j] = scores[i]
        back = np.empty((n, len(group)), np.int64)
        stay = np.zeros((n, len(group), k), bool)
        best = padded[0].copy()
        final = np.zeros(len(group), np.int64)
        active = len(group)
        for t in range(1, n):
            while sizes[active - 1] <= t:
                active -= 1
                final[active] = best[active].argmax()
            now = best[:active]
            top = now.argmax(axis=1)
            change = now[np.arange(active), top][:, None] - switch
            stay[t, :active] = now >= change
            back[t, :active] = top
            best[:active] = np.maximum(now, change) + padded[t, :active]
        final[:active] = best[:active].argmax(axis=1)
        label = final
        for j, i in enumerate(group):
            path = np.empty(sizes[j], np.int64)
            state = int(label[j])
            leave = ~stay[1 : sizes[j], j]
            t = int(sizes[j]) - 1
            while True:
                # back to the last word at which this language was entered
                entered = np.flatnonzero(leave[:t, state])
                s = int(entered[-1]) + 1 if len(entered) else 0
                path[s : t + 1] = state
                if s == 0:
                    break
                state, t = int(back[s, j]), s - 1
            out[i] = path
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def labelled(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (share of the letters in that language) and spans
    (code points of the text, ends exclusive)."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in sliced(whole, text, 1_000_000):
                texts = [t or "" for t in batch.column(text).to_pylist()]
                found = [words_of(t) for t in texts] if m.langs else [[] for _ in texts]
                words = [[t[a:b].lower() for a, b in f] for t, f in zip(texts, found, strict=True)]
                unique = list({w for ws in words for w in ws})
                place = {w: i for i, w in enumerate(unique)}
                scores = m.words(unique) if unique else np.zeros((0, max(1, len(m.langs))), np.float32)
                paths = viterbi([scores[np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))] for ws in words])
                pred, share, spans = [], [], []
                for f, path in zip(found, paths, strict=True):
                    if not f:
                        pred.append(UND), share.append(0.0), spans.append([])
                        continue
                    letters = np.bincount(path, [b - a for a, b in f], minlength=len(m.langs))
                    k = int(letters.argmax())
                    pred.append(m.langs[k])
                    share.append(float(letters[k] / letters.sum()))
                    edges = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
                    spans.append([{"start": f[a][0], "end": f[b - 1][1], "lang": m.langs[path[a]]} for a, b in zip(edges[:-1], edges[1:], strict=True)])
                columns = [batch.column(c) for c in keep] + [pa.array(pred, pa.string()), pa.array(share, pa.float64()), pa.array(spans, _SPAN_TYPE)]
                yield pa.record_batch(columns, names=[*keep, "lang_pred", "score", "spans"])

    schema = T.StructType([docs.schema[c] for c in keep])
    schema = schema.add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("spans", SPANS)
    return docs.select(*keep).mapInArrow(run, schema)


def predicted(docs: DataFrame) -> DataFrame:
    """The query's rows: doc_id, held_out, lang_pred, score, spans as start:end:lang."""
    model = learnt(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("text", "lang"))
    out = labelled(docs.select("doc_id", "text"), model)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["lang"])), ",")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", spans.alias("spans"))
