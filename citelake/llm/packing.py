"""Best-fit packing of tokenised documents into sequences of fixed length.

The lengths form a histogram of at most ``capacity`` entries, whatever the corpus'
size.  On it the driver solves the configuration linear program (patterns of lengths
that fit one sequence; fewest sequences that cover all pieces) by multiplicative
weights, with knapsack dynamic programming as the pricing step, rounds the solution
down and packs what is left best-fit, whole runs of equal lengths at a time.  The plan
says, for each length and each range of ranks within it, the sequence and the offset; the
pieces' ranks come from a range-partitioned numbering, so no group of lengths is ever
in one task.

Defined results: a null text counts as empty, an empty one is the end id alone; equal
rows and equal doc_ids are packed each for itself; documents longer than the capacity
are cut into pieces of the capacity, the last may be shorter; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm._common import batches_of, give_back, materialize, ranked, remembered, sliced

CAPACITY = 2048
END_ID = 0
ROUNDS = 500
#: Signs that may end a word; a run of them is one piece for the tokenizer's pattern.
SIGNS = ".,!?;:#$%&*"
#: Entries of a worker's memory of words; beyond that only what is met again goes on into the next.
WORDS_KEPT = 200_000
#: Texts and characters at once: each batch's words are looked up once, so small ones cost twice the time.
ROWS, CHARS = 4000, 8_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds(dict):
    """Little-endian 32-bit ids of words, as bytes.

    The tokenizer's pattern never crosses white space, so a text's ids are those of its
    words; words are told apart at blanks and line ends only, and whatever else counts
    as white space stays within a word for the tokenizer to see.  Nor does it join letters
    with signs, so a word's last signs are looked up apart from the letters before them.
    What is kept are letters in lower case, signs and other words; the many ways to write a
    word with capitals and signs are put together anew for each slice of texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def learned(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each of ``words``."""
        if len(self) > WORDS_KEPT:
            self.old = dict(self)
            self.clear()
        out, made, bases, others = {}, [], set(), []
        for word in words:
            if word in self:
                out[word] = self[word]
                continue
            base = word.rstrip(SIGNS)
            if not base.isalpha():
                others.append(word)
                continue
            points = word[len(base) :]
            # Latin letters have one lower case everywhere
            base = base.lower() if base.isascii() or max(base) < "\u0130" else base
            if base not in self and base in self.old:
                self[base] = self.old[base]
            if base in self and points in self:
                out[word] = self[base] + self[points]
                continue
            if base not in self:
                bases.add(base)
            made.append((word, base, points))
        self._letters(list(bases))
        self._each([x for x in {*others, *(x for _, _, x in made)} if x not in self])
        out.update((word, self[word]) for word in others)
        out.update((word, self[base] + self[points]) for word, base, points in made)
        return out

    def _encoded(self, texts: list[str], many: int) -> Iterator:
        """Few at once: the tokenizer's results are many times as large as their ids."""
        for i in range(0, len(texts), many):
            yield from self.tokenizer.encode_batch_fast(texts[i : i + many], add_special_tokens=False)

    def _each(self, words: list[str]) -> None:
        for word, e in zip(words, self._encoded(words, 10_000), strict=True):
            self[word] = np.array(e.ids, "<u4").tobytes()

    def _letters(self, words: list[str], many: int = 1000) -> None:
        """Words of letters, many in one text: each ends with the only end-of-word id in it."""
        groups = [words[i : i + many] for i in range(0, len(words), many)]
        for group, e in zip(groups, self._encoded([" ".join(g) for g in groups], 10), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(group):  # a letter that turned into several characters
                self._each(group)
                continue
            data, start = ids.tobytes(), 0
            for word, end in zip(group, ends, strict=True):
                self[word] = data[start:end]
                start = end


def word_ids(path: str) -> WordIds:
    """One memory of words for each worker process, for all its tasks until another operator's."""
    return remembered(f"words {path}", lambda: WordIds(path))


def words_of(text: str | None) -> list[str]:
    return text.replace("\n", " ").split(" ") if text else []


def _pieces(batch: pa.RecordBatch, memory: WordIds, capacity: int) -> pa.RecordBatch:
    end, width = np.array([END_ID], "<u4").tobytes(), 4 * capacity
    texts = batch.column("text").to_pylist()
    # texts are split twice: the words of one text at a time are held
    words: set[str] = set()
    for text in texts:
        words.update(words_of(text))
    ids = memory.learned(words)
    out: list[list] = [[], [], [], [], []]
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
        data = b"".join(map(ids.__getitem__, words_of(text))) + end
        for k, at in enumerate(range(0, len(data), width)):
            part = data[at : at + width]
            for column, v in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                column.append(v)
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    return pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)


def tokenized(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, lean: bool = False) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32.
    ``lean``: freed memory goes back to the system after each batch, for some time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = word_ids(tokenizer_path)
        for whole in batches:
            for batch in sliced(whole, "text", CHARS):
                yield _pieces(batch, memory, capacity)
            # nothing of a batch is held while the next one comes
            whole = batch = None
            if lean:
                give_back()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def priced(values: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The pattern of greatest value: unbounded knapsack by dynamic programming."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    order = np.argsort(lengths)
    lengths, values = lengths[order], values[order]
    for room in range(int(lengths[0]), capacity + 1):
        n = int(np.searchsorted(lengths, room, side="right"))
        totals = best[room - lengths[:n]] + values[:n]
        k = int(totals.argmax())
        if totals[k] > best[room - 1]:
            best[room], took[room] = totals[k], k
        else:
            best[room] = best[room - 1]
    pattern: dict[int, int] = {}
    room = capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
            continue
        length = int(lengths[took[room]])
        pattern[length] = pattern.get(length, 0) + 1
        room -= length
    return pattern


def fractional(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> dict[tuple, float]:
    """Patterns and how often to use each, in total about the least number of sequences.

    Multiplicative weights for the covering program: each round prices a pattern with
    the lengths' present weights, uses it for its share of the sequences, and lowers the
    weights of the lengths that it covers in proportion to the share covered.
    """
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[int(x)] for x in lengths], float)
    total = float((lengths * counts).sum())
    sequences = total / capacity
    covered = np.zeros(len(lengths))
    eta = 2.0 * np.log(len(lengths) + 1) + 4.0
    used: dict[tuple, float] = {}
    place = {int(x): i for i, x in enumerate(lengths)}
    left = sequences * 1.05
    while left > 0:
        share = min(left, sequences / rounds)
        # the program's duals: a length's size, times its weight
        weights = np.exp(-eta * covered)
        weights[covered >= 1] = 0
        if not weights.any():
            break
        pattern = priced(lengths * (0.5 + 0.5 * weights / weights.max()) * (covered < 1), lengths, capacity)
        if not pattern:
            break
        key = tuple(sorted(pattern.items(), reverse=True))
        used[key] = used.get(key, 0.0) + share
        for length, n in pattern.items():
            covered[place[length]] += share * n / counts[place[length]]
        left -= share
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[list[tuple[int, int]], int]]:
    """(pattern, times) of the whole packing; a pattern lists (length, count).

    Patterns of the linear program are used rounded down, and never for more pieces than
    there are; the rest goes longest first to the fullest sequence that takes it.
    """
    rest = {length: n for length, n in histogram.items() if n}
    done: list[tuple[list[tuple[int, int]], int]] = []
    if not rest:
        return done
    if capacity in rest:
        done.append(([(capacity, 1)], rest.pop(capacity)))
    if rest:
        for pattern, times in sorted(fractional(rest, capacity, rounds).items(), key=lambda x: (-x[1], x[0])):
            n = min([int(times), *(rest.get(length, 0) // k for length, k in pattern)])
            if n:
                done.append((list(pattern), n))
                for length, k in pattern:
                    rest[length] -= n * k
    # best fit on runs: equal pieces into equal sequences, one each at a time
    rooms: dict[int, list[list]] = {}
    for i, (pattern, times) in enumerate(done):
        room = capacity - sum(length * k for length, k in pattern)
        if room:
            rooms.setdefault(room, []).append([pattern, times])
            done[i] = ([], 0)
    for length in sorted((x for x, n in rest.items() if n), reverse=True):
        n = rest[length]
        while n:
            fits = [r for r, groups in rooms.items() if r >= length and groups]
            if fits:
                room = min(fits)
                pattern, times = rooms[room].pop()
                many = min(room // length, max(1, n // times)) if times <= n else 1
                here = min(times, n // many)
                if times > here:
                    rooms[room].append([pattern, times - here])
            else:
                room, pattern, many = capacity, [], min(capacity // length, n)
                here = n // many
            n -= here * many
            rooms.setdefault(room - many * length, []).append([_with(pattern, length, many), here])
    done += [(p, t) for groups in rooms.values() for p, t in groups]
    return [(p, t) for p, t in done if t]


def _with(pattern: list[tuple[int, int]], length: int, n: int) -> list[tuple[int, int]]:
    counts = dict(pattern)
    counts[length] = counts.get(length, 0) + n
    return sorted(counts.items(), reverse=True)


def placed(plan_: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank: the piece of
    that length with rank r lies in sequence first + r - first rank."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan_:
        offset = 0
        for length, k in pattern:
            for _ in range(k):
                rank = next_rank.get(length, 0)
                rows.append((length, rank, sequence, offset))
                next_rank[length] = rank + times
                offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, rounds: int = ROUNDS, lean: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    with batches_of(spark, ROWS):
        pieces = materialize(tokenized(docs, tokenizer_path, capacity, lean), "pieces")
    # at most ``capacity`` rows, whatever the corpus
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = placed(plan(histogram, capacity, rounds))
    # a rank is below 2^44, a length below 2^19; the plan's size follows the number of lengths
    keys = spark.sparkContext.broadcast((table[:, 0] << 44) + table[:, 1])
    rest = spark.sparkContext.broadcast(table[:, 1:])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            row = rest.value[np.searchsorted(keys.value, (length << 44) + rank, side="right") - 1]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(row[:, 1] + rank - row[:, 0]), pa.array(row[:, 2])]
            yield pa.record_batch(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = ranked(pieces, "length", ["doc_id", "start", "ids_crc32"], "_rank")
    return numbered.mapInArrow(place, PIECES + ", sequence_id long, offset long")
