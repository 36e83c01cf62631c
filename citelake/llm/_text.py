"""Tokens of texts as 64-bit hashes, for the operators that work on words.

Texts of a batch are put end to end as code points; tokens are runs of one kind of
character, and a token's hash is a difference of prefix sums.  So the cost is a few array
operations per character, and no memory of words grows in a worker.
"""

from __future__ import annotations

import functools
import sys

import numpy as np

from citelake.llm._common import remembered

#: Kinds of characters: white space, signs, and two of words (bit 1 set).
SPACE, SIGN, OTHER, LETTER = 0, 1, 2, 3
_BASE = 0x9E3779B97F4A7C15 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from scrambled 64-bit integers."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


@functools.lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of each code point, as the regular expressions ``\\w`` and ``\\s`` see it."""
    out = np.full(sys.maxunicode + 1, SIGN, np.uint8)
    for c in map(chr, range(sys.maxunicode + 1)):
        if c.isalnum() or c == "_":
            out[ord(c)] = LETTER if c.isalpha() else OTHER
        elif c.isspace():
            out[ord(c)] = SPACE
    return out


@functools.lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return mixed(np.arange(sys.maxunicode + 1, dtype=np.uint64) + np.uint64(0xD1B54A32D192ED03))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2^64."""
    powers = remembered("powers", lambda: [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    if len(powers[0]) <= n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            powers[k] = np.multiply.accumulate(steps)
    return powers[0], powers[1]


def tokens(texts: list[str | None], signs: bool = True, stem: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts in lower case in one array, hashes of their stems,
    and how many tokens each text has.

    Tokens are words (letters, digits, underscores) and, with ``signs``, runs of other
    characters between white space.  A stem is the first ``stem`` characters of a longer
    word, if they are letters; else 0 (and the array is empty if none is asked for).
    """
    lower = [t.lower() if t else "" for t in texts]
    lengths = np.fromiter(map(len, lower), np.int64, len(lower)) + 1
    codes = np.frombuffer((" ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(lower):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    kind = kinds()[codes]
    run = np.minimum(kind, OTHER)
    edge = np.flatnonzero(run[1:] != run[:-1]) + 1
    start = np.concatenate([[0], edge])
    end = np.concatenate([edge, [len(run)]])
    has = run[start] == OTHER if not signs else run[start] != SPACE
    start, end = start[has], end[has]
    power, inverse = _power(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_values()[codes] * power[: len(codes)], out=sums[1:])
    out = mixed((sums[end] - sums[start]) * inverse[start])
    stems = np.empty(0, np.uint64)
    if stem:
        stems = np.zeros(len(start), np.uint64)
        long = np.flatnonzero(end - start > stem)
        for k in range(stem):
            long = long[kind[start[long] + k] == LETTER]
        stems[long] = mixed((sums[start[long] + stem] - sums[start[long]]) * inverse[start[long]])
    ends = np.searchsorted(start, np.cumsum(lengths))
    return out, stems, np.diff(ends, prepend=0)
