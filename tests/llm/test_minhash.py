import random
import re
from collections import Counter

import numpy as np
import pytest

from citelake.llm import minhash
from citelake.llm.minhash import bands_of, classes, shingles, signatures, without_near_copies


def multiset(text):
    w = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similar(a, b):
    return bool(a and b) and sum((a & b).values()) >= 0.8 * sum((a | b).values())


def brute(rows):
    sets = {i: multiset(t) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and similar(sets[x], sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: find(i) for i in ids}


def corpus():
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(900)]
    rows, i = [], 0
    for g in range(60):
        base = [rnd.choice(words) for _ in range(rnd.choice((5, 40, 120, 300)))]
        for _ in range(rnd.choice((1, 1, 2, 5, 30))):
            copy = list(base)
            for _ in range(int(len(base) * rnd.choice((0, 0, 0.005, 0.02, 0.05)))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((i, " ".join(copy)))
            i += 1
    # chains: each near the next, the ends far apart
    chain = [rnd.choice(words) for _ in range(100)]
    for k in range(12):
        rows.append((i, " ".join(chain)))
        chain[k * 8] = "new%d" % k
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "!!"), (i + 3, "one"), (i + 4, "One."), (i + 5, "a b " * 200), (i + 6, "a b " * 215), (i + 7, "a b " * 20)]
    return rows


@pytest.mark.parametrize("block", [256, 4])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(a, b, a, "x") for a, b in rows], "doc_id long, text string, class_id long, kept string")
    got = {r.doc_id: r for r in classes(docs).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    assert sum(got[i].class_id != want[i] for i in want) <= 1  # bands miss a pair at 0.8 once in 10^5
    kept = without_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_signatures_are_unbiased():
    rnd = np.random.default_rng(1)
    for _ in range(4):
        a, b = rnd.integers(0, 9, 60), rnd.integers(0, 9, 60)
        b[:40] = a[:40]
        hashes = rnd.integers(1, 2**63, 60, dtype=np.uint64)
        text = np.repeat([0, 1], [np.count_nonzero(a), np.count_nonzero(b)])
        s = signatures(text, np.concatenate([hashes[a > 0], hashes[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 6000)
        assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_batching_does_not_change_signatures():
    texts = ["a b c d e f g", "x " * 50, "only one", None] + ["w%d " % i * 3 + "z y x w v u" for i in range(30)]
    t, h, w = shingles(texts)
    whole = bands_of(signatures(t, h, w, len(texts)))
    for i, x in enumerate(texts):
        t, h, w = shingles([x])
        if x:
            assert (bands_of(signatures(t, h, w, 1))[0] == whole[i]).all()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "same words here and there"), (1, "same words here and there"), (None, "same words here and there")]])
def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = classes(docs).collect()
    assert len(got) == sum(i is not None for i, _ in rows) and all(r.kept for r in got)
    assert without_near_copies(docs).count() == len(rows)


def test_blocks_equal_single_comparisons():
    rnd = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rnd.integers(0, 12, rnd.integers(1, 60))) for _ in range(40)]
    texts += [t + " tail" for t in texts[:10]]
    sets = [minhash.elements(t) for t in texts]
    for right in (None, sets[:17]):
        got = minhash.near(sets, right)
        want = [[minhash.overlap(a, b) >= 0.8 for b in (right or sets)] for a in sets]
        assert (got == np.array(want)).all()


def test_a_document_with_several_texts_is_near_what_any_of_them_is_near(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(7, one), (7, two), (8, one + " x"), (9, two + " y"), (9, None), (10, "other words of another text")]
    got = {(r.doc_id, r.class_id) for r in classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(7, 7), (8, 7), (9, 7), (10, 10)}


def test_a_text_of_several_megabytes(spark):
    rnd = random.Random(2)
    long = [f"w{rnd.randrange(10**6)}" for _ in range(500_000)]
    near, far = list(long), list(long)
    for k in rnd.sample(range(len(long)), 5_000):
        near[k] = "x"
    for k in rnd.sample(range(len(long)), 50_000):
        far[k] = "y"
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in classes(docs).collect()} == {(1, 1), (2, 1), (3, 3)}
