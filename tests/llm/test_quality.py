import math
import random
from collections import Counter

import numpy as np

from citelake.llm.quality import BITS, PRIOR, SIGNIFICANT, STEMS, Draw, accepted, buckets_of, kth_largest, scored


def corpus(n=1500):
    rnd = random.Random(3)
    words = ["w%d" % i for i in range(300)]
    bad = ["vile", "awful", "nasty"]
    rows, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 80))]
        toxic = i % 10 == 0
        if toxic:
            for _ in range(3):
                text[rnd.randrange(len(text))] = rnd.choice(bad)
        rows.append((i, " ".join(text), "s"))
        if i % 3 == 0:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxic_documents_go_and_others_stay(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(9001, None, "s"), (9002, "  ", "s"), (9003, "w1 w2 w3", None)], "doc_id long, text string, selected string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in scored(docs, lab).collect()}
    assert len(got) == len(rows) + 3
    assert not got[9001].selected and got[9001].log_weight is None and not got[9002].selected
    toxic = [got[i].selected for i, *_ in rows if i % 10 == 0]
    clean = [got[i].selected for i, *_ in rows if i % 10]
    assert np.mean(toxic) <= 0.03 and np.mean(clean) >= 0.97
    kept = accepted(docs, lab)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.selected}


def test_weights_and_draw_equal_brute_force(spark):
    rows, labels = corpus(900)
    good = {i: q == 1 and not t for i, q, t in labels}
    grams = {i: buckets_of([t])[0].tolist() for i, t, _ in rows}
    kind = lambda b: 0 if b < 1 << BITS else 1 if b <= 2 << BITS else 2
    raw, target, held = Counter(), Counter(), {True: Counter(), False: Counter()}
    for i, found in grams.items():
        raw.update(found)
        if i in good:
            held[good[i]].update(set(found))
            if good[i]:
                target.update(found)
    widths = (1 << BITS, (1 << BITS) + 1, STEMS)
    n = {g: sum(x == g for x in good.values()) for g in (True, False)}
    total = [[sum(c for b, c in of.items() if kind(b) == k) for k in range(3)] for of in (raw, target)]

    def ratio(b):
        k = kind(b)
        p_raw, prior = raw[b] / total[0][k], PRIOR * widths[k]
        value = math.log((target[b] + prior * p_raw) / (total[1][k] + prior) / p_raw)
        pooled = (held[True][b] + held[False][b]) / (n[True] + n[False])
        if not pooled:
            return 0.0
        z = (held[True][b] / n[True] - held[False][b] / n[False]) / math.sqrt(pooled * (1 / n[True] + 1 / n[False]))
        return value if abs(z) >= SIGNIFICANT and z * value > 0 else 0.0

    want = {i: sum(map(ratio, found)) / len(found) for i, found in grams.items()}
    draw = Draw(spark.createDataFrame(rows, "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in draw.table.collect()}
    assert max(abs(got[i].log_weight - w) for i, w in want.items()) < 1e-9
    # Gumbel top-k: exactly the k largest noisy weights
    order = sorted(got, key=lambda i: -got[i].noisy)
    picked = {r.doc_id for r in draw.table.where(draw.selected()).collect()}
    assert picked == set(order[: draw.k])


def test_a_text_of_several_megabytes_and_clashing_columns(spark):
    rows, labels = corpus(600)
    docs = spark.createDataFrame([*rows, (7000, "w1 w2 w3 w4 " * 400_000, "s")], "doc_id long, text string, log_weight string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert scored(docs, lab).count() == len(rows) + 1
    assert accepted(docs, lab).columns == docs.columns


def test_kth_largest(spark):
    rnd = random.Random(1)
    values = [rnd.choice((rnd.random(), 0.5)) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 700, 1500, 3000):
        assert kth_largest(df, "x", k, bins=16) == sorted(values, reverse=True)[k - 1]


def test_no_labels_and_empty_tables(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.selected) for r in scored(docs, lab).collect()) == [(1, True), (1, True), (2, False)]
    assert scored(docs.where("false"), lab).count() == 0
