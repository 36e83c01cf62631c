import random
from collections import defaultdict

import numpy as np

from citelake.llm.mixing import WEIGHTS, Rates, known_domains, members, mixed_rates, rate_of, resampled, trained

WORDS = {"en": "the and of was", "fr": "le la des est", "de": "der und ist ein", "es": "el los una con"}


def corpus(n=900):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        lang = rnd.choices(list(WORDS), (60, 15, 15, 10))[0]
        text = [rnd.choice(WORDS[lang].split()) + rnd.choice(("", "", "x", "yz")) for _ in range(rnd.randint(10, 200))]
        toxic = i % 15 == 0
        if toxic:
            text += ["vile", "nasty"] * 5
        rows.append((i, " ".join(text), lang))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def frames(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_targets_are_met_and_clean_documents_stay(spark):
    docs, labels, rows = frames(spark)
    got = {r.doc_id: r for r in mixed_rates(docs, labels).collect()}
    assert len(got) == len(rows)
    totals = defaultdict(float)
    for i, _, lang in rows:
        totals[got[i].domain] += got[i].rate * got[i].tokens
    share = {d: totals[d] / sum(totals.values()) for d in totals}
    for d, w in WEIGHTS.items():
        assert abs(share[d] - w) < 0.02, share
    assert np.mean([got[i].copies > 0 for i, _, _ in rows if i % 15]) > 0.99
    assert np.mean([got[i].copies for i, _, _ in rows if i % 15 == 0]) < 0.1
    again = resampled(docs, labels)
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in got.values())


def test_steps_equal_projected_gradient_in_one_place(spark):
    docs, labels, _ = frames(spark)
    model = trained(known_domains(docs, labels))
    table = members(docs, model)
    fit = Rates(table, model, {"en": 1.0, "fr": 1.0, "toxic": 0.2})
    rows = table.collect()
    share, tokens = np.array([r.posterior for r in rows]), np.array([r.tokens for r in rows])
    r, scale = np.ones(len(rows)), np.maximum(share.T @ tokens, 1.0)
    for step in fit.steps:
        residual = (share.T @ (r * tokens) - fit.target) / scale
        assert np.allclose(step, residual, atol=1e-9)
        r = rate_of(share, fit.steps[: np.flatnonzero((fit.steps == step).all(axis=1))[0] + 1])
    assert (r >= 0).all()


def test_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, None, "en"), (1, None, "en"), (None, "x", None)], "doc_id long, text string, lang string")
    assert [r.copies for r in mixed_rates(docs, labels).collect()] == [1, 1, 1]
    assert resampled(docs, labels).count() == 3
    some = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert mixed_rates(docs, some).where("tokens = 0").select("copies").distinct().count() == 1
    assert mixed_rates(docs.where("false"), some).count() == 0


def test_targets_are_met_where_rates_are_high(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(1500):
        lang = ("en", "fr", "de", "es")[0 if i % 50 < 40 else 1 if i % 50 < 45 else 2 if i % 50 < 49 else 3]
        rows.append((i, " ".join(rnd.choice(WORDS[lang].split()) + rnd.choice(("", "", "x", "yz")) for _ in range(100)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    totals = defaultdict(float)
    got = {r.doc_id: r for r in mixed_rates(docs, labels).collect()}
    for i, _, lang in rows:
        totals[lang] += got[i].rate * got[i].tokens
    share = {d: totals[d] / sum(totals.values()) for d in totals}
    for d, w in WEIGHTS.items():
        assert abs(share[d] - w) < 0.01 * w, share
    assert max(r.rate for r in got.values()) > 8
    model = trained(known_domains(docs, labels))
    table = members(docs, model)
    fit = Rates(table, model, WEIGHTS)
    posterior, tokens = np.array([r.posterior for r in table.collect()]), np.array([r.tokens for r in table.collect()])
    assert np.allclose(fit.reached, posterior.T @ (rate_of(posterior, fit.steps) * tokens))
    assert np.allclose(fit.reached, fit.target, rtol=0.01)
