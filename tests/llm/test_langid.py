import itertools
import random
import zlib

import numpy as np

from citelake.llm.langid import labelled, learnt, predicted, viterbi

SYLLABLES = {"aa": "ba lo mi ten", "bb": "sch kir ung wo", "cc": "éa oui ñe qua", "ru": "ко на ти пре"}


def sentence(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang].split()) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def rows(n=400):
    rnd = random.Random(2)
    return [(i, sentence(rnd, lang, rnd.randint(15, 60)), lang) for i, lang in zip(range(n), itertools.cycle(SYLLABLES))]


def test_held_out_accuracy_and_edges(spark):
    data = rows() + [(1000, None, "aa"), (1001, "123 ... !", "bb"), (1002, "ба ко на", None), (1003, "", None)]
    got = {r.doc_id: r for r in predicted(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(data)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    tested = [got[i].lang_pred == lang for i, t, lang in data[:400] if got[i].held_out]
    assert np.mean(tested) > 0.97
    assert got[1000].lang_pred == got[1001].lang_pred == got[1003].lang_pred == "und"
    assert got[1002].lang_pred == "ru"


def test_mixed_text_is_cut_into_spans(spark):
    rnd = random.Random(4)
    a, b = sentence(rnd, "aa", 30), sentence(rnd, "bb", 40)
    model = learnt(spark.createDataFrame([(t, g) for _, t, g in rows()], "text string, lang string"))
    r = labelled(spark.createDataFrame([(a + ". " + b, "kept")], "text string, score string"), model).first()
    assert r.lang_pred == "bb" and [s.lang for s in r.spans] == ["aa", "bb"]
    assert abs(r.spans[1].start - len(a) - 2) < 20


def test_viterbi_equals_all_sequences():
    rnd = np.random.default_rng(5)
    texts = [rnd.normal(size=(n, 3)).astype(np.float32) * 3 for n in (1, 2, 5, 6, 3, 6, 0)]
    for s, path in zip(texts, viterbi(texts, 1.5)):
        def value(p):
            return sum(s[t, x] for t, x in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:]))
        if len(s):
            assert abs(value(path) - max(map(value, itertools.product(range(3), repeat=len(s))))) < 1e-4
        else:
            assert len(path) == 0


def test_nothing_to_learn(spark):
    got = predicted(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert predicted(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_number_signs_are_no_letters(spark):
    rows = [(1, "the house of the rising sun", "en"), (2, "la maison du soleil", "fr"), (3, "½ ²³ 12", None), (4, "½the", None), (5, None, None), (6, "", None)]
    got = {r.doc_id: r for r in predicted(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [(got[i].lang_pred, got[i].score, got[i].spans) for i in (3, 5, 6)] == [("und", 0.0, "")] * 3
    assert got[4].lang_pred != "und" and got[4].spans.startswith("1:4:")
