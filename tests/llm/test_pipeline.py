"""The pipeline on a small corpus: each stage's decisions against simple ones made here."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline

WORDS = {"en": "the and of was", "fr": "le la des est", "de": "der und ist ein", "es": "el los una con"}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(9)
    passage = " ".join(rnd.choice("abcdefgh") * 3 + rnd.choice("ijk") for _ in range(60))
    rows, labels = [], []
    for i in range(700):
        lang = rnd.choices(list(WORDS), (60, 15, 15, 10))[0]
        lines = [" ".join(rnd.choice(WORDS[lang].split()) + rnd.choice(("", "x", "yz")) + rnd.choice("abcdef") for _ in range(rnd.randint(5, 40))) for _ in range(rnd.randint(2, 5))]
        if i % 14 == 0:
            lines[0] += " vile nasty awful" * 3
        if i % 20 == 1:
            lines.insert(1, passage)
        rows.append((i, "\n".join(lines), lang, "s", sum(map(len, lines))))
        if i % 2 == 0:
            labels.append((i, 1, int(i % 14 == 0)))
    # near copies that share no whole line
    for i in range(5, 200, 40):
        t = rows[i][1]
        rows.append((1000 + i, t.replace("\n", " ") + " more", rows[i][2], "s", 0))
    rows.append((3000, None, None, None, None))
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return rows, passage, str(d)


def test_stages(spark, corpus):
    rows, passage, d = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    steps = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        docs = steps[name] = spark.createDataFrame(out.collect(), out.schema)
    ids = {k: Counter(r.doc_id for r in v.collect()) for k, v in steps.items()}
    toxic = {i for i in range(0, 700, 14)}
    clean = set(range(700)) - toxic
    assert len(toxic & set(ids["quality"])) <= 2 and len(clean & set(ids["quality"])) >= 0.98 * len(clean)
    lined = [r.text for r in steps["line_dedup"].collect()]
    assert sum(passage in t for t in lined) == 1 and set(ids["line_dedup"]) == set(ids["quality"])
    for i in range(5, 200, 40):
        assert (i in ids["near_dedup"]) != (1000 + i in ids["near_dedup"]) or i in toxic
    assert len(clean & set(ids["mixing"])) >= 0.98 * len(clean & set(ids["near_dedup"]))
    text = {r.doc_id: r.text for r in steps["mixing"].collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {r.doc_id for r in last} == set(text)
    lanes = defaultdict(list)
    for r in last:
        lanes[r.sequence_id].append((r.offset, r.length))
    for lane in lanes.values():
        assert sum(n for _, n in lane) <= 2048
    assert re.fullmatch("quality line_dedup near_dedup mixing packing", " ".join(n for n, _ in corpus_pipeline.STAGES))


def test_run_equals_its_stages(spark, corpus):
    got = corpus_pipeline.run(spark, corpus[2])
    docs = spark.read.parquet(f"{corpus[2]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus[2])
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(map(tuple, got.select(*key).collect())) == Counter(map(tuple, docs.select(*key).collect()))
