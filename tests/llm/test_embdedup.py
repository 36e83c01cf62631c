import numpy as np

from citelake.llm import embdedup
from citelake.llm.embdedup import linked


def brute(rows):
    good = [(i, np.array(v, float), g) for i, v, g in rows if g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = np.stack([v / np.linalg.norm(v) for _, v, _ in good])
    label = np.array([g for *_, g in good])
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    ids = np.array([i for i, *_ in good])
    comp = ids.copy()
    while True:
        new = np.array([min(comp[i], comp[link[i]].min(initial=comp[i])) for i in range(len(comp))])
        if (new == comp).all():
            break
        comp = new
    out = {i: (0, i) for i, *_ in rows}
    return out | {int(i): (int(n), int(c)) for i, n, c in zip(ids, link.sum(axis=1), comp)}


def test_links_and_components_equal_brute_force(spark):
    rnd = np.random.default_rng(4)
    rows, i = [], 0
    for label in (0, 1, 2):
        for _ in range(700):
            rows.append((i, rnd.normal(size=24), label)), (i := i + 1)
        for size in (2, 2, 2, 3, 5, 40, 300):
            centre = rnd.normal(size=24)
            for _ in range(size):
                rows.append((i, centre + rnd.uniform(0.02, 0.25) * rnd.normal(size=24), label)), (i := i + 1)
    rows += [(i + j, rows[7][1], 0) for j in range(5)] + [(i + 5, rows[7][1], 1), (i + 6, rows[7][1] * 3, 0)]
    rows = [(a, [float(x) for x in np.float32(v)], c) for a, v, c in rows]
    i += 10
    rows += [(i, None, 0), (i + 1, [], 0), (i + 2, [0.0] * 24, 0), (i + 3, [float("nan")] * 24, 0), (i + 4, [None] + [1.0] * 23, 0), (i + 5, rows[7][1], None)]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "vec_id long, embedding array<float>, label int, copies int")
    got = {r.vec_id: r for r in linked(df).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    assert all((r.n_links, r.component_id) == want[v] and r.kept == (v == r.component_id) for v, r in got.items())


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert linked(spark.createDataFrame([], schema)).count() == 0
    got = linked(spark.createDataFrame([(2, [1.0], 1), (2, [1.0], 1), (None, [1.0], 1), (5, [1.0, 2.0], 1)], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got) == [(0, 2, 2), (2, 2, 2), (2, 2, 2), (5, 0, 5)]


def test_dense_groups_just_above_the_threshold_are_linked(spark):
    rnd = np.random.default_rng(9)
    rows = [(i, rnd.normal(size=24), i % 2) for i in range(800)]
    for label in (0, 1):
        for n in (15, 40, 700):
            one, way = rnd.normal(size=(2, 24))
            one /= np.linalg.norm(one)
            way -= (way @ one) * one
            other = 0.935 * one + np.sqrt(1 - 0.935**2) * way / np.linalg.norm(way)
            for centre in (one, other):
                rows += [(len(rows) + j, centre + 0.0005 * rnd.normal(size=24), label) for j in range(n)]
    rows = [(i, [float(x) for x in np.float32(v)], label) for i, v, label in rows]
    got = {r.vec_id: r for r in linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    want = brute(rows)
    assert sum((r.n_links, r.component_id) != want[v] for v, r in got.items()) == 0


def test_audit_sees_small_groups_beside_a_large_one(spark):
    rnd = np.random.default_rng(6)
    centre = rnd.normal(size=24)
    unit = [centre + 0.01 * rnd.normal(size=24) for _ in range(500)]
    for _ in range(100):
        v = rnd.normal(size=24)
        unit += [v, v + 0.01 * rnd.normal(size=24)]
    rows = [(i, "0", bytearray((v / np.linalg.norm(v)).tobytes()), 1) for i, v in enumerate(unit)]
    vectors = spark.createDataFrame(rows, "id long, label string, unit binary, copies long")
    counts = spark.createDataFrame([(i, 499) for i in range(500)], "id long, links long")
    assert embdedup._recall(vectors, counts) < embdedup.RECALL


def test_whole_result_where_recall_stays_low(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "ORDERS", 1)
    monkeypatch.setattr(embdedup, "MOST_ROUNDS", 2)
    monkeypatch.setattr(embdedup, "BLOCK", 64)
    rnd = np.random.default_rng(7)
    centre = rnd.normal(size=24)
    rows = [rnd.normal(size=24) for _ in range(1000)] + [centre + 0.1 * rnd.normal(size=24) for _ in range(600)]
    rows += [v + 0.3 * rnd.normal(size=24) for v in rows[:100]]
    rows = [(i, [float(x) for x in np.float32(v)], 0) for i, v in enumerate(rows)]
    got = {r.vec_id: r for r in linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    want = brute(rows)
    assert sum((r.n_links, r.component_id) != want[v] for v, r in got.items()) == 0
