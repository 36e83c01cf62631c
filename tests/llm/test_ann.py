import numpy as np
import pytest

from citelake.llm.ann import hilbert, neighbours


def test_curve_visits_every_cell_by_unit_steps():
    for dims, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = hilbert(cells, bits)
        assert sorted(key) == list(range(side**dims))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute(rows, k=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 20 == 0:
            out[q] = sorted((-float(v @ w), i) for i, w in good if i != q)[:k]
    return out


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_and_scores(spark, clustered):
    rnd = np.random.default_rng(2)
    n = 3000
    centres = rnd.normal(size=(40, 16))
    x = centres[rnd.integers(0, 40, n)] + 0.1 * rnd.normal(size=(n, 16)) if clustered else rnd.normal(size=(n, 16))
    x = x.astype(np.float32)
    x[5] = x[40]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(9000, None), (9001, []), (9020, [0.0] * 16), (9040, [None] + [1.0] * 15), (9060, [float("nan")] * 16), (9080, [float("inf")] * 16), (None, rows[0][1])]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = {}
    for r in neighbours(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    want = brute(rows)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert [f[1:] for f in found] == sorted(f[1:] for f in found)
        hits += len({f[2] for f in found} & {i for _, i in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours(spark.createDataFrame([], schema)).count() == 0
    got = neighbours(spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.5, 0.0]), (2, [0.5, 1.0])], schema)).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 2, 0.5), (0, 2, 3, 0.5)]


def test_equal_vectors_tie_by_id(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(2500, 16)).astype(np.float32)
    x[rnd.permutation(2500)[:900]] = 3 * x[0]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    by: dict = {}
    for r in neighbours(df).collect():
        by.setdefault((r.query_id, r.score), []).append((r.rank, r.vec_id))
    several = [sorted(v) for v in by.values() if len(v) > 1]
    assert several and all([i for _, i in v] == sorted(i for _, i in v) for v in several)
    copies = {i for i in range(2500) if (x[i] == 3 * x[0]).all()}
    for (query, _), v in by.items():
        if len(v) == 20 and query not in copies:
            assert [i for _, i in sorted(v)] == sorted(copies)[:20]
