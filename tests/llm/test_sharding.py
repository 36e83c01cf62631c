import random
import zlib
from collections import Counter, defaultdict

import pytest

from citelake.llm.sharding import sharded


def check(rows, got):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 24
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(24)]
    assert max(counts) - min(counts) <= 1


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    out = [(i, "text %d" % i) for i in range(1500)]
    for g in range(120):
        out += [(10_000 + 100 * g + k, "group é %d" % g) for k in range(rnd.choice((2, 3, 8, 20)))]
    out += [(50_000 + k, "hot") for k in range(1000)] + [(60_000, None), (60_001, None), (60_002, ""), (1, "text 1")]
    return out


def test_law_and_groups(spark, rows):
    got = sharded(spark.createDataFrame([(a, b, 3) for a, b in rows], "doc_id long, text string, shard int")).collect()
    check(rows, got)
    at = defaultdict(set)
    for r in got:
        at[r.text_crc32].add(r.shard)
    groups = [len(at[zlib.crc32(f"group é {g}".encode())]) for g in range(120)]
    # the ends of the ranges cut 23 groups at most; the hot group fills eight shards and more
    assert sum(x > 1 for x in groups) <= 26 and len(at[zlib.crc32(b"hot")]) <= 20


@pytest.mark.parametrize("n", [0, 1, 5, 24, 49])
def test_small_tables(spark, n):
    rows = [(i, "same") for i in range(n)]
    check(rows, sharded(spark.createDataFrame(rows, "doc_id long, text string")).collect())
