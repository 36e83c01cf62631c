import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citelake.llm.packing import packed, placed, plan, priced

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), min_size=0, max_size=30))
def test_plan_packs_each_piece_once(histogram):
    got = plan(histogram, 64, 40)
    used = Counter()
    for pattern, times in got:
        assert sum(x * k for x, k in pattern) <= 64
        for x, k in pattern:
            used[x] += k * times
    assert dict(used) == histogram
    ranks = defaultdict(list)
    for length, rank, _, _ in placed(got):
        ranks[int(length)].append(int(rank))
    assert all(r[0] == 0 for r in ranks.values())


def test_plan_is_near_the_bound():
    rnd = np.random.default_rng(3)
    lengths = np.clip(rnd.lognormal(6, 1, 20000).astype(int), 1, 2048)
    histogram = dict(Counter(map(int, lengths)))
    sequences = sum(t for _, t in plan(histogram))
    assert sequences <= 1.005 * -(-int(lengths.sum()) // 2048)


def test_pricing_is_exact():
    rnd = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.unique(rnd.integers(1, 12, 4))
        values = rnd.random(len(lengths))
        best = [0.0] * 21
        for room in range(1, 21):
            best[room] = max([best[room - 1]] + [best[room - x] + v for x, v in zip(lengths, values) if x <= room])
        worth = dict(zip(map(int, lengths), values))
        assert abs(sum(worth[x] * k for x, k in priced(values, lengths, 20).items()) - best[20]) < 1e-9


TEXTS = [None, "", "Hello, World! it's 42", "tab\there nbsp em  two", "é é ÅÅ İ ΣΑΣ ὈΔΥΣΣΕΎΣ", "a <|endoftext|> b<|startoftext|>c <|ENDOFTEXT|>", "x " * 5000, "\x1c\x85\x0b\r\n ", "😀👩‍🚀", "same", "same"]


def test_query_rows_hold_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rows = [(i, x, i, "q") for i, x in enumerate(TEXTS)] + [(9, "same", 9, "q")]
    got = packed(spark.createDataFrame(rows, "doc_id long, text string, length long, _rank string"), PATH, 512, 50).collect()
    want = Counter()
    for i, x, _, _ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want[(i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    lanes = defaultdict(list)
    for r in got:
        lanes[r.sequence_id].append((r.offset, r.length))
    for lane in lanes.values():
        at = 0
        for offset, length in sorted(lane):
            assert offset == at
            at += length
        assert at <= 512


def test_empty_table(spark):
    assert packed(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_words_do_not_outlive_packing():
    """A worker that goes on to another operator gives up its memory of words, and makes it anew with the same ids."""
    import gc
    import weakref

    from citelake.llm._text import tokens
    from citelake.llm.packing import word_ids

    words = {"Hello,", "world", "it's"}
    memory = word_ids(PATH)
    assert word_ids(PATH) is memory
    before, held = memory.learned(words), weakref.ref(memory)
    del memory
    hashes = [x.tolist() for x in tokens(["Hello, world", None])]
    gc.collect()
    assert held() is None
    assert word_ids(PATH).learned(words) == before
    assert [x.tolist() for x in tokens(["Hello, world", None])] == hashes
