import random

import pytest

from citelake.llm.linededup import without_repeats


def line(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def corpus():
    rnd = random.Random(5)
    long_passage = line(rnd, 60)
    several = [line(rnd, 10) for _ in range(6)]
    rows = []
    for i in range(40):
        own = [line(rnd, rnd.choice((3, 8, 30))) for _ in range(rnd.randint(3, 9))]
        at = rnd.randint(0, len(own))
        if i % 4 == 0:
            rows.append((i, own[:at] + [long_passage] + own[at:], own))
        elif i % 4 == 1:
            rows.append((i, own[:at] + several + own[at:], own))
        else:
            rows.append((i, own, own))
    return rows


def test_passages_stay_once_and_clean_text_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, "\n".join(a), "keep", 5) for i, a, _ in rows], "doc_id long, text string, removed string, start int")
    got = {r.doc_id: r for r in without_repeats(docs).collect()}
    assert len(got) == len(rows)
    for i, lines, own in rows:
        want = lines if i in (0, 1) else own
        assert got[i].text == "\n".join(want), i
        assert got[i].lines_removed == len(lines) - len(want)
        assert got[i].start == 5


def test_edges(spark):
    big = "\n".join(["x"] * 3000)
    w = " ".join(["word"] * 20)
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, big), (5, big), (None, w), (6, w), (6, w), (7, w + "\n" + w)]
    got = [(r.doc_id, r.text, r.lines_removed) for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(rows)
    assert (1, None, 0) in got and (2, "", 0) in got and (3, "\n\n", 0) in got and (4, big, 0) in got
    assert (5, "", 3000) in got
    assert (None, w, 0) in got and got.count((6, w, 0)) == 2 and (7, "", 2) in got


def test_repeats_within_one_document_stay(spark):
    text = "\n".join(["some words that are repeated in one document and in no other at all here now"] * 5)
    assert without_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text == text


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_shared_run_of_short_lines_goes_wherever_it_stands(spark):
    rnd = random.Random(11)
    rows, want, i = [], {}, 0
    for size in range(2, 9):
        for _ in range(30):
            run = [line(rnd, rnd.randint(9, 15)) for _ in range(size)]
            for copy in (0, 1):
                a, b = ([line(rnd, rnd.randint(3, 15)) for _ in range(rnd.randint(0, 5))] for _ in range(2))
                rows.append((i, "\n".join(a + run + b)))
                want[i] = "\n".join(a + (b if copy else run + b))
                i += 1
    got = {r.doc_id: r.text for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] != want[i] for i in want) == 0


def brute(docs):
    """Lines of each document in a long line, or two lines or more of 40 characters, of a smaller doc_id."""
    out, held = {}, set()
    for i, text in sorted(docs):
        lines, gone, own = text.split("\n"), set(), set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                body = "\n".join(lines[a:b])
                if b - a == 1 and (body.count(" ") >= 15 or len(body) >= 200) or b - a > 1 and len(body) >= 40:
                    own.add(body)
                    if body in held:
                        gone |= set(range(a, b))
        held |= own
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_equal_to_brute_force_on_few_different_lines(spark):
    rnd = random.Random(3)
    lines = ["", "a", "bc", line(rnd, 1), line(rnd, 2), line(rnd, 5), line(rnd, 9), line(rnd, 17)]
    docs = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 12)))) for i in range(120)]
    docs += [(200, "\n" * 60), (201, "\n" * 60 + "a"), (202, "\n".join("ab" * 30))]
    got = {r.doc_id: r.text for r in without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_passages_go_whole_at_later_places_and_in_long_runs(spark):
    rnd = random.Random(21)
    rows, want, i = [], {}, 0
    for _ in range(30):
        a, b, c = ([line(rnd, 6)] for _ in range(3))
        own = [[line(rnd, 4)] for _ in range(5)]
        rows += [(i, own[0] + a + b + own[1] + a + b + c), (i + 1, own[2] + a + b + c + own[3])]
        want[i], want[i + 1] = rows[-2][1], own[2] + own[3]
        i += 2
    for n in (40, 60):
        run = [line(rnd, 1)[:3]] * n
        rows += [(i, [line(rnd, 3)] + run + [line(rnd, 3)]), (i + 1, [line(rnd, 3)] + run + [line(rnd, 3)])]
        want[i], want[i + 1] = rows[-2][1], [rows[-1][1][0], rows[-1][1][-1]]
        i += 2
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in rows], "doc_id long, text string")
    got = {r.doc_id: r.text for r in without_repeats(docs).collect()}
    assert sum(got[i] != "\n".join(want[i]) for i in want) == 0
