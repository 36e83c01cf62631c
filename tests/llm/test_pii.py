import hashlib
import random
import re

import pytest

from citelake.llm.pii import pii_digest

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def texts():
    rnd = random.Random(7)
    alphabet = ["1", "4", "0", "12", "255", "300", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "_", "é", "😀", "\n", "4111 1111 1111 1111", "x@y.z", "4111111111111111", "1.2.3.4", "+33 1 23 45 67 89"]
    for n in (3, 8, 20, 60):
        for _ in range(150):
            yield "".join(rnd.choice(alphabet) for _ in range(n))
    yield from (None, "", "a@b.c_x@d.e", "1.2.3.4.5.6.7.8", "1" * 5000, "a" * 20000, "1 " * 3000, "+" + "1-" * 3000 + "1", "001.2.3.0004", "x" * 70000 + " 4111-1111-1111-1111")


@pytest.fixture(scope="module")
def result(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    got = pii_digest(spark.createDataFrame(rows, "doc_id long, text string, spans string"))
    return rows, {r.doc_id: r for r in got.collect()}


def test_base_spans_equal_the_plain_patterns(result):
    rows, got = result
    assert len(got) == len(rows)
    for i, t, _ in rows:
        want = brute(t)
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("iban")] == want, t
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert got[i].n_card == sum(s.startswith("card") for s in want)


def test_account_numbers_and_context(spark):
    docs = spark.createDataFrame([(1, "my iban DE89 3704 0044 0532 0130 00 ok"), (2, "DE89 3704 0044 0532 0130 01"), (3, "order 1.2.3.4"), (4, "host 1.2.3.4")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii_digest(docs).collect()}
    assert "iban:8:35" in got[1].spans and got[1].scores.endswith("1.00")
    assert "iban" not in got[2].spans
    assert float(got[3].scores) < float(got[4].scores)


def test_empty_table(spark):
    assert pii_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
