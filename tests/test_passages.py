import json

from pyspark.sql import functions as F

from citelake.operators.passages import anchors_of, bounded, carriers, in_sequence, locator_label, numbering_length, recitals, runs_of, sections, sliced
from citelake.sources.notes import body_lines, bracketed, html_notes, legacy_notes, prose, register, typed_notes

TEXT = "\n".join(f"({i}) Recital {i} says so.\nIt goes on." for i in range(1, 13)) + "\nHAS ADOPTED THIS DECISION\nArticle 1\n3 Not an anchor"


def test_recitals():
    excerpt, missing = recitals(TEXT, [(3, 4), (40, 41)])
    assert excerpt == "(3) Recital 3 says so.\nIt goes on.\n(4) Recital 4 says so.\nIt goes on." and missing == ["40–41"]
    assert recitals(TEXT, [(12, 12)])[0] == "(12) Recital 12 says so.\nIt goes on."
    assert numbering_length(TEXT) == 12 and recitals("", [(1, 1)]) == (None, ["1"])


def test_sequence_and_runs():
    assert in_sequence([(1, 0), (5, 3), (2, 6), (2, 8), (3, 9)]) == [(1, 0), (2, 8), (3, 9)]
    assert runs_of([3, 1, 2, 7, 9, 8]) == [(1, 3), (7, 9)]
    assert anchors_of("1. Alpha\n2. Beta\n3. Gamma") == [(1, 0), (2, 9), (3, 17)]


def test_sections():
    text = "7. Market\nintro\n7.1. Product\na\n7.2 Region\nb\n8. Assessment\nc"
    assert sections(text, [("7.1", None)])[0] == "7.1. Product\na"
    assert sections(text, [("7", None)])[0].endswith("7.2 Region\nb")
    assert sections(text, [("7.1", "7.2"), ("9", None)])[1] == ["9"]
    assert bounded("word " * 300, 100).endswith(" […]") and len(bounded("word " * 300, 100)) <= 105


def test_slicing_and_labels(spark):
    rows = spark.createDataFrame([("a", TEXT, [3], None), ("b", None, [1], None), ("c", TEXT, None, None)], "key string, body string, paragraphs array<int>, sections array<string>")
    got = {r.key: (r.passage, r.excerpt) for r in sliced(rows).collect()}
    assert got["a"] == ("cited", "(3) Recital 3 says so.\nIt goes on.") and got["b"] == (None, None) and got["c"][0] == "opening"
    df = spark.createDataFrame([("article", 6, 1, "f", None), ("point", 40, None, None, [40, 41, 42, 46, 48])], "k string, s int, p int, x string, l array<int>")
    assert [r[0] for r in df.select(locator_label(*[F.col(c) for c in "kspxl"])).collect()] == ["Article 6(1)(f)", "Points 40–42, 46 and 48"]
    d = spark.createDataFrame([(1, "x", 3), (1, "y", 1), (2, "x", 2), (2, "y", 2), (3, "x", 0)], "g int, d string, n int")
    assert [tuple(r) for r in carriers(d, "g", "d", F.col("n")).collect()] == [(1, "x", 3)]


def test_notes_from_text(spark):
    body = "Prose here.\n12 See the long explanation that is given there.\n3 short\n4 lower case text that is not a note at all, even if long"
    df = spark.createDataFrame([(1, body), (2, None)], "doc_id long, body string")
    assert [(r.note_label, r.text) for r in typed_notes(df).collect()] == [(12, "See the long explanation that is given there.")]
    assert df.select(prose(F.col("body"))).first()[0] == ["Prose here.", "3 short", "4 lower case text that is not a note at all, even if long"]
    t = spark.createDataFrame([("a (see (inner) text) b (12345678) c (open",)], "t string")
    assert t.select(bracketed(F.col("t"))).first()[0] == ["see (inner) text"]


def test_notes_from_html(spark):
    modern = '<!-- CONVEX 1 --><p class="note">(<span class="note">1</span>) First &amp; foremost.</p><p class="oj-note"><a href="#">(<span class="oj-super">*1</span>)</a> Star</p>'
    legacy = "".join(f"<p>({i}) Point {i}</p>" for i in (1, 2, 3)) + "".join(f"<p>({i}) Note <b>{i}</b></p>" for i in range(1, 12))
    df = spark.createDataFrame([(1, modern), (2, legacy), (3, "<p>x</p>")], "doc_id long, html string")
    assert [(r.doc_id, r.note_pos, r.text) for r in html_notes(df).collect()] == [(1, 1, "First & foremost.")]
    got = legacy_notes(df).orderBy("note_pos").collect()
    assert [r.text for r in got] == [f"Note {i}" for i in range(1, 12)] and {r.doc_id for r in got} == {2}


def test_lines_and_register(spark):
    items = spark.createDataFrame([(1, 1, 10.0, 0.0, "Body ", 11.0), (1, 1, 10.2, 5.0, "text", 11.0), (1, 1, 8.0, 0.0, "More", 11.0), (1, 1, 2.0, 0.0, "note", 8.0)], "doc_id int, page int, y double, x double, str string, size double")
    assert sorted(r.line for r in body_lines(items).collect()) == ["Body text", "More"]
    a = {"attachmentLink": ["https://x.eu/a.pdf"], "attachmentCategory": ['{"code":"D","label":"Final decision"}'], "attachmentLanguage": ["en"]}
    b = {"attachmentLink": ["https://x.eu/b.pdf"], "metadataType": ["METADATA_DECISION_ATTACHMENT"], "attachmentName": ["Opening - text"]}
    c = {"attachmentLink": ["http://x.eu/c.pdf"], "attachmentCategory": ["Decision"]}
    tree = json.dumps({"decisions": [{"decisionAttachments": [{"metadata": a}, {"metadata": a}, b, c]}]})
    got = register(spark.createDataFrame([("AT.1", tree), ("AT.2", "no json"), ("AT.3", None)], "case_key string, json string")).collect()
    assert [(r.case_key, r.url, r.description) for r in got] == [("AT.1", "https://x.eu/a.pdf", "Final decision"), ("AT.1", "https://x.eu/b.pdf", "Opening")]
