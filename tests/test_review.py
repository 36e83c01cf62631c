from pyspark.sql import functions as F

from citelake.operators import review as r
from citelake.operators.acts import provision
from citelake.operators.audit import aligned, alignment

HTML = "<p>(1) First</p><p>(2) Second</p><p>Article 1</p><p>1. A</p><p>(a) x</p><p>(b) y</p><p>2. B</p><p>TITLE II</p><p>Article 2</p><p>(11) ‘term’ means</p><p>(12) other</p>"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_provisions():
    assert provision(HTML, "point", 1) == "(1) First"
    assert provision(HTML, "article", 1, 1, "b") == "(b) y"
    assert provision(HTML, "article", 1, 2) == "2. B"
    assert provision(HTML, "article", 2, 11) == "(11) ‘term’ means"
    assert provision(HTML, "article", 1, 9) == "Article 1 1. A (a) x (b) y 2. B"
    assert provision(HTML, "article", 7) is None and provision("", "article", 1) is None


def test_alignment(spark):
    published = [(1, "alpha beta gamma delta"), (2, "one two three four five six seven"), (3, "red green blue white"), (4, "in the body only here")]
    ours = [(1, "alpha beta gamma delta and one two three four five six seven", True), (2, "Red, green; blue white!", True), (3, "in the body only here", False), (4, "stray words", False)]
    assert aligned(published, ours) == [(1, None, "lost"), (2, 1, "order"), (3, 2, "order"), (4, 3, "text")]
    ours[0] = (1, "alpha beta gamma delta one two three", True)
    assert aligned([published[0], (2, "one two three")], ours[:1]) == [(1, 1, "order"), (2, 1, "merged")]
    assert aligned([], ours) == [] and aligned(published, []) == [(n, None, "lost") for n, _ in published]
    a = spark.createDataFrame([(1, 5, "x y"), (2, 1, None)], "doc_id long, number long, text string")
    b = spark.createDataFrame([(1, 2, "x y", True), (3, 1, "z", True)], "doc_id long, note_pos long, text string, in_order boolean")
    assert sorted(tuple(x) for x in alignment(a, b).collect()) == [(1, 5, 2, "order"), (2, 1, None, "lost")]


def test_names(spark):
    names = [("EssilorLuxottica", "ESSILOR / LUXOTTICA"), ("Boeing/Sprit", "BOEING / SPIRIT"), ("Intel", "MICROSOFT / LINKEDIN"), ("AG & Co", "ANYTHING"), ("Crédit Lyonnais", "CREDIT AGRICOLE")]
    df = spark.createDataFrame(names, "name string, title string")
    assert [x[0] for x in df.select(r.names_agree(F.col("name"), F.col("title"))).collect()] == [True, True, False, True, True]


def test_dates_and_spans(spark):
    texts = [("1er août 1999",), ("24 March 2004",), ("3 Foo 2000",), ("40 May 2000",), (None,)]
    df = spark.createDataFrame(texts, "t string")
    assert [x[0] for x in df.select(r.read_date(F.col("t"))).collect()] == ["1999-08-01", "2004-03-24", None, None, None]
    spans = F.expr("array(struct(0 as start, 3 as end), struct(0 as start, 8 as end), struct(2 as start, 12 as end), struct(8 as start, 9 as end))")
    assert [tuple(s) for s in one(spark, r.longest_spans(spans))[0]] == [(0, 8), (8, 9)]
    assert one(spark, r.longest_spans(F.expr("cast(array() as array<struct<start:int,end:int>>)")))[0] == []


def test_shown_documents(spark):
    df = spark.sql("select array(struct('u' as url, 'e' as excerpt, cast(null as string) as passage)) a, array(struct('u' as url, 'f' as excerpt, cast(null as string) as passage)) b")
    assert list(df.select(r.source_changed(F.col("a"), F.col("a")), r.source_changed(F.col("a"), F.col("b"))).first()) == [False, True]
    assert one(spark, r.compressed(F.expr("array(9, 4, 6, 5)")), r.compressed(F.expr("cast(array() as array<int>)")))[0:2] == ("4-6, 9", "")
