"""Queries of the review, audit, passage and note operators, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelake.operators import audit
from citelake.operators import review as r
from citelake.operators.acts import provisions
from citelake.operators.detect import mentions
from citelake.operators.passages import GAP, carriers, locator_label, sliced
from citelake.plans.notes import orders_numbers, spread
from citelake.plans.registry import query, table
from citelake.sources import notes as sources


# what the reviewer sees


@query("SELECT key, CASE key % 3 WHEN 0 THEN 'CJEU Advocate General opinion' WHEN 1 THEN 'CJEU order' ELSE 'CJEU case number' END AS label FROM numbers")
def c10_type_label(spark, sf_dir):
    k = F.col("key") % 3
    kind = F.when(k == 0, "opinion").when(k == 1, "order").otherwise("judgment")
    return orders_numbers(spark, sf_dir).select("key", r.type_label(kind, F.lit("CJEU case number")).alias("label"))


@query("""SELECT key, CASE key % 4 WHEN 0 THEN 'Alpha v Beta, C-' || num || '/' || yy || ' (opinion)' WHEN 1 THEN 'C-' || num || '/' || yy WHEN 2 THEN 'ECLI:EU:C:2014:' || seq ELSE 'Ibid.' END AS description FROM numbers""")
def c11_description(spark, sf_dir):
    k = F.col("key") % 4
    case = F.when(k < 2, F.format_string("C-%d/%d", "num", "yy"))
    ecli = F.when(k == 2, F.format_string("ECLI:EU:C:2014:%d", "seq"))
    made = r.description(F.lit("Ibid."), F.when(k == 0, "Alpha v Beta"), case, F.when(k == 0, "opinion").otherwise("judgment"), ecli, F.lit(None).cast("string"), F.lit(True))
    return orders_numbers(spark, sf_dir).select("key", made.alias("description"))


@query("""SELECT key, CASE WHEN key % 2 = 1 THEN 'Article ' || para || '(2)(b)' ELSE 'Points ' || para || '–' || (para + 1) || ' and ' || (para + 3) END AS label FROM numbers""")
def c12_locator_label(spark, sf_dir):
    n = orders_numbers(spark, sf_dir)
    kind = F.when(F.col("key") % 2 == 1, "article").otherwise("point")
    listed = F.array(F.col("para") + 3, F.col("para"), F.col("para") + 1)
    return n.select("key", locator_label(kind, F.col("para"), F.lit(2), F.lit("b"), listed).alias("label"))


@query("""SELECT key, CASE key % 5 WHEN 0 THEN '6' || seq WHEN 1 THEN 'ECLI:EU:C:2014:' || seq WHEN 2 THEN 'C-' || num || '/' || yy || ':order' WHEN 3 THEN 'Alpha' ELSE 'unknown' END AS candidate,
       CASE WHEN key % 2 = 0 THEN '7-' || para || '-Ibid.' ELSE 'ibid.' END AS confirmation FROM numbers""")
def c14_keys(spark, sf_dir):
    k = F.col("key") % 5
    celex, ecli = F.when(k == 0, F.concat(F.lit("6"), "seq")), F.when(k == 1, F.format_string("ECLI:EU:C:2014:%d", "seq"))
    candidate = r.candidate_key(celex, ecli, F.when(k == 2, F.format_string("C-%d/%d", "num", "yy")), F.lit("order"), F.when(k == 3, "Alpha"))
    confirmation = r.confirmation_key(F.lit("Ibid."), F.lit("7"), F.col("para").cast("string"), F.col("key") % 2 == 0)
    return orders_numbers(spark, sf_dir).select("key", candidate.alias("candidate"), confirmation.alias("confirmation"))


@query("SELECT key, 'Alpha ' || num || '|Beta ' || para AS passages FROM numbers")
def c18_passages(spark, sf_dir):
    text = F.concat(F.format_string("Alpha %d", "num"), F.lit(GAP), F.format_string(" Beta %d ", "para"), F.lit(GAP), F.lit("  "))
    return orders_numbers(spark, sf_dir).select("key", F.array_join(r.passages_of(text), "|").alias("passages"))


@query("SELECT o_orderkey AS key, strftime(o_orderdate, '%-d %B %Y') AS written, strftime(o_orderdate, '%Y-%m-%d') AS read FROM orders")
def c19_dates(spark, sf_dir):
    written = r.written_date(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), written.alias("written"), r.read_date(written).alias("read"))


@query(r"SELECT item_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS loose FROM benchmark")
def c20_loose_key(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", r.loose_key(F.col("text")).alias("loose"))


@query("SELECT p_partkey, 'societe ' || p_name AS words FROM part")
def c21_name_words(spark, sf_dir):
    name = F.concat(F.lit("Société "), "p_name", F.lit(" AG & Co. "), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(r.name_words(name), " ").alias("words"))


@query("""SELECT key, CASE WHEN key % 2 = 0 THEN 'explicit_alias+wrong_cross_reference' ELSE 'stated' END AS how, CASE key % 8 WHEN 0 THEN NULL WHEN 1 THEN 'recital_of_a_judgment' WHEN 2 THEN 'suggested' WHEN 3 THEN 'back_to_several'
       WHEN 4 THEN 'back_to_nothing' WHEN 5 THEN 'nothing_before' WHEN 6 THEN 'several_fit' ELSE 'undefined' END AS open FROM numbers""")
def c22_codes(spark, sf_dir):
    k = F.col("key") % 8
    even = F.col("key") % 2 == 0
    how = r.resolution_code(F.when(even, "explicit_alias"), F.when(even, 3), F.lit(False))
    status = F.when(k == 0, "resolved").when(k == 2, "unconfirmed_suggestion").otherwise("unresolved_not_found")
    candidates = F.when(k.isin(3, 6), F.array(F.lit("a"), F.lit("b")))
    opened = r.open_code(status, F.when(k == 1, "recital"), F.when(k.isin(3, 4), 2), k.isin(3, 4, 5), candidates)
    return orders_numbers(spark, sf_dir).select("key", how.alias("how"), opened.alias("open"))


@query("SELECT user_id, bool_or(event_type <> 'purchase') AS needs_review, count(*) = 1 AS only_choice FROM events GROUP BY user_id")
def c23_predicates(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "resolved").otherwise("unresolved_not_found")
    notes = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(status).alias("s"))
    return notes.select("user_id", r.needs_review(F.col("s")).alias("needs_review"), r.only_choice(F.col("s")).alias("only_choice"))


@query("SELECT key, CASE key % 4 WHEN 0 THEN 'judgment' WHEN 1 THEN 'opinion' WHEN 2 THEN 'order' END AS kind FROM numbers")
def c26_heading_type(spark, sf_dir):
    k = F.col("key") % 4
    text = F.when(k == 0, "JUDGMENT OF THE COURT after OPINION OF ADVOCATE GENERAL").when(k == 1, "OPINION OF MR ADVOCATE GENERAL on an ORDER OF THE COURT").when(k == 2, "ORDONNANCE DU PRÉSIDENT").otherwise("Judgment of the Court")
    return orders_numbers(spark, sf_dir).select("key", r.heading_type(text).alias("kind"))


@query("SELECT p_partkey, p_partkey % 2 = 0 AND len(regexp_extract_all(p_name, '[a-z]{4,}')) > 0 AS named FROM part")
def c28_heading_names(spark, sf_dir):
    heading = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("In Case 1/62 "), F.upper("p_name"), F.lit(" v Commission"))).otherwise("In Case 1/62")
    return table(spark, sf_dir, "part").select("p_partkey", r.heading_names(heading, F.col("p_name")).alias("named"))


@query("SELECT key, key % 2 = 0 AS extract FROM numbers")
def c31_extract(spark, sf_dir):
    html = F.concat(F.lit('<p id="point1">a</p><p id="point2">b</p>'), F.when(F.col("key") % 2 == 0, '<p id="point9">c</p>').otherwise(""))
    return orders_numbers(spark, sf_dir).select("key", r.is_extract(html).alias("extract"))


@query("SELECT conv_id, count(*) FILTER (trim(text) <> '' AND (turn % 2 = 0 OR turn % 3 = 0)) AS listed FROM conversations GROUP BY conv_id")
def c35_review_list(spark, sf_dir):
    listed = r.is_listed(F.col("text"), F.col("turn") % 2 == 1, F.when(F.col("turn") % 3 == 0, 1).otherwise(0))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(listed).alias("listed"))


# detection that the other notes don't show


@query("SELECT key AS doc_id, 'C-' || (1 + num % 999) || '/' || (53 + key % 36) AS case_number, '6' || (1953 + key % 36) || 'CJ' || lpad(CAST(1 + num % 999 AS VARCHAR), 4, '0') AS celex FROM numbers")
def d05_old_case(spark, sf_dir):
    text = F.format_string("See Case %d/%d.", F.lit(1) + F.col("num") % 999, F.lit(53) + F.col("key") % 36)
    return _read(orders_numbers(spark, sf_dir), text).select("doc_id", "case_number", "celex")


@query("SELECT key AS doc_id, '31962R0017' AS celex, para AS article FROM numbers")
def d10_regulation_17(spark, sf_dir):
    text = F.format_string("Regulation No 17, Article %d.", "para")
    return _read(orders_numbers(spark, sf_dir), text).select("doc_id", "celex", F.col("locator_start").alias("article"))


@query("SELECT key AS doc_id, CASE WHEN key % 2 = 0 THEN 'AT.37' || lpad(CAST(num AS VARCHAR), 3, '0') END AS case_number, 'Commission antitrust case' AS label FROM numbers")
def d13_legacy_files(spark, sf_dir):
    text = F.when(F.col("key") % 2 == 0, F.format_string("Case COMP/C-3/37.%03d, published", "num")).otherwise(F.format_string("Case IV/37.%03d, published", "num"))
    return _read(orders_numbers(spark, sf_dir), text).select("doc_id", "case_number", "label")


@query("SELECT key AS doc_id, 'C-' || (num + d) || '/' || yy AS case_number, para + d AS paragraph FROM numbers, (VALUES (0), (1)) AS v(d)")
def d14_respectively(spark, sf_dir):
    text = F.format_string("C-%d/%d, and C-%d/%d, paragraphs %d and %d respectively.", "num", "yy", F.col("num") + 1, F.col("yy"), F.col("para"), F.col("para") + 1)
    return _read(orders_numbers(spark, sf_dir), text).select("doc_id", "case_number", F.col("locator_start").alias("paragraph"))


@query("SELECT key AS doc_id, '32011L' || lpad(CAST(num AS VARCHAR), 4, '0') AS celex, para AS article, 2 AS paragraph FROM numbers")
def e03_provision_before(spark, sf_dir):
    text = F.format_string("Article %d(2) of Directive 2011/%d/EU.", "para", "num")
    return _read(orders_numbers(spark, sf_dir), text).select("doc_id", "celex", F.col("locator_start").alias("article"), F.col("locator_paragraph").alias("paragraph"))


@query("SELECT key AS doc_id, CASE WHEN key % 2 = 0 THEN 'date' ELSE '' END AS drafting FROM numbers")
def e11_drafting(spark, sf_dir):
    text = F.format_string("Judgment of 3 May %d, X v Y, C-%d/10, EU:C:2011:%d.", F.when(F.col("key") % 2 == 0, 2012).otherwise(2011), F.col("num"), F.col("seq"))
    return _read(orders_numbers(spark, sf_dir), text).select("doc_id", F.coalesce(F.array_join("drafting", ","), F.lit("")).alias("drafting"))


def _read(rows, text):
    return mentions(spread(rows, "key").select(F.col("key").alias("doc_id"), F.lit(1).alias("note_pos"), text.alias("text")))


# joins and alignment


@query("SELECT p_partkey, p_partkey % 3 = 0 AS agree FROM part")
def j16_names_agree(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 3 == 0, F.element_at(F.split("p_name", " "), 1)).otherwise("Zyzzyva")
    return table(spark, sf_dir, "part").select("p_partkey", r.names_agree(name, F.upper("p_name")).alias("agree"))


@query()
def j18_alignment(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id")
    read = turns.where("turn % 3 <> 2").select("doc_id", F.col("turn").alias("note_pos"), "text", (F.col("turn") % 5 != 4).alias("in_order"))
    return audit.alignment(turns.select("doc_id", F.col("turn").alias("number"), "text"), read)


@query("SELECT count(*) AS n, round(avg(CASE WHEN quality = 1 AND toxic = 0 OR quality = 0 AND toxic = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS agreement FROM labels JOIN documents USING (doc_id)")
def j22_two_markers(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    a, b = labels.select("doc_id", (F.col("quality") == 1).alias("v")), labels.select("doc_id", (F.col("toxic") == 0).alias("v"))
    return audit.two_markers(a, b, "doc_id", "v").select("n", F.round("agreement", 6).alias("agreement"))


# aggregates


@query("SELECT l_orderkey, l_partkey, max(l_linenumber) AS l_linenumber, arg_max(l_quantity, l_linenumber * 1000 + l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_partkey")
def g02_established(spark, sf_dir):
    return audit.latest_established(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], "l_linenumber", "l_quantity")


@query("SELECT event_type AS outcome, count(*) AS n FROM events GROUP BY event_type")
def g07_outcomes(spark, sf_dir):
    return audit.outcome_counts(table(spark, sf_dir, "events"), "event_type")


@query("""SELECT l_orderkey, l_linenumber, l_quantity AS located FROM (SELECT l_orderkey, l_linenumber, l_quantity, max(l_quantity) OVER (PARTITION BY l_orderkey) AS m FROM lineitem)
       WHERE l_quantity = m QUALIFY count(*) OVER (PARTITION BY l_orderkey) = 1""")
def g12_carrier(spark, sf_dir):
    return carriers(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_quantity"))


@query("SELECT key, CAST(1 + key % 7 AS INTEGER) AS length FROM numbers")
def g13_numbering(spark, sf_dir):
    numbers = F.concat(F.array(F.lit(9)), F.sequence(F.lit(1), (1 + F.col("key") % 7).cast("int")), F.array(F.lit(1), F.lit(30)))
    return orders_numbers(spark, sf_dir).select("key", r.numbering_length(numbers).alias("length"))


@query("SELECT o_custkey, array_to_string(list_sort(list(o_orderkey))[1:12], ',') AS notes, greatest(count(*) - 12, 0) AS more FROM orders GROUP BY o_custkey")
def g14_outstanding(spark, sf_dir):
    out = audit.outstanding(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")
    return out.select("o_custkey", F.array_join("notes", ",").alias("notes"), "more")


@query("SELECT key, CAST(para + 9 AS VARCHAR) AS wrong, (para + 2) || '-' || (para + 3) AS missing FROM numbers")
def g15_pins(spark, sf_dir):
    cited = F.sequence(F.col("para"), F.col("para") + 3)
    both = r.pins_compared(cited, F.array(F.col("para") + 1, F.col("para"), F.col("para") + 9))
    return orders_numbers(spark, sf_dir).select("key", both["wrong"].alias("wrong"), both["missing"].alias("missing"))


# windows, orders, samples


@query("SELECT key, para || '-' || (para + 9) || ',' || (para + 9) || '-' || (para + 11) AS spans FROM numbers")
def w07_longest_spans(spark, sf_dir):
    p = F.col("para")
    spans = F.array(*[F.struct(a.alias("start"), b.alias("end")) for a, b in ((p + 9, p + 11), (p, p + 4), (p, p + 9), (p + 5, p + 12))])
    kept = F.transform(r.longest_spans(spans), lambda s: F.concat_ws("-", s["start"], s["end"]))
    return orders_numbers(spark, sf_dir).select("key", F.array_join(kept, ",").alias("spans"))


@query("SELECT key, '(2) Two ' || num AS excerpt, 'cited' AS passage FROM numbers")
def w05_recitals(spark, sf_dir):
    body = F.format_string("(1) One\n(2) Two %d\n(3) Three", "num")
    rows = orders_numbers(spark, sf_dir).select("key", body.alias("body"), F.array(F.lit(2)).alias("paragraphs"), F.lit(None).cast("array<string>").alias("sections"))
    return sliced(rows).select(F.col("key").cast("long").alias("key"), "excerpt", "passage")


@query("SELECT key, '7.1. Product ' || num || chr(10) || 'a' AS excerpt FROM numbers")
def w06_sections(spark, sf_dir):
    body = F.format_string("7. Market\nintro\n7.1. Product %d\na\n7.2 Region\nb\n8. Assessment", "num")
    rows = orders_numbers(spark, sf_dir).select("key", body.alias("body"), F.lit(None).cast("array<int>").alias("paragraphs"), F.array(F.lit("7.1")).alias("sections"))
    return sliced(rows).select(F.col("key").cast("long").alias("key"), "excerpt")


@query("SELECT key, CASE WHEN key % 3 = 0 THEN '2. Beta ' || num WHEN key % 3 = 1 THEN '(b) delta ' || num ELSE '(7) Recital ' || num END AS excerpt FROM numbers")
def t03_act_passage(spark, sf_dir):
    k = F.col("key") % 3
    html = F.format_string("<p>(7) Recital %d</p><p>(8) Next</p><p>Article 3</p><p>1. Alpha</p><p>2. Beta %d</p><p>3. Gamma</p><p>(a) gamma</p><p>(b) delta %d</p><p>CHAPTER II</p><p>Article 4</p>", "num", "num", "num")
    rows = orders_numbers(spark, sf_dir).select(
        "key", html.alias("html"), F.when(k == 2, "point").otherwise("article").alias("kind"), F.when(k == 2, 7).otherwise(3).alias("start"),
        F.when(k == 0, 2).when(k == 1, 3).alias("paragraph"), F.when(k == 1, "b").alias("point"), F.lit(None).cast("int").alias("end"),
    )
    return provisions(rows).select(F.col("key").cast("long").alias("key"), "excerpt")


@query("""SELECT doc_id, lang, draw FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('8:' || doc_id), doc_id) AS draw, floor(60 * count(*) OVER (PARTITION BY lang) / (count(*) OVER ())::DOUBLE + 0.5) AS share
       FROM documents) WHERE draw <= share""")
def o04_blind(spark, sf_dir):
    return audit.blind(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 60, 8).select("doc_id", "lang", "draw")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) AS turn FROM orders")
def o05_promoted(spark, sf_dir):
    return audit.promoted(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "F", "o_orderkey").select("o_orderkey", "turn")


# sources


@query(r"SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS note_pos, trim(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g')) AS text FROM conversations")
def s03_notes(spark, sf_dir):
    from citelake.functions.text import normal_notes

    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return normal_notes(per.select(F.col("conv_id").alias("doc_id"), F.col("t.text").alias("notes")))


@query("SELECT key AS doc_id, para AS note_label, 'The note ' || num || ' is long enough to be kept.' AS text, 'A heading' AS prose FROM numbers")
def s04_typed_notes(spark, sf_dir):
    body = F.format_string("A heading\r%d The note %d is long enough to be kept.\r7 Short", "para", "num")
    docs = orders_numbers(spark, sf_dir).select(F.col("key").alias("doc_id"), body.alias("body"))
    prose = docs.select("doc_id", F.array_join(sources.prose(F.col("body")), "|").alias("prose"))
    return sources.typed_notes(docs).join(prose, "doc_id").select("doc_id", "note_label", "text", "prose")


@query("SELECT key, 'Case C-' || num || '/' || yy || ' (joined) now|Alpha beta ' || seq AS spans FROM numbers")
def s06_bracketed(spark, sf_dir):
    text = F.format_string("See (Case C-%d/%d (joined) now) and (12) or (Alpha beta %d), (1234567890).", "num", "yy", "seq")
    return orders_numbers(spark, sf_dir).select("key", F.array_join(sources.bracketed(text), "|").alias("spans"))


@query("""SELECT o_orderkey, o_custkey, CASE WHEN c_custkey IS NULL THEN 'not available' END AS skipped FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0) ON o_custkey = c_custkey""")
def s17_manifest(spark, sf_dir):
    manifest = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return audit.read_or_skipped(manifest, table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_orderkey", "o_custkey", "skipped")


@query("SELECT sha256(user_id || ':' || event_type) AS name, user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def s20_newest(spark, sf_dir):
    landed = table(spark, sf_dir, "events").withColumn("at", F.col("event_id"))
    return audit.newest(landed, ["user_id", "event_type"], "at", "event_id").select("name", "user_id", "event_type", "event_id")
