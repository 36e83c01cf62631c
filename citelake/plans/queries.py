"""The citation operators as queries over the driver's tables, each with DuckDB SQL that
computes the same rows another way (from the integers, without the patterns)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citelake.functions import ids, text
from citelake.operators import aggregates, joins, windows
from citelake.operators.detect import mentions
from citelake.operators.resolve import citations, cited_authorities
from citelake.plans import review  # noqa: F401  registers its queries
from citelake.plans.notes import notes, orders_numbers
from citelake.plans.registry import QUERIES, SQL, query, table  # noqa: F401

# identifiers


@query("SELECT o_orderkey AS key, CAST(CASE WHEN o_orderkey % 100 > 26 THEN 1900 ELSE 2000 END + o_orderkey % 100 AS INTEGER) AS year FROM orders")
def c02_two_digit_year(spark, sf_dir):
    yy = F.format_string("%02d", F.col("o_orderkey") % 100)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), ids.two_digit_year(yy).alias("year"))


@query("SELECT key, 'C-' || num || '/' || yy || CASE key % 3 WHEN 0 THEN ' P' WHEN 1 THEN '' ELSE ' RENV' END AS case_number FROM numbers")
def c03_canonical_case(spark, sf_dir):
    n = orders_numbers(spark, sf_dir)
    hyphen = F.when(F.col("key") % 2 == 0, "‑").otherwise("–")
    suffix = F.when(F.col("key") % 3 == 0, "p").when(F.col("key") % 3 == 1, "").otherwise(" renv")
    written = F.concat(F.lit(" c"), hyphen, F.col("num"), F.lit("/"), F.col("yy"), suffix)
    return n.select("key", ids.canonical_case(written).alias("case_number"))


@query("""SELECT key, CASE WHEN key % 2 = 1 AND key % 3 = 1 THEN NULL ELSE '6' || (2000 + yy) || CASE WHEN key % 2 = 1 THEN 'T' ELSE 'C' END
       || CASE key % 3 WHEN 0 THEN 'J' WHEN 1 THEN 'C' ELSE 'O' END || lpad(CAST(num AS VARCHAR), 4, '0') END AS celex FROM numbers""")
def c04_celex_case(spark, sf_dir):
    n = orders_numbers(spark, sf_dir)
    case = F.concat(F.when(F.col("key") % 2 == 1, "T").otherwise("C"), F.lit("-"), F.col("num"), F.lit("/"), F.col("yy"))
    kind = F.when(F.col("key") % 3 == 0, "judgment").when(F.col("key") % 3 == 1, "opinion").otherwise("order")
    return n.select("key", ids.celex_of_case(case, kind).alias("celex"))


@query("""SELECT key, '3' || (2000 + yy) || CASE key % 4 WHEN 0 THEN 'L' WHEN 1 THEN 'R' WHEN 2 THEN 'H' ELSE 'D' END || lpad(CAST(num AS VARCHAR), 4, '0') AS celex FROM numbers""")
def c05_celex_act(spark, sf_dir):
    kind = F.when(F.col("key") % 4 == 0, "Directive").when(F.col("key") % 4 == 1, "Règlement").when(F.col("key") % 4 == 2, "Recommendation").otherwise("Décision")
    return orders_numbers(spark, sf_dir).select("key", ids.celex_of_act(kind, (F.col("yy") + 2000).cast("string"), F.col("num").cast("string")).alias("celex"))


@query("""SELECT key, CASE key % 6 WHEN 0 THEN 2000 + yy WHEN 1 THEN 1900 + 58 + key % 41 WHEN 2 THEN 2000 + yy WHEN 3 THEN CASE WHEN 2000 + yy >= 2015 THEN 2000 + yy END
       WHEN 4 THEN 2000 + yy END AS year, CASE WHEN key % 6 IN (0, 1, 2, 4) OR (key % 6 = 3 AND yy >= 15) THEN num END AS number FROM numbers""")
def c06_act_order(spark, sf_dir):
    k, year, num = F.col("key") % 6, (F.col("yy") + 2000).cast("string"), F.col("num").cast("string")
    old = F.format_string("%02d", F.lit(58) + F.col("key") % 41)
    first = F.when(k == 1, old).when(k == 2, num).when(k == 5, F.lit("99")).otherwise(year)
    second = F.when(k == 2, year).otherwise(num)
    kind = F.when(k == 3, "Regulation").otherwise("Directive")
    pair = ids.act_year_number(kind, k.isin(0, 1, 5), k.isin(0, 2), first, second)
    return orders_numbers(spark, sf_dir).select("key", pair["year"].cast("long").alias("year"), pair["number"].cast("int").alias("number"))


@query("SELECT key, '12016' || CASE key % 3 WHEN 0 THEN 'E' WHEN 1 THEN 'M' ELSE 'P' END || lpad(CAST(para AS VARCHAR), 3, '0') AS celex FROM numbers")
def c07_celex_treaty(spark, sf_dir):
    treaty = F.when(F.col("key") % 3 == 0, "TFUE").when(F.col("key") % 3 == 1, "TEU").otherwise("Charter of Fundamental Rights")
    return orders_numbers(spark, sf_dir).select("key", ids.celex_of_treaty(treaty, F.col("para").cast("string")).alias("celex"))


@query("SELECT key, 'C-' || num || '-' || yy AS identity FROM numbers")
def c09_case_identity(spark, sf_dir):
    written = F.concat(F.lit("C–"), F.lpad(F.col("num").cast("string"), 4, "0"), F.lit("/"), F.col("yy"), F.when(F.col("key") % 2 == 0, " P").otherwise(""))
    return orders_numbers(spark, sf_dir).select("key", ids.case_identity(written).alias("identity"))


@query("""SELECT key, CASE key % 3 WHEN 0 THEN 'https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:6' || seq WHEN 1 THEN 'https://competition-cases.ec.europa.eu/cases/AT.' || (30000 + num)
       ELSE 'https://curia.europa.eu/juris/liste.jsf?num=C-' || num || '%2F' || yy || '%20P' END AS url FROM numbers""")
def c13_official_url(spark, sf_dir):
    k = F.col("key") % 3
    celex, at, case = F.when(k == 0, F.concat(F.lit("6"), F.col("seq"))), F.when(k == 1, F.concat(F.lit("AT."), F.lit(30000) + F.col("num"))), F.format_string("C-%d/%d P", "num", "yy")
    return orders_numbers(spark, sf_dir).select("key", ids.official_url(celex, at, case).alias("url"))


@query("SELECT key, key % 5 NOT IN (1, 2) AS valid FROM numbers")
def c15_valid_lookup(spark, sf_dir):
    k = F.col("key") % 5
    celex = F.when(k == 1, "not a celex").when(k == 3, "62012CJ0131")
    paragraphs = F.when(k == 2, F.array(F.lit(-1))).when(k == 4, F.array(F.col("para").cast("int")))
    return orders_numbers(spark, sf_dir).select("key", ids.valid_lookup(F.lit("x"), celex, F.lit("ECLI:EU:C:2014:317"), F.lit(None).cast("string"), paragraphs).alias("valid"))


@query("SELECT key, levenshtein(CAST(seq AS VARCHAR), CAST(num AS VARCHAR)) AS distance FROM numbers")
def c33_digit_distance(spark, sf_dir):
    return orders_numbers(spark, sf_dir).select("key", ids.edit_distance_of_digits(F.format_string("M.%d", "seq"), F.format_string("AT.%d", "num")).cast("long").alias("distance"))


# text


@query("""SELECT conv_id, turn, len(p) AS n_segments, length(p[1]) AS first_length FROM (SELECT conv_id, turn, string_split(replace(text, '.', ';'), ';') AS p FROM conversations)""")
def c01_segments(spark, sf_dir):
    cut = text.segments(F.replace("text", F.lit("."), F.lit(";")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(cut).cast("long").alias("n_segments"), (cut[0]["end"] - cut[0]["start"]).cast("long").alias("first_length"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'),
       '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\s   ]+', ' ', 'g')) AS plain FROM pages""")
def c16_html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.plain_text(F.col("html")).alias("plain"))


@query(r"""SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'that', 'which', 'is', 'are', 'to')))::DOUBLE / len(w) END, 6) AS share
       FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents)""")
def c25_english_share(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.english_share(F.col("text")), 6).alias("share"))


@query(r"""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS a,
       lag(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
       SELECT conv_id, turn, round(len(list_intersect(a, b))::DOUBLE / greatest(len(a) + len(b) - len(list_intersect(a, b)), 1), 6) AS jaccard,
       round(len(list_intersect(a, b))::DOUBLE / greatest(len(a), 1), 6) AS coverage FROM t WHERE b IS NOT NULL""")
def c32_jaccard(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("a"))
    t = t.withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return t.select("conv_id", "turn", F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(text.coverage(F.col("a"), F.col("b")), 6).alias("coverage"))


@query(r"""SELECT item_id, '…' || trim(regexp_replace(substr(text, 21, 60), '[\s   ]+', ' ', 'g')) || CASE WHEN length(text) > 80 THEN '…' ELSE '' END AS around
       FROM benchmark WHERE length(text) >= 60""")
def c34_context(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").where(F.length("text") >= 60)
    return rows.select("item_id", text.context(F.col("text"), F.lit(45), F.lit(55), 25).alias("around"))


# detection on synthetic notes


@query("""SELECT doc_id, note_pos, 'ECLI:EU:C:' || (2000 + yy) || ':' || seq AS ecli, '6' || (2000 + yy) || CASE template WHEN 0 THEN 'CJ' WHEN 8 THEN 'CC' ELSE 'CO' END || lpad(CAST(num AS VARCHAR), 4, '0') AS celex,
       CASE WHEN template <> 9 THEN CAST(para AS VARCHAR) END AS paragraphs FROM numbers WHERE template IN (0, 8, 9)""")
def d03_ecli(spark, sf_dir):
    m = mentions(notes(spark, sf_dir)).where("ecli is not null")
    return m.select("doc_id", "note_pos", "ecli", "celex", F.array_join("paragraphs", ",").alias("paragraphs"))


@query("SELECT doc_id, note_pos, 'C-' || num || '/' || yy AS case_number, 4 AS idx FROM numbers WHERE template = 1")
def d06_case(spark, sf_dir):
    return mentions(notes(spark, sf_dir).where("template = 1")).select("doc_id", "note_pos", "case_number", "idx")


@query("""SELECT doc_id, note_pos, '3' || CASE template WHEN 2 THEN (2000 + yy) || 'L' ELSE (1990 + yy % 10) || 'R' END || lpad(CAST(num AS VARCHAR), 4, '0') AS celex,
       CASE template WHEN 3 THEN para END AS recital FROM numbers WHERE template IN (2, 3)""")
def d07_acts(spark, sf_dir):
    m = mentions(notes(spark, sf_dir)).where(F.col("label").isin("EU directive", "EU regulation"))
    return m.select("doc_id", "note_pos", "celex", F.col("locator_start").alias("recital"))


@query("SELECT doc_id, note_pos, 'Decision C(' || (2000 + yy) || ') ' || seq AS value FROM numbers WHERE template = 10")
def d08_c_decision(spark, sf_dir):
    return mentions(notes(spark, sf_dir)).where("label = 'Commission decision'").select("doc_id", "note_pos", "value")


@query("SELECT doc_id, note_pos, '12016E' || lpad(CAST(para AS VARCHAR), 3, '0') AS celex, para AS article, CAST(1 + num % 3 AS INTEGER) AS paragraph FROM numbers WHERE template = 4")
def d09_treaty(spark, sf_dir):
    m = mentions(notes(spark, sf_dir)).where("label = 'TFEU article'")
    return m.select("doc_id", "note_pos", "celex", F.col("locator_start").alias("article"), F.col("locator_paragraph").alias("paragraph"))


@query("""SELECT doc_id, note_pos, '12016P' || lpad(CAST(para + d AS VARCHAR), 3, '0') AS celex, 'Article ' || (para + d) || ' of the Charter' AS value
       FROM numbers, (VALUES (0), (1)) AS v(d) WHERE template = 5""")
def d11_treaty_list(spark, sf_dir):
    return mentions(notes(spark, sf_dir)).where("label = 'Charter article'").select("doc_id", "note_pos", "celex", "value")


@query("SELECT doc_id, note_pos, 'AT.' || (30000 + num) AS value, CAST(para AS VARCHAR) AS paragraphs FROM numbers WHERE template = 6")
def d12_comp(spark, sf_dir):
    m = mentions(notes(spark, sf_dir)).where("label = 'Commission antitrust case'")
    return m.select("doc_id", "note_pos", "value", F.array_join("paragraphs", ",").alias("paragraphs"))


@query("""SELECT doc_id, note_pos, 'C-' || num || '/' || yy AS case_number, 'C-' || (num + 1) || '/' || yy AS joined, '6' || (2000 + yy) || 'CJ' || lpad(CAST(num + 1 AS VARCHAR), 4, '0') AS alternatives,
       para || ',' || (para + 1) || ',' || (para + 2) AS paragraphs FROM numbers WHERE template = 7""")
def d01_joined(spark, sf_dir):
    m = mentions(notes(spark, sf_dir)).where("joined is not null")
    return m.select("doc_id", "note_pos", "case_number", F.array_join("joined", ",").alias("joined"), F.array_join("alternatives", ",").alias("alternatives"), F.array_join("paragraphs", ",").alias("paragraphs"))


@query("""SELECT doc_id, note_pos, para + d AS paragraph FROM numbers, (VALUES (0), (1), (2)) AS v(d) WHERE template = 7 OR (template IN (0, 3, 6, 8) AND d = 0)""")
def e01_pinpoints(spark, sf_dir):
    return mentions(notes(spark, sf_dir)).select("doc_id", "note_pos", F.explode("paragraphs").alias("paragraph"))


@query("SELECT doc_id, note_pos, CASE template WHEN 8 THEN 'opinion' WHEN 9 THEN 'order' ELSE 'judgment' END AS document_type, template IN (8, 9) AS stated FROM numbers WHERE template IN (0, 1, 7, 8, 9)")
def e09_document_type(spark, sf_dir):
    m = mentions(notes(spark, sf_dir)).where("source = 'curia'")
    return m.select("doc_id", "note_pos", "document_type", F.coalesce("type_stated", F.lit(False)).alias("stated"))


@query("""SELECT label, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, CASE template WHEN 0 THEN 'CJEU judgment' WHEN 1 THEN 'CJEU case number' WHEN 2 THEN 'EU directive'
       WHEN 3 THEN 'EU regulation' WHEN 4 THEN 'TFEU article' WHEN 5 THEN 'Charter article' WHEN 6 THEN 'Commission antitrust case' WHEN 7 THEN 'CJEU case number' WHEN 8 THEN 'CJEU Advocate General opinion'
       WHEN 9 THEN 'CJEU order' WHEN 10 THEN 'Commission decision' END AS label FROM numbers WHERE template < 11 UNION ALL SELECT doc_id, 'Charter article' FROM numbers WHERE template = 5) GROUP BY label""")
def l1_labels(spark, sf_dir):
    return mentions(notes(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


@query("""SELECT doc_id, celex, min(note_pos) AS first_note, array_to_string(list_sort(list(DISTINCT note_pos)), ',') AS notes FROM (SELECT doc_id, note_pos, '3' || (2000 + yy) || 'L' || lpad(CAST(num AS VARCHAR), 4, '0') AS celex
       FROM numbers WHERE template = 2) GROUP BY doc_id, celex""")
def g03_targets(spark, sf_dir):
    m = mentions(notes(spark, sf_dir).where("template = 2"))
    m = m.select("note_pos", F.struct("doc_id", "celex").alias("target"))
    return aggregates.targets(m, "target", "note_pos").select("target.doc_id", "target.celex", "first_note", F.array_join("notes", ",").alias("notes"))


# joins


@query("""WITH f AS (SELECT * FROM (VALUES ('van gend en loos', 1), ('intel', 2), ('bosman', 1), ('akzo', 2), ('schrems', 2)) AS v(alias, n))
       SELECT o_orderkey AS key, CASE WHEN n IS NULL THEN 'unresolved_not_found' WHEN n = 1 THEN 'unconfirmed_suggestion' ELSE 'unresolved_ambiguous' END AS status, COALESCE(n, 0) AS n_cases
       FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'van gend en loos' WHEN 1 THEN 'intel' WHEN 2 THEN 'bosman' WHEN 3 THEN 'akzo' WHEN 4 THEN 'schrems' ELSE 'nobody' END AS alias FROM orders) LEFT JOIN f USING (alias)""")
def j10_frequent(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    name = F.when(k == 0, "Van Gend en Loos").when(k == 1, "INTEL").when(k == 2, "Bosman").when(k == 3, "Akzo").when(k == 4, "Schrems").otherwise("Nobody")
    out = joins.by_frequent_name(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), name.alias("name")), F.col("name"))
    return out.select("key", "status", F.coalesce(F.size("cases"), F.lit(0)).alias("n_cases"))


@query("SELECT l_orderkey, l_partkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') WHERE (l_orderkey, l_partkey) NOT IN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F')")
def j11_missed(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_partkey"]
    return joins.missed(lines.where("l_returnflag = 'R'").select(*keys).distinct(), lines.where("l_linestatus = 'F'"), keys)


@query("""SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'unavailable' WHEN c_nationkey % 5 = o_orderkey % 5 THEN 'verified' ELSE 'wrong-source' END AS outcome
       FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 > 0) ON o_custkey = c_custkey""")
def j12_declared(spark, sf_dir):
    derived = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 5).alias("derived"))
    declared = table(spark, sf_dir, "customer").where("c_custkey % 7 > 0").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 5).alias("declared"))
    return joins.against_declared(derived, declared, "k", "derived", "declared").select("o_orderkey", "outcome")


@query("""SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r
       FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 2 = 0) WHERE r = 1""")
def j13_priority_source(spark, sf_dir):
    candidates = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    held = table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("l_partkey"))
    return joins.first_held(candidates, held, ["l_orderkey"], "l_linenumber", "l_partkey").select("l_orderkey", "l_partkey", "l_linenumber")


@query("""WITH r AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'AT.' || s_suppkey ELSE 'AT.' || (s_suppkey // 4) || '.' || s_suppkey END AS k FROM supplier),
       s AS (SELECT regexp_extract(k, '^(.*)\\.[^.]*$', 1) AS p, min(k) AS m FROM r GROUP BY 1 HAVING count(*) = 1)
       SELECT q.k AS case_key, COALESCE(r.k, s.m) AS match FROM (SELECT 'AT.' || s_suppkey AS k FROM supplier) q LEFT JOIN r ON q.k = r.k LEFT JOIN s ON q.k = s.p""".replace("\\\\", "\\"))
def j14_only_sibling(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    key = F.when(F.col("s_suppkey") % 3 == 0, F.format_string("AT.%d", "s_suppkey")).otherwise(F.format_string("AT.%d.%d", F.floor(F.col("s_suppkey") / 4), F.col("s_suppkey")))
    asked = s.select(F.format_string("AT.%d", "s_suppkey").alias("case_key"))
    return joins.exact_or_only_sibling(asked, s.select(key.alias("case_key")), "case_key")


@query("""WITH b AS (SELECT p_partkey AS title_id, list_distinct(string_split(lower(p_type || ' ' || p_name || ' size' || p_size), ' ')) AS w FROM part),
       a AS (SELECT p_partkey AS name_id, list_distinct(string_split(lower(p_type || ' size' || p_size), ' ')) AS w FROM part),
       m AS (SELECT name_id, title_id, len(b.w) - len(a.w) AS extra FROM a JOIN b ON list_has_all(b.w, a.w)),
       k AS (SELECT *, rank() OVER (PARTITION BY name_id ORDER BY extra) AS r FROM m)
       SELECT name_id, min(title_id) AS title_id, CAST(min(extra) AS INTEGER) AS extra_words FROM k WHERE r = 1 GROUP BY name_id HAVING count(*) = 1""")
def j15_named_case(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("size", F.concat(F.lit("size"), "p_size"))
    names = part.select(F.col("p_partkey").alias("name_id"), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_type", "size")), " ")).alias("words"))
    titles = part.select(F.col("p_partkey").alias("title_id"), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_type", "p_name", "size")), " ")).alias("words"))
    return joins.by_words(names, titles, "name_id", "title_id")


@query("""SELECT COALESCE(a.u, b.u) AS user_id, COALESCE(a.e, b.e) AS event_type, CASE WHEN b.u IS NULL THEN 'new' WHEN a.u IS NULL THEN 'fixed' ELSE 'known' END AS state
       FROM (SELECT DISTINCT user_id u, event_type e FROM events WHERE event_id % 2 = 0) a FULL JOIN (SELECT DISTINCT user_id u, event_type e FROM events WHERE event_id % 3 = 0) b ON a.u = b.u AND a.e = b.e""")
def j20_known_outer(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return joins.new_and_fixed(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), ["user_id", "event_type"])


@query("SELECT o_orderkey, COALESCE(CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END, o_orderpriority) AS resolved, CASE WHEN c_custkey % 4 = 0 THEN 'user_confirmed' END AS method FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j08_confirmed(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("resolved"))
    confirmed = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("resolved"))
    return joins.with_confirmed(rows, confirmed, "k", "resolved").select("o_orderkey", "resolved", "method")


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT *, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE m = 0 OR l_returnflag = 'R'""")
def j17_dated_if_any(spark, sf_dir):
    return joins.dated_if_any(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber")


# aggregates


@query("""SELECT l_orderkey, l_quantity, n FROM (SELECT l_orderkey, l_quantity, count(*) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, min(l_linenumber), l_quantity) AS r
       FROM lineitem GROUP BY l_orderkey, l_quantity) WHERE r = 1""")
def g04_modal_value(spark, sf_dir):
    return aggregates.mode_first_seen(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", "l_linenumber")


@query("SELECT COALESCE(o_orderstatus, 'all') AS document, count(*) AS notes, count(DISTINCT o_custkey) AS citations FROM orders GROUP BY ROLLUP (o_orderstatus)")
def g05_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").rollup("o_orderstatus").agg(F.count("*").alias("notes"), F.count_distinct("o_custkey").alias("citations"))
    return rows.select(F.coalesce("o_orderstatus", F.lit("all")).alias("document"), "notes", "citations")


@query("""SELECT upper(regexp_replace(props, '[0-9]', '#', 'g')) AS shape, count(*) AS n, count(DISTINCT user_id) AS documents, min(props) AS example FROM events GROUP BY 1 ORDER BY n DESC, shape LIMIT 12""")
def g06_miss_shapes(spark, sf_dir):
    return aggregates.shapes(table(spark, sf_dir, "events"), F.col("props"), F.col("user_id"))


_MARKED = """s AS (SELECT lang, quality, toxic FROM documents JOIN labels USING (doc_id)), p AS (SELECT lang, count(*) AS population FROM documents GROUP BY lang)"""


@query(f"""WITH {_MARKED}, t AS (SELECT population AS b, count(*)::DOUBLE AS n, avg(quality) AS m, COALESCE(var_samp(quality), 0) AS v FROM s JOIN p USING (lang) GROUP BY lang, population),
       u AS (SELECT sum(b * m) AS total, sqrt(sum(b::DOUBLE * b * (1 - n / b) * v / n)) AS se FROM t)
       SELECT round(total, 4) AS total, round(total - 1.96 * se, 4) AS low, round(total + 1.96 * se, 4) AS high FROM u""")
def g08_strata_total(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sample = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    out = aggregates.strata_totals(sample, docs.groupBy("lang").agg(F.count("*").alias("population")), "lang", F.col("quality"))
    return out.select(*[F.round(c, 4).alias(c) for c in ("total", "low", "high")])


@query(f"""WITH {_MARKED}, j AS (SELECT lang, population::DOUBLE AS b, quality::DOUBLE AS q, (quality + toxic)::DOUBLE AS d FROM s JOIN p USING (lang)), a AS (SELECT b, avg(q) AS q, avg(d) AS d FROM j GROUP BY lang, b),
       r AS (SELECT sum(b * q) / sum(b * d) AS r, sum(b * d) AS x FROM a), v AS (SELECT b, count(*)::DOUBLE AS n, var_samp(q - r * d) AS v, r, x FROM j, r GROUP BY lang, b, r, x),
       u AS (SELECT r, CASE WHEN min(n) >= 2 THEN 1.96 * sqrt(sum(b * b * (1 - n / b) * v / n)) / x END AS h FROM v GROUP BY r, x)
       SELECT round(r, 6) AS ratio, round(greatest(0, least(1, r - h)), 6) AS low, round(greatest(0, least(1, r + h)), 6) AS high FROM u""")
def g09_strata_ratio(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sample = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    out = aggregates.strata_ratio(sample, docs.groupBy("lang").agg(F.count("*").alias("population")), "lang", F.col("quality"), F.col("quality") + F.col("toxic"))
    return out.select(*[F.round(c, 6).alias(c) for c in ("ratio", "low", "high")])


@query("""WITH t AS (SELECT avg(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0 END) AS p, avg(CASE WHEN toxic = 0 THEN 1.0::DOUBLE ELSE 0 END) AS q, avg(CASE WHEN (quality = 1) = (toxic = 0) THEN 1.0::DOUBLE ELSE 0 END) AS a FROM labels)
       SELECT round(a, 6) AS agreement, round(CASE WHEN p * q + (1 - p) * (1 - q) >= 1 THEN 1 ELSE (a - (p * q + (1 - p) * (1 - q))) / (1 - (p * q + (1 - p) * (1 - q))) END, 6) AS kappa FROM t""")
def g10_kappa(spark, sf_dir):
    out = aggregates.kappa(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 0)
    return out.select(F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query("SELECT p_brand || ' ' || p_type AS prefix, min(p_size) AS p_size FROM part GROUP BY p_brand || ' ' || p_type HAVING count(DISTINCT p_size) = 1")
def g11_only_of_group(spark, sf_dir):
    return aggregates.only_of_group(table(spark, sf_dir, "part"), F.concat_ws(" ", "p_brand", "p_type"), "prefix", "p_size")


# windows, orders, samples


@query("""SELECT user_id, min(n) AS run_from, max(n) AS run_to FROM (SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS i FROM (SELECT DISTINCT user_id, event_id // 7 AS n FROM events)) GROUP BY user_id, i""")
def w01_runs(spark, sf_dir):
    return windows.runs(table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 7).alias("n")), "user_id", "n")


@query("SELECT l_orderkey, l_partkey, count(*) AS n, count(*) > 1 AS repeated FROM lineitem GROUP BY l_orderkey, l_partkey")
def w04_repeated(spark, sf_dir):
    return windows.repeated(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_partkey")


@query("""WITH m AS (SELECT user_id, event_id, CASE WHEN lag(v) OVER w IS NULL OR v <= lag(v) OVER w THEN event_id END AS s FROM (SELECT user_id, event_id, floor(value) AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
       l AS (SELECT *, max(s) OVER (PARTITION BY user_id) AS x FROM m) SELECT user_id, event_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM l WHERE event_id >= x) WHERE n >= 2""")
def w10_last_numbering(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").alias("v"))
    return windows.last_numbering(e, "user_id", "event_id", "v", least=2).select("user_id", "event_id")


@query("""SELECT doc_id, place, bytes_upto FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS place, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS bytes_upto FROM documents)
       WHERE place > 8 OR bytes_upto > 20000""")
def s21_eviction(spark, sf_dir):
    out = windows.evicted(table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("fetched"), "source", "n_chars"), "source", "doc_id", "fetched", "n_chars", 8, 20000)
    return out.select("doc_id", "place", "bytes_upto")


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END,
       CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END NULLS LAST, o_orderkey) AS rank FROM orders""")
def o01_decision_order(spark, sf_dir):
    k = F.col("o_orderkey")
    language = F.when(k % 3 == 0, "en").when(k % 3 == 1, "fr").otherwise("de")
    out = windows.decision_order(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderstatus") == "P", language, F.when(k % 5 > 0, F.col("o_orderdate")), "o_orderkey")
    return out.select("o_orderkey", "rank")


@query("""SELECT doc_id, lang, draw FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS draw FROM documents)
       WHERE draw <= CASE lang WHEN 'en' THEN 45 WHEN 'fr' THEN 35 ELSE 15 END""")
def o03_stratified_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return windows.stratified(docs, "lang", "doc_id", 7, {"en": 45, "fr": 35}, 15)


@query("""SELECT lang AS stratum, round(b * b * (1 - n / b) * v / n, 4) AS variance FROM (SELECT lang, count(*)::DOUBLE AS n, var_samp(quality) AS v, any_value(population)::DOUBLE AS b FROM documents JOIN labels USING (doc_id)
       JOIN (SELECT lang, count(*) AS population FROM documents GROUP BY lang) USING (lang) GROUP BY lang) ORDER BY variance DESC, stratum LIMIT 1""")
def o06_widest_stratum(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    population = docs.groupBy("lang").agg(F.count("*").cast("double").alias("b"))
    per = docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count("*").cast("double").alias("n"), F.var_samp("quality").alias("v")).join(population, "lang")
    spread = F.round(F.expr("b * b * (1 - n / b) * v / n"), 4)
    return per.select(F.col("lang").alias("stratum"), spread.alias("variance")).orderBy(F.desc("variance"), "stratum").limit(1)


@query("""SELECT doc_id, note_pos, last_value(CASE WHEN template <> 11 THEN key END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY note_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS established FROM numbers""")
def j06_previous_authority(spark, sf_dir):
    rows = notes(spark, sf_dir)
    return windows.previous_established(rows, "doc_id", "note_pos", F.when(F.col("template") != 11, F.col("key"))).select("doc_id", "note_pos", "established")


# resolution: one ordered fold per document

#: What a note without a back-reference establishes, from its template; several are marked, none is null.
_ESTABLISHED = """CASE template WHEN 0 THEN '6' || (2000 + yy) || 'CJ' || lpad(CAST(num AS VARCHAR), 4, '0') WHEN 1 THEN '6' || (2000 + yy) || 'CJ' || lpad(CAST(num AS VARCHAR), 4, '0')
       WHEN 2 THEN '3' || (2000 + yy) || 'L' || lpad(CAST(num AS VARCHAR), 4, '0') WHEN 3 THEN '3' || (1990 + yy % 10) || 'R' || lpad(CAST(num AS VARCHAR), 4, '0')
       WHEN 4 THEN '12016E' || lpad(CAST(para AS VARCHAR), 3, '0') WHEN 5 THEN 'several' WHEN 7 THEN '6' || (2000 + yy) || 'CJ' || lpad(CAST(num AS VARCHAR), 4, '0')
       WHEN 8 THEN '6' || (2000 + yy) || 'CC' || lpad(CAST(num AS VARCHAR), 4, '0') WHEN 9 THEN '6' || (2000 + yy) || 'CO' || lpad(CAST(num AS VARCHAR), 4, '0') END"""


@query(f""", e AS (SELECT *, {_ESTABLISHED} AS id, max(CASE WHEN template <> 11 THEN note_pos END) OVER (PARTITION BY doc_id ORDER BY note_pos) AS src FROM numbers)
       SELECT a.doc_id, a.note_pos, CASE WHEN b.id IS NULL OR (b.id = 'several' AND a.note_pos > b.note_pos + 1) THEN 'unresolved_not_found' WHEN b.id = 'several' THEN 'unresolved_ambiguous' ELSE 'resolved' END AS status,
       CASE WHEN b.id <> 'several' THEN b.id END AS celex FROM e a LEFT JOIN e b ON a.doc_id = b.doc_id AND a.src = b.note_pos WHERE a.template = 11""")
def r06_ibid(spark, sf_dir):
    c = citations(notes(spark, sf_dir)).where("back_note is not null or value like 'Ibid%'")
    return c.select("doc_id", "note_pos", "status", "celex")


@query(f""", e AS (SELECT *, {_ESTABLISHED} AS id FROM numbers)
       SELECT a.doc_id, a.note_pos, CASE WHEN b.id IS NULL THEN 'unresolved_not_found' WHEN b.id = 'several' THEN 'unresolved_ambiguous' ELSE 'resolved' END AS status, CASE WHEN b.id <> 'several' THEN b.id END AS celex,
       a.para AS paragraph FROM e a LEFT JOIN e b ON a.doc_id = b.doc_id AND b.note_pos = a.note_pos - 2 WHERE a.template = 11 AND COALESCE(b.template, 0) <> 11""")
def r06_supra(spark, sf_dir):
    rows = notes(spark, sf_dir)
    rows = rows.withColumn("text", F.when(F.col("template") == 11, F.format_string("Supra note %d, paragraph %d.", F.when(F.col("note_pos") > 2, F.col("note_pos") - 2).otherwise(99), "para")).otherwise(F.col("text")))
    pointed = rows.select("doc_id", (F.col("note_pos") + 2).alias("note_pos"), F.col("template").alias("_of"))
    c = citations(rows).where("value like 'Supra%'").join(pointed, ["doc_id", "note_pos"], "left").where("coalesce(_of, 0) <> 11")
    return c.select("doc_id", "note_pos", "status", "celex", F.col("locator_start").alias("paragraph"))


@query("""SELECT doc_id, note_pos, '3' || (2000 + before_yy) || 'L' || lpad(CAST(before_num AS VARCHAR), 4, '0') AS celex, 'explicit_alias' AS method, para AS article
       FROM (SELECT *, lag(yy) OVER w AS before_yy, lag(num) OVER w AS before_num FROM numbers WINDOW w AS (PARTITION BY doc_id ORDER BY note_pos)) WHERE note_pos % 2 = 0""".replace("SELECT doc_id", " SELECT doc_id", 1))
def r04_short_form(spark, sf_dir):
    rows = notes(spark, sf_dir)
    declares = F.format_string("Directive %d/%d/EU (“Zeta%d Act”).", F.col("yy") + 2000, F.col("num"), F.col("note_pos"))
    cites = F.format_string("See Article %d of the Zeta%d Act.", F.col("para"), F.col("note_pos") - 1)
    c = citations(rows.withColumn("text", F.when(F.col("note_pos") % 2 == 1, declares).otherwise(cites))).where("method is not null")
    return c.select("doc_id", "note_pos", "celex", "method", F.col("locator_start").alias("article"))


@query("""SELECT doc_id, note_pos, CASE key % 3 WHEN 0 THEN 'unconfirmed_suggestion' WHEN 1 THEN 'unresolved_ambiguous' ELSE 'unresolved_not_found' END AS status, CASE key % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS candidates,
       para AS paragraph FROM numbers""")
def r07_gaps(spark, sf_dir):
    k = F.col("key") % 3
    name = F.when(k == 0, "Bosman").when(k == 1, "Intel").otherwise("Post Danmark")
    rows = notes(spark, sf_dir).withColumn("text", F.format_string("%s, paragraph %d.", name, F.col("para")))
    return citations(rows).select("doc_id", "note_pos", "status", F.coalesce(F.size("candidates"), F.lit(0)).alias("candidates"), F.col("locator_start").alias("paragraph"))


@query(f""", e AS (SELECT doc_id, CASE WHEN template IN (0, 8, 9) THEN 'E' || template || (2000 + yy) || ':' || seq ELSE {_ESTABLISHED} END AS id FROM numbers WHERE template NOT IN (5, 6, 10, 11)
       UNION ALL SELECT doc_id, '12016P' || lpad(CAST(para + d AS VARCHAR), 3, '0') FROM numbers, (VALUES (0), (1)) AS v(d) WHERE template = 5)
       SELECT doc_id, count(DISTINCT id) AS authorities FROM e GROUP BY doc_id""")
def r10_authorities(spark, sf_dir):
    return cited_authorities(notes(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("authorities"))
