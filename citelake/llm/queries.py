"""Queries of the corpus operators: each runs over its whole table with the
parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citelake.llm.minhash import classes

    return classes(_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citelake.llm.sharding import sharded

    return sharded(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citelake.llm.linededup import without_repeats

    return without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citelake.llm.langid import predicted

    return predicted(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citelake.llm.pii import pii_digest

    return pii_digest(_table(spark, sf_dir, "documents")).drop("scores")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citelake.llm.ann import neighbours

    return neighbours(_table(spark, sf_dir, "embeddings"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citelake.llm.embdedup import linked

    return linked(_table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from citelake.llm.packing import packed

    return packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citelake.llm.mixing import mixed_rates

    return mixed_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citelake.llm.quality import scored

    return scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_sharding": op2_sharding,
    "op3_line_dedup": op3_line_dedup,
    "op4_language": op4_language,
    "op5_pii": op5_pii,
    "op6_ann": op6_ann,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
}

def _pii_spans(name: str, pattern: str, text: str = "t") -> str:
    """Spans of one kind as list of (k, s, e, h): the hits, and the lengths of what is between."""
    hits, gaps = f"regexp_extract_all({text}, '{pattern}')", f"list_transform(regexp_split_to_array({text}, '{pattern}'), lambda x: length(x))"
    start = "CAST(list_sum(g[1:i]) + COALESCE(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"
    return f"""{name} AS (SELECT r, [{{'k': '{name}', 's': {start}, 'e': {start} + length(h[i]), 'h': h[i]}} FOR i IN range(1, len(h) + 1)] AS x
       FROM (SELECT r, {hits} AS h, {gaps} AS g FROM d))"""


_DIGITS = "regexp_replace(z.h, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST({_DIGITS}[i] AS INT) ELSE CAST({_DIGITS}[i] AS INT) * 2 % 10 + CAST({_DIGITS}[i] AS INT) // 5 END FOR i IN range(1, length({_DIGITS}) + 1)]) % 10 = 0"
_TURNED = "replace(z.h, ' ', '')[5:] || replace(z.h, ' ', '')[1:4]"
_CODES = f"list_transform(string_split({_TURNED}, ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)"
_MOD97 = f"list_reduce(list_prepend(0, {_CODES}), lambda a, c: (CASE WHEN c > 9 THEN a * 100 + c ELSE a * 10 + c END) % 97) = 1"
_JOINED = "array_to_string(list_transform({0}, lambda z: z.k || ':' || z.s || ':' || z.e), ',')"

OP5_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS t FROM documents),
       {_pii_spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+")},
       {_pii_spans("ip", r"[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)")},
       {_pii_spans("card", r"[0-9](?:[ -]?[0-9])+")},
       {_pii_spans("phone", r"[+][0-9][ ().0-9-]+[0-9]")},
       {_pii_spans("iban", r"\b[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]){11,30}\b", "replace(t, '_', '-')")},
       f AS (SELECT d.doc_id, email.x AS a,
         list_filter(ip.x, lambda z: len(list_filter(string_split(z.h, '.'), lambda p: length(ltrim(p, '0')) > 3 OR COALESCE(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255)) = 0) AS b,
         list_filter(card.x, lambda z: CASE WHEN length({_DIGITS}) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END) AS c,
         list_filter(phone.x, lambda z: length({_DIGITS}) BETWEEN 9 AND 15) AS p,
         list_filter(iban.x, lambda z: CASE WHEN length(replace(z.h, ' ', '')) BETWEEN 15 AND 34 THEN {_MOD97} ELSE false END) AS i
         FROM d JOIN email USING (r) JOIN ip USING (r) JOIN card USING (r) JOIN phone USING (r) JOIN iban USING (r))
       SELECT doc_id, CAST(len(a) AS BIGINT) AS n_email, CAST(len(b) AS BIGINT) AS n_ip, CAST(len(c) AS BIGINT) AS n_card, CAST(len(p) AS BIGINT) AS n_phone,
         sha256({_JOINED.format("list_concat(list_concat(a, b), list_concat(c, p))")}) AS base_sha256,
         {_JOINED.format("list_concat(list_concat(list_concat(a, b), list_concat(c, p)), i)")} AS spans FROM f"""

OP7_SQL = """WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
       g AS (SELECT r, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM t
         WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
       l AS (SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
       reach(a, b) AS (SELECT r, r FROM t UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
       c AS (SELECT reach.a AS r, min(t.vec_id) AS component_id FROM reach JOIN t ON reach.b = t.r GROUP BY reach.a),
       n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
       SELECT vec_id, COALESCE(n.n, 0) AS n_links, component_id, COALESCE(vec_id = component_id, true) AS kept FROM t JOIN c USING (r) LEFT JOIN n USING (r)"""

#: Brute force.  The query equals it where a block holds the whole table, as at sf0.01; beyond that its
#: recall is measured against such lists for a sample, so this is no proof for larger tables.
OP6_SQL = """WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
       g AS (SELECT * FROM t WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
       w AS (SELECT vec_id, e FROM g WHERE len(e) = (SELECT len(e) FROM g ORDER BY vec_id LIMIT 1)),
       p AS (SELECT q.vec_id AS query_id, w.vec_id, list_dot_product(q.e, w.e) AS score FROM w q JOIN w ON q.vec_id <> w.vec_id WHERE q.vec_id % 20 = 0)
       SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 20"""

#: DuckDB SQL where an operator's result can be expressed in it.
ORACLE_SQL: dict[str, str] = {"op5_pii": OP5_SQL, "op6_ann": OP6_SQL, "op7_embedding_dedup": OP7_SQL}
