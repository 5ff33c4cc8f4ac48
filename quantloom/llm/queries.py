"""The registered queries of the text operators, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, extract, langid, lm, media, neardup, pieces, pii, quality


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extracted(common.read(spark, sf_dir, "pages"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sampled(common.read(spark, sf_dir, "documents"), vocabulary(), digest=True)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return lm.scored(docs, lm.fit(docs))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(common.read(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(common.read(spark, sf_dir, "documents"), vocabulary(), limit=4096)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    held_out = common.crc_of_id() % 4 == 2
    return langid.predicted(docs, langid.fit(docs.where(~held_out)), held_out=held_out)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    held_out = common.crc_of_id() % 5 == 0
    model = quality.fit(docs, common.read(spark, sf_dir, "labels"), fold=~held_out)
    return quality.scored(docs, model, held_out=held_out)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_payloads(common.read(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped(common.read(spark, sf_dir, "documents"), percent=85)


QUERIES = {
    "op1_html_main_text": op1,
    "op2_piece_sampling": op2,
    "op3_lm_pseudo_likelihood": op3,
    "op4_decontamination": op4,
    "op5_personal_data": op5,
    "op6_token_counts": op6,
    "op7_language_id": op7,
    "op8_quality_additive": op8,
    "op9_telephony_media": op9,
    "op10_near_duplicates": op10,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _spans_sql() -> str:
    """Operator 5: each kind's matches with their places (the lengths of what lies between and before them), checks, context scores."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
        "national": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: (CAST(substr({digits}, length({digits}) - i + 1, 1) AS INT) * (2 - i % 2) + 9) % 9 + CASE WHEN substr({digits}, length({digits}) - i + 1, 1) = '9' AND i % 2 = 0 THEN 9 WHEN substr({digits}, length({digits}) - i + 1, 1) = '9' THEN 9 ELSE 0 END)) % 10 = 0"
    code = "replace(m, ' ', '')"
    turned = f"(substr({code}, 5) || substr({code}, 1, 4))"
    value = "CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END"
    mod97 = f"list_reduce(list_transform(range(1, length({turned}) + 1), lambda i: substr({turned}, i, 1)).list_transform(lambda c: {value}), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97, 0) = 1"
    checks = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255'))) = 0",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"length({code}) BETWEEN 15 AND 34 AND {mod97}",
        "national": "true",
    }
    parts = []
    for i, (kind, p) in enumerate(patterns.items()):
        parts.append(
            f"""SELECT doc_id, t, '{kind}' AS kind, {i} AS k, a, a + length(m) AS b, {pii.PRIOR[kind][1]}e0 AS prior, '(?i)\\b(?:{pii.WORDS[kind]})\\b' AS words
FROM (SELECT doc_id, t, ms[i] AS m, CAST(list_sum(list_transform(gs[1 : i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda g: length(g))), 0) AS BIGINT) AS a
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS gs FROM d)))
WHERE {checks[kind]}"""
        )
    found = "\nUNION ALL ".join(parts)
    near = f"(substr(t, greatest(a - {pii.NEAR}, 0) + 1, least(a, {pii.NEAR})) || ' ' || substr(t, b + 1, {pii.NEAR}))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
scored AS (SELECT *, round(least(1, greatest(0, prior + CASE WHEN regexp_matches({near}, words) THEN {pii.STEP}e0 ELSE 0 END - CASE WHEN regexp_matches({near}, '(?i)\\b(?:{pii.AGAINST})\\b') THEN {pii.STEP}e0 ELSE 0 END)), 3) AS score FROM found),
kept AS (SELECT *, kind || ':' || a || ':' || b AS span FROM scored WHERE k < 4 OR score >= {pii.THRESHOLD}e0),
sums AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS e, count(*) FILTER (WHERE k = 1) AS i, count(*) FILTER (WHERE k = 2) AS c, count(*) FILTER (WHERE k = 3) AS p,
  string_agg(span, ',' ORDER BY a, k) FILTER (WHERE k < 4) AS base, string_agg(span, ',' ORDER BY a, k) AS spans, string_agg(printf('%g', score), ',' ORDER BY a, k) AS scores FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN sums USING (doc_id)
"""


ORACLES = {
    "op5_personal_data": _spans_sql(),
    "op4_decontamination": rf"""
WITH iw AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), items AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM iw WHERE len(w) > 0
), wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)
), docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), dwins AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)
), met AS (
  SELECT d.doc_id, d.i, d.n, x.item_id FROM dwins d JOIN wins x ON d.n = x.n AND d.win = x.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id
), own AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(o.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(o.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN own o USING (doc_id)
""",
    "op10_near_duplicates": rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT p.a, p.b
  FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id) p
  JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b
  WHERE 100 * p.both >= 85 * (m.n + n.n - p.both)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM docs UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM docs d JOIN comp c USING (doc_id) LEFT JOIN sizes s USING (doc_id)
""",
}
