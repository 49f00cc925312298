"""The queries op1 to op13 and their SQL; each runs its operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .decontamination import decontaminate
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .html_extraction import extract
from .language_id import identify
from .line_dedup import removed_lines
from .lm_scoring import lm_score
from .ngram_join import ngram_join
from .packing import pack
from .pii import find_pii
from .quality import judge
from .source_audit import source_audit
from .suffix_dedup import suffix_dedup


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed_lines"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id", "lang"])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), every=100)


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_pii": op4_pii,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_packing": op8_packing,
    "op9_html_extraction": op9_html_extraction,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_source_audit": op11_source_audit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_lm_scoring": op13_lm_scoring,
}

ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
i AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL),
windows AS (
    SELECT DISTINCT item_id, w[k:k + 9] AS win, len(w[k:k + 9]) AS n
    FROM i, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s(k) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
    SELECT doc_id, k, n, w[k:k + n - 1] AS win
    FROM d, lengths, unnest(generate_series(1, len(w) - n + 1)) AS s(k)),
hits AS (SELECT doc_id, k, n, item_id FROM grams JOIN windows USING (win, n)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(generate_series(k, k + n - 1)) AS s(p) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op7_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS s FROM d, unnest(generate_series(1, greatest(1, len(w) - 2))) AS t(k) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes m ON m.doc_id = x JOIN sizes n ON n.doc_id = y WHERE 100 * c >= 90 * (m.n + n.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, x AS r FROM edges UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON edges.x = reach.r),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id),
same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY g) AS set_id FROM (SELECT doc_id, string_agg(s, chr(10) ORDER BY s) AS g FROM sets GROUP BY doc_id))
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(set_id, doc_id) AS set_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id) LEFT JOIN same USING (doc_id)""",
    "op10_exact_dedup": r"""
WITH n AS (
    SELECT doc_id, length(coalesce(text, '')) AS n,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS s
    FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY s) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept,
       s AS text_sha256
FROM n WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id)""",
    "op11_source_audit": r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents),
tf AS (SELECT r, lang, source, t, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS t FROM d) GROUP BY ALL),
kept AS (SELECT lang, t, CAST(sum(n) AS HUGEINT) AS ln FROM tf GROUP BY lang, t HAVING count(*) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(ln) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, t, CAST(sum(n) AS HUGEINT) AS n FROM tf JOIN kept USING (lang, t) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (
    SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // CAST(g.total + v AS HUGEINT) AS p,
           1 + CAST(1000000000 AS HUGEINT) * (k.ln + 1) // CAST(l.total + v AS HUGEINT) AS q
    FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, t AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
    SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
    UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= 200)
SELECT * FROM ranked""",
    "op12_hard_negatives": r"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
scores AS (
    SELECT a.vec_id AS anchor_id, a.label AS a_label, b.vec_id, b.label, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
liked AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE label = a_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM liked JOIN scores USING (anchor_id) WHERE label <> a_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
}
