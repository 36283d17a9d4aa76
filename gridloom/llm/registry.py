"""The training-data queries as registered for the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate, html_text, near_dedup, packing, pii, quality, quality_rules, substring_dedup, toxicity, warc
from gridloom.llm.common import table


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=4096, end_id=1, tokenizer="word_bpe_49k.json")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_decontaminate, op3_near_dedup, op4_quality, op5_toxicity, op6_html_text, op7_warc, op8_quality_rules, op9_pii, op10_substring_dedup)}


#: Shingle sets, links by shared shingles, components by recursion.
OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT a AS doc_id, a AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a
), m AS (SELECT doc_id, min(seen) AS low FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.low, d.doc_id) AS component_id, coalesce(m.low, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""


#: Equal payloads by window; base32 of the SHA-1 by five hexadecimal digits at a time.
OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
), h AS (SELECT *, sha1(payload) AS sha FROM p
), d AS (SELECT *, list_transform(range(0, 8), lambda j: list_reduce(list_transform(range(1, 6), lambda k: (strpos('0123456789abcdef', substr(sha, 5 * j + k, 1)) - 1)::BIGINT), lambda a, b: a * 16 + b)) AS fives FROM h)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(fives, lambda v: list_aggregate(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> b) & 31)::INT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""

#: Bytes as hexadecimal digits: every 50-byte string, the smallest id that holds it, the bytes it covers elsewhere, and what is left.
OP10_SQL = """
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT doc_id, i, substr(h, (2 * i + 1)::BIGINT, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM t)
), m AS (SELECT g, min(doc_id) AS low FROM s GROUP BY g HAVING count(*) > 1
), c AS (SELECT s.doc_id, s.i FROM s JOIN m ON s.g = m.g AND m.low < s.doc_id
), o AS (SELECT *, i > max(i + 49) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS apart FROM c
), r AS (SELECT *, sum(CASE WHEN apart IS NULL OR apart THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o
), runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY doc_id, run
), kept AS (
  SELECT t.doc_id, runs.run, substr(t.h, (2 * coalesce(lag(runs.z) OVER w, 0) + 1)::BIGINT, (2 * (runs.a - coalesce(lag(runs.z) OVER w, 0)))::BIGINT) AS piece FROM t JOIN runs ON runs.doc_id = t.doc_id WINDOW w AS (PARTITION BY t.doc_id ORDER BY runs.run)
), ends AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS z FROM runs GROUP BY doc_id
), texts AS (SELECT doc_id, string_agg(piece, '' ORDER BY run) AS front FROM kept GROUP BY doc_id)
SELECT t.doc_id, (len(t.h) // 2)::BIGINT AS n_bytes, coalesce(e.n_removed, 0) AS n_removed, coalesce(e.n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(x.front, '') || substr(t.h, (2 * coalesce(e.z, 0) + 1)::BIGINT))) AS kept_sha256
FROM t LEFT JOIN ends e ON e.doc_id = t.doc_id LEFT JOIN texts x ON x.doc_id = t.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_near_dedup": OP3_SQL, "op7_warc": OP7_SQL, "op10_substring_dedup": OP10_SQL}
