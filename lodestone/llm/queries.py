"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe_stream, exchange, forest, line_rules, media, mixing, pii, quality_crf, toxicity, url_lm, variants, warc
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.histories(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.encode_column(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.classes(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lm.judge(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = (F.col("size") * F.col("copies")).cast("long").alias("taken")
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.exact_groups(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignments(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_media_columns, op2_toxicity, op3_quality_crf, op4_warc, op5_quality_rules, op6_pii, op7_bpe, op8_jaccard_join, op9_url_filter, op10_mixing, op11_exact_dedup, op12_alignment, op13_spelling_variants)
}

ORACLES: dict[str, str] = {
    "op4_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d,
  coalesce(nullif(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE url END, ''), url, '') AS rest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id, split_part(rest, '/', 1) AS host FROM p),
k AS (SELECT *, CASE WHEN rest = '' THEN '' ELSE array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || regexp_extract(substr(rest, length(host) + 1), '^[^#]*') END AS url_key,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id % 315360000), '%Y%m%d%H%M%S') AS ts FROM f)
SELECT page_id, url_key, ts, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to,
       row_number() OVER (ORDER BY url_key, ts, page_id) - 1 AS capture_no
FROM k
""",
    "op8_jaccard_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), t AS (SELECT doc_id, ws, CASE WHEN len(ws) = 0 THEN '' ELSE text END AS same FROM w
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM t
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 10 * k >= 8 * (nx.n + ny.n - k)
  UNION SELECT a.doc_id, b.doc_id FROM t a JOIN t b ON a.same = b.same AND a.doc_id < b.doc_id
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(node, root) AS (SELECT doc_id, doc_id FROM t UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node
), c AS (SELECT node, min(root) AS class_id FROM r GROUP BY node
), d AS (SELECT x, count(*) AS links FROM e GROUP BY x)
SELECT t.doc_id, c.class_id, min(t.doc_id) OVER (PARTITION BY t.same) AS text_id, coalesce(d.links, 0) AS n_links
FROM t JOIN c ON c.node = t.doc_id LEFT JOIN d ON d.x = t.doc_id
""",
    "op10_mixing": mixing.ORACLE_SQL,
    "op11_exact_dedup": exchange.ORACLE_SQL,
    "op13_spelling_variants": variants.ORACLE_SQL,
}
