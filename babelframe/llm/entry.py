"""Queries of this subpackage for __spark_entry__.py, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_decode
from .common import table
from .embed_dedup import embed_dedup
from .exact_dedup import exact_dedup
from .langid import language_id
from .minhash import near_dedup
from .packing import pack
from .sharding import interleave
from .token_count import token_counts
from .toxicity import toxicity
from .warc import damaged, fixity_report


def op1_shard_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents"), shards=16).drop("position")


def op3_exact_dedup_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_pack_min_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_token_count_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op9_bpe_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


def op5_toxicity_subword_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op2_near_dedup_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op4_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC records, audited against a replica with damage by a stated rule."""
    pages = table(spark, sf_dir, "pages")
    return fixity_report(pages, damaged(pages))


def op6_embedding_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_interleave": op1_shard_interleave,
    "op2_near_dedup_bagminhash": op2_near_dedup_bagminhash,
    "op3_exact_dedup_recipes": op3_exact_dedup_recipes,
    "op4_warc_merkle_audit": op4_warc_merkle_audit,
    "op5_toxicity_subword_softmax": op5_toxicity_subword_softmax,
    "op6_embedding_cover_tree": op6_embedding_cover_tree,
    "op7_language_id_bigru": op7_language_id_bigru,
    "op8_token_count_transducer": op8_token_count_transducer,
    "op9_bpe_distinct_words": op9_bpe_distinct_words,
    "op10_pack_min_slack": op10_pack_min_slack,
}

#: CRC-32 in SQL: the table of its bytes, and the fold over the bytes of a text column.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t
  FROM (SELECT range AS n FROM range(256))
)"""


def _crc(text: str) -> str:
    return f"""xor(list_reduce(list_transform(regexp_extract_all(hex({text}), '..'), lambda p: CAST('0x' || p AS BIGINT)),
                         lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"""


ORACLES: dict[str, str] = {
    "op1_shard_interleave": f"""
WITH {CRC_TABLE}, docs AS (
  SELECT *, md5('shard-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(text_crc32 AS VARCHAR) || ':' || CAST(size AS VARCHAR)) AS h
  FROM (SELECT doc_id, source, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {_crc("coalesce(text, '')")} AS text_crc32 FROM documents, crc_table)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) AS r, count(*) OVER (PARTITION BY source) AS n FROM docs
), placed AS (
  SELECT *, row_number() OVER (ORDER BY CAST(2 * r - 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), h, doc_id, text_crc32, size) - 1 AS p, count(*) OVER () AS total FROM ranked
), cut AS (SELECT *, p * 16 // total AS k FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(k AS INTEGER) AS shard,
       CAST(p - (k * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
""",
    "op4_warc_merkle_audit": f"""
WITH {CRC_TABLE}, rec AS (
  SELECT page_id, html, coalesce(CAST(floor(page_id / 1024.0) AS BIGINT), -1) AS warc_file,
         'WARC/1.0' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'none') || '>' || e || 'WARC-Date: 2000-01-01T00:00:00Z' || e || 'WARC-Target-URI: ' ||
         coalesce(regexp_replace(url, '[\\r\\n]', '', 'g'), '') || e || 'Content-Type: text/html' || e || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || e || e || coalesce(html, '') || e || e AS r,
         {_crc("CAST(page_id AS VARCHAR)")} AS c
  FROM (SELECT *, chr(13) || chr(10) AS e FROM pages), crc_table
), hashed AS (SELECT *, sha256(r) AS record_sha256, CAST(strlen(r) AS BIGINT) AS length FROM rec)
SELECT page_id, warc_file, row_number() OVER w - 1 AS position,
       CAST(coalesce(sum(length) OVER (PARTITION BY warc_file ORDER BY page_id NULLS FIRST, record_sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       length, record_sha256, NOT coalesce(c % 97 = 0 AND left(html, 1) <> '?', false) AS intact
FROM hashed WINDOW w AS (PARTITION BY warc_file ORDER BY page_id NULLS FIRST, record_sha256)
""",
    "op6_embedding_cover_tree": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT a AS x, b AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
       least(e.vec_id, coalesce((SELECT min(r.y) FROM reach r WHERE r.x = e.vec_id), e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce((SELECT min(r.y) FROM reach r WHERE r.x = e.vec_id), e.vec_id)) AS kept
FROM embeddings e
""",
    "op3_exact_dedup_recipes": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
""",
}
