"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, extract, fingerprint, langid, mixing, neardup, pii, toxicity, vafile, warc
from .common import held_out, table


def _digest(op: Callable[[DataFrame], DataFrame], name: str = "documents") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(table(spark, sf_dir, name))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train_on_documents(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "accepted")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digest_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.PREDICT).cast("int").alias("predicted"), "best")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_duplicates": _digest(neardup.near_duplicates),
        "op2_language_id": op2_language_id,
        "op3_warc": _digest(lambda pages: warc.archive_and_read(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "pages"),
        "op4_html_text": _digest(extract.extract, "pages"),
        "op5_vector_top_k": _digest(vafile.top_k, "embeddings"),
        "op6_byte_bpe": op6_byte_bpe,
        "op7_mixing": _digest(lambda docs: mixing.mix(docs).drop("key")),
        "op8_pii": _digest(pii.digest_pii),
        "op9_fingerprints": _digest(fingerprint.fingerprints),
        "op10_toxicity": op10_toxicity,
    }


#: All pairs of texts by their sets of five-word shingles; what links connect is a class.
OP1 = r"""
WITH RECURSIVE d AS (
  SELECT t, row_number() OVER (ORDER BY t) AS id FROM (SELECT DISTINCT coalesce(text, '') AS t FROM documents)
), w AS (
  SELECT id, regexp_extract_all(lower(t), '[\p{L}\p{N}_]+') AS ws FROM d
), s AS (
  SELECT DISTINCT id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT id, count(*) AS n FROM s GROUP BY id
), links AS (
  SELECT p.a, p.b FROM (SELECT a.id AS a, b.id AS b, count(*) AS both FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2) p
  JOIN n x ON x.id = p.a JOIN n y ON y.id = p.b WHERE p.both::DOUBLE / (x.n + y.n - p.both) >= 0.8
), reach AS (
  SELECT id, id AS other FROM d UNION SELECT r.id, e.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = r.other
), class AS (
  SELECT id, min(other) AS root FROM reach GROUP BY id
), r AS (
  SELECT doc_id, root FROM documents JOIN d ON d.t = coalesce(text, '') JOIN class USING (id)
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS class_id FROM r
"""

OP3 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM m
"""

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_duplicates": OP1, "op3_warc": OP3, "op5_vector_top_k": OP5}
