"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoframe.llm import common, embeddings, media, mixing, packing, quality, sharding, simhash, token_counts, token_output, warc

SHARDS = [f"shard-{k:03d}" for k in range(64)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.links(_table(spark, sf_dir, "embeddings"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "token-files")
    token_output.write(_table(spark, sf_dir, "documents"), path)
    return token_output.digests(token_output.read(spark, path))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, *quality.fit(docs, _table(spark, sf_dir, "labels")))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.choose(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", SHARDS)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "media")
    return media.read(spark, media.write(_table(spark, sf_dir, "documents"), path))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_embedding_near_dedup, op2_token_output, op3_packing, op4_quality_classifier, op5_simhash_near_dedup,
              op6_mixing, op7_token_counts, op8_sharding, op9_media_columns, op10_warc)
}

_SHARD_SQL = f"""
WITH s AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {sharding.PRIME} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(CAST(([{','.join(map(str, sharding.lookup_table(SHARDS)))}])[slot + 1] AS VARCHAR), 3, '0') AS shard FROM s"""

_LINK_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
c AS (SELECT vec_id AS node, vec_id AS component FROM embeddings UNION SELECT l.w, c.component FROM c JOIN l ON c.node = l.u),
m AS (SELECT node, min(component) AS component_id FROM c GROUP BY node), n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN m ON vec_id = node LEFT JOIN n ON vec_id = u"""

#: Base 32 of a SHA-1 from its hex digits: 32 groups of five bits, each within two digits.
_WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(p.h, CAST(i * 5 // 4 + 1 AS INT), 2) AS INT) >> CAST(3 - i * 5 % 4 AS INT)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f ON p.h = f.h"""

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": _LINK_SQL,
    "op6_mixing": mixing.oracle_sql(),
    "op8_sharding": _SHARD_SQL,
    "op10_warc": _WARC_SQL,
}
