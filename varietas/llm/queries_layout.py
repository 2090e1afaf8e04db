"""Registered queries of the operators that lay data out: archive, shards, mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varietas.llm import kdtree, mixing, warc
from varietas.llm.common import n_words, read

N_SHARDS = 24


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to a content-addressed archive and report what the archive holds."""
    archive = warc.write_archive(read(spark, sf_dir, "pages"))
    return warc.read_index(archive, spark).select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


def sharded(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of ``docs(doc_id, text, lang, source)``."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.col("lang").alias("m_lang"), F.col("source").alias("m_source"),
                       F.length(F.coalesce("text", F.lit(""))).alias("m_chars"),
                       (F.octet_length(body) + 8).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"), F.xxhash64("text").alias("text_hash"))
    coords = {"lang": kdtree.unit_hash(F.col("m_lang")), "source": kdtree.unit_hash(F.col("m_source")),
              "chars": kdtree.log_coord(F.col("m_chars"))}
    out = kdtree.shard(rows, n_shards, F.col("size"), F.col("text_hash"), coords, ["doc_id", "text_hash"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op9_kdtree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes, split by language, source and length."""
    return sharded(read(spark, sf_dir, "documents"))


def mixed(docs: DataFrame) -> DataFrame:
    """Copies of every row of ``docs(doc_id, text, source)`` in the mix (sizes in words)."""
    return mixing.mix(docs, n_words(F.col("text")), text_hash=F.xxhash64("text"))


def op10_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all sources at weights 3, 1, 2: words taken from every document."""
    return mixed(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op7_warc": op7_warc, "op9_kdtree_shards": op9_kdtree_shards, "op10_cube_mix": op10_cube_mix}

ORACLE = {
    "op7_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT hex, octet_length(b) AS n, min(page_id) AS first_id FROM p GROUP BY 1, 2),
d AS (SELECT page_id, octet_length(b) AS n, hex,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, (5 * (k // 4) + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (k % 4))::INTEGER) & 31) + 1)::INTEGER, 1)),
    'string_agg', '') AS b32 FROM p)
SELECT d.page_id, d.n::BIGINT AS payload_bytes, b32 AS payload_digest,
  CASE WHEN d.page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d JOIN firsts USING (hex, n)""",
}
