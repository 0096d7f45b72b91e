"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, bpe_count, langid, license_scan, minhash, mixing, packing, quality_gbt, quality_rules, sharding,
               spelling, warc, whitening)
from .common import held_out, table


def op1_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from ``labels.quality``."""
    docs = table(spark, sf_dir, "documents")
    model = quality_gbt.fit(docs, table(spark, sf_dir, "labels"))
    return (quality_gbt.score(docs, model, keep=["doc_id"])
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"))


def op2_minhash_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_license_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op6_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to Zstandard WARC archives and read back."""
    return (warc.round_trip(table(spark, sf_dir, "pages"))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op7_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_int8_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every vector whose id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_subword_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    return (langid.identify(docs, langid.fit(docs), keep=["doc_id"])
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected"))


def op10_heap_bpe_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document."""
    return bpe_count.count_tokens(table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every usable vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their dominant near word."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, copies of a text together as far as the quotas allow."""
    return sharding.balanced_shards(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_gbt, op2_minhash_bottom_k, op3_hierarchical_packing, op4_license_set_join,
    op5_hash_threshold_mix, op6_warc_zstd, op7_adaptive_rules, op8_int8_block_join, op9_subword_langid,
    op10_heap_bpe_count, op11_whitening, op12_spelling_variants, op13_label_shards)}

# The exact twin of the hash thresholds: the same 60 bits of md5, the boundary found by a running sum.
_MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, CAST(source_size * 3 AS DOUBLE) AS cap,
         sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(CAST(source_size * 3 AS DOUBLE)) OVER b, 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS wrest
  FROM per
  WINDOW b AS (ORDER BY CAST(source_size * 3 AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, rest / wrest * w >= cap AS capped FROM o),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap
              ELSE w * (max(CASE WHEN NOT capped THEN rest END) OVER () / max(CASE WHEN NOT capped THEN wrest END) OVER ()) END AS target
  FROM c),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
p AS (SELECT *, target - CAST(whole * source_size AS DOUBLE) AS part FROM g),
h AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
r AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS run FROM h),
e AS (
  SELECT p.source, r.h, CASE WHEN run <= part THEN 1
         WHEN run - n <= part AND run - part < part - (run - n) THEN 1 ELSE 0 END AS more
  FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, d.size, p.source_size, p.target, CAST(d.size * (p.whole + e.more) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.h = e.h
"""

SQL = {"op5_hash_threshold_mix": _MIX}
