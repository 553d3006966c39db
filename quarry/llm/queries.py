"""Queries that apply the operators, with production parameters, to whole tables; and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import centroids, embedding_dedup, hard_negatives, lm_scoring, license_scan, near_dedup, nearest, packing, quality_rules, secret_scan, sentencepiece_codec, substring_dedup, token_output
from quarry.llm.common import read_table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARIES = (PIECES, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(read_table(spark, sf_dir, "documents"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(read_table(spark, sf_dir, "documents"), BYTE_BPE)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_digest(read_table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(read_table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), BYTE_BPE)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"), *VOCABULARIES)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(read_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.codec_digest(read_table(spark, sf_dir, "documents"), PIECES)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(read_table(spark, sf_dir, "embeddings"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings").withColumn("label", moved))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_token_output, op3_secret_scan, op4_minhash_near_dedup, op5_license_scan, op6_nearest_neighbours, op7_packing, op8_quality_rules, op9_lm_scoring, op10_sentencepiece, op11_centroid_clustering, op12_embedding_near_dedup, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash_near_dedup": near_dedup.NEAR_SQL, "op5_license_scan": license_scan.scan_sql(), "op11_centroid_clustering": centroids.clusters_sql(), "op12_embedding_near_dedup": embedding_dedup.NEAR_SQL, "op13_hard_negatives": hard_negatives.NEGATIVES_SQL}
