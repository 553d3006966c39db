"""Training-data pipeline: quality rules, near-deduplication, substring deduplication, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of
documents. Near-deduplication takes shingles of five words and a similarity of 0.8; it keeps the smallest doc_id of a group.
Passages that repeat a document with a smaller doc_id are cut from the text; secrets are replaced by a mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import near_dedup, packing, quality_rules, secret_scan, substring_dedup
from quarry.llm.common import read_table, remove, write_scratch
from quarry.llm.queries import BYTE_BPE, VOCABULARIES


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, *VOCABULARIES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_passages(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, BYTE_BPE)


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("substring_dedup", passages), ("secret_scan", secrets), ("packing", packed)]

#: No SQL: tokenisers and chained alignments have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed documents; the table of a stage is removed when the next one's is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = write_scratch(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
