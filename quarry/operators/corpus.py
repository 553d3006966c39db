"""Corpus ETL: extraction quality, health, deltas, deduplication, enrichment, HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scores, text


def extraction_quality(docs: DataFrame) -> DataFrame:
    """doc_id, score, band: length, letters, control characters, line length around 80, headings."""
    c = docs.select("doc_id", "text", text.compact(F.col("text")).alias("c"))
    total = F.length("c")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    mean = F.aggregate(lines, F.lit(0.0), lambda s, x: s + F.length(x)) / F.size(lines)
    # a fifth of the letters over all, in this order, since halves of the last place depend on it
    alnum = F.length(F.regexp_replace("c", r"[^\p{L}\p{N} ]", "")) * 20 / 100 / total
    weird = (total - F.length(F.regexp_replace("c", "[\x01-\x08\x0e-\x1f�]", ""))) / total
    heading = F.when(F.lower("c").rlike("abstract|introduction|references"), 0.1).otherwise(0.065)
    score = 0.35 * F.least(F.lit(1.0), total / 3000) + alnum + 0.20 * (1 - F.least(F.lit(1.0), weird * 6)) + 0.15 * (1 - F.least(F.lit(1.0), F.abs(mean - 80) / 120)) + heading
    scored = c.select("doc_id", F.when(total == 0, 0.0).otherwise(scores.clamp(score)).alias("score"))
    return scored.select("doc_id", scores.nearest(F.col("score"), 6).alias("score"), F.when(F.col("score") >= 0.75, "good").when(F.col("score") >= 0.45, "ok").otherwise("poor").alias("band"))


def hashed(snippets: DataFrame) -> DataFrame:
    return snippets.select("snippet_id", F.sha2(F.concat_ws("|", "snippet_id", "paper_id", "section", "text"), 256).alias("content_hash"))


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """snippet_id, change (added, removed, changed) of two manifests, in one full join."""
    both = old.select("snippet_id", F.col("content_hash").alias("o")).join(new.select("snippet_id", F.col("content_hash").alias("n")), "snippet_id", "full")
    return both.select("snippet_id", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed").alias("change")).where(F.col("change").isNotNull())


def dedup_papers(papers: DataFrame, order: list[str]) -> DataFrame:
    """The first paper of each key: DOI, else arXiv id, else title letters."""
    title = F.substring(F.regexp_replace(F.lower("title"), r"(?U)\W+", ""), 1, 64)
    key = F.when(F.coalesce(F.col("doi"), F.lit("")) != "", F.concat(F.lit("doi:"), F.lower("doi"))).when(F.coalesce(F.col("arxiv_id"), F.lit("")) != "", F.concat(F.lit("arxiv:"), F.lower("arxiv_id"))).otherwise(F.concat(F.lit("title:"), title))
    keyed = papers.withColumn("dedupe_key", key)
    return keyed.withColumn("n", F.row_number().over(Window.partitionBy("dedupe_key").orderBy(*order))).where("n = 1").drop("n")


def enriched(snippets: DataFrame, papers: DataFrame) -> DataFrame:
    """Missing year, venue and citations from the paper; `changed` says where. Spark broadcasts papers if they are small."""
    both = snippets.join(papers.select("paper_id", *(F.col(c).alias(f"p_{c}") for c in ("year", "venue", "citations"))), "paper_id", "left")
    year = F.coalesce("year", "p_year")
    venue = F.when(F.coalesce(F.col("venue"), F.lit("")) == "", F.col("p_venue")).otherwise(F.col("venue"))
    cites = F.when(F.coalesce(F.col("citations"), F.lit(0)) == 0, F.coalesce("p_citations", F.lit(0))).otherwise(F.col("citations"))
    changed = ~(year.eqNullSafe(F.col("year")) & venue.eqNullSafe(F.col("venue")) & cites.eqNullSafe(F.col("citations")))
    return both.select("snippet_id", "paper_id", year.alias("year"), venue.alias("venue"), cites.alias("citations"), changed.alias("changed"))
