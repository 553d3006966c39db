"""Snapshots of live sources: which are still fresh, and their items as snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text


def cached(snapshots: DataFrame, now, ttl_seconds: int) -> DataFrame:
    """The last of snapshots(key, retrieved_at) of each key that is ttl_seconds old at most. With ttl_seconds of 0 or less nothing is fresh."""
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("retrieved_at")))
    age = F.unix_micros(now) - F.unix_micros("retrieved_at")
    rows = snapshots.where((age <= ttl_seconds * 1_000_000) & F.lit(ttl_seconds > 0))
    return rows.withColumn("turn", newest).where("turn = 1").drop("turn")


def snippets(snapshots: DataFrame, most: int = 20) -> DataFrame:
    """snippet_id, paper_id, section, venue, text, token_count of snapshots(snapshot_id, items of source and text).

    The first `most` items of each, which is the feature's own limit, without markup. Empty ones give no row but keep their number.
    """
    rows = snapshots.select("snapshot_id", F.posexplode(F.slice("items", 1, max(1, most))).alias("at", "item"))
    told = rows.select("snapshot_id", "at", F.col("item.source").alias("venue"), text.strip_html(F.coalesce("item.text", F.lit(""))).alias("text")).where("text <> ''")
    paper = F.concat(F.lit("SNAP:"), F.col("snapshot_id").cast("string"))
    return told.select(
        F.concat(paper, F.lit(":S"), (F.col("at") + 1).cast("string")).alias("snippet_id"), paper.alias("paper_id"), F.lit("live").alias("section"), "venue", "text",
        F.greatest(F.lit(1), F.size(F.split("text", r"\s+"))).cast("long").alias("token_count"),
    )
