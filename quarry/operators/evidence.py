"""Evidence from live and static sources, trust by venue, gold checks, gates and changes since a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trust_weighted(scored: DataFrame, places: DataFrame, trust: DataFrame) -> DataFrame:
    """qid, snippet_id, score: scores times the multiplier of the snippet's venue; an unknown or null venue leaves them as they are.

    places: snippet_id, venue. trust: source_name, multiplier. Venues are matched trimmed and in lower case.
    """
    known = trust.select(F.lower(F.trim("source_name")).alias("key"), "multiplier")
    placed = places.select("snippet_id", F.lower(F.trim("venue")).alias("key"))
    return scored.join(placed, "snippet_id").join(known, "key", "left").select("qid", "snippet_id", (F.col("score") * F.coalesce("multiplier", F.lit(1.0))).alias("score"))


def scaled(rows: DataFrame, value: str) -> DataFrame:
    """rows with score: value from 0 (the least) to 1 (the largest); 1 if all are equal."""
    low, high = rows.agg(F.min(value)).scalar(), rows.agg(F.max(value)).scalar()
    return rows.withColumn("score", F.when(low == high, 1.0).otherwise(F.try_divide((F.col(value) - low).cast("double"), (high - low).cast("double"))))


def live_over_static(live: DataFrame, static: DataFrame, boost: float = 1.05) -> DataFrame:
    """snippet_id, score, live: live scores, raised and at most 1, replace static ones of the same snippet."""
    both = live.select("snippet_id", F.least(F.lit(1.0), boost * F.col("score")).alias("l")).where("l IS NOT NULL").join(static.select("snippet_id", F.col("score").alias("s")), "snippet_id", "full")
    return both.select("snippet_id", F.coalesce("l", "s").alias("score"), F.col("l").isNotNull().alias("live"))


def live_first(live: DataFrame, static: DataFrame, k: int) -> DataFrame:
    """snippet_id, live, score, rank of the first k snippets: live ones by score, then static ones that aren't live."""
    every = live.select("snippet_id", F.lit(True).alias("live"), "score").union(static.select("snippet_id", F.lit(False), "score"))
    once = every.groupBy("snippet_id").agg(F.max(F.struct("live", "score")).alias("m")).select("snippet_id", "m.live", "m.score")
    order = [F.desc("live"), F.desc("score"), F.col("snippet_id")]
    return once.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def changes_since(changes: DataFrame, run: int) -> DataFrame:
    """The changes later than the last one of a run; none if the run has none."""
    return changes.where(F.col("at") > changes.where(F.col("run") == run).agg(F.max("at")).scalar())


def gold_scores(checks: DataFrame, group: str) -> DataFrame:
    """group, checks, passed, score: the passed share of the weights, 1 where they sum to nothing."""
    done = F.sum(F.when(F.col("passed"), F.col("weight")).otherwise(0.0))
    return checks.groupBy(group).agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed"), F.round(F.coalesce(F.try_divide(done, F.sum("weight")), F.lit(1.0)), 4).alias("score"))


def regressions(runs: DataFrame, worst: float) -> DataFrame:
    """Runs with the change of metric against the run before, in percent, and whether it is over worst. A first run has no change."""
    before = F.lag("metric").over(Window.partitionBy("topic").orderBy("run_id"))
    change = F.try_divide((F.col("metric") - F.col("before")) * 100, F.col("before"))
    return runs.withColumn("before", before).withColumn("change", change).withColumn("regressed", F.coalesce(F.col("change") > worst, F.lit(False))).drop("before")
