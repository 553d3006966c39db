"""Monitoring: noise control per trigger, runs against their predecessor, intervals, latency figures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NOISE = "topic string, at timestamp, fired boolean, emitted boolean, suppressed_by string"


def step(fired: bool, at: pd.Timestamp, hits: int, last: pd.Timestamp | None, hysteresis: int, cooldown: pd.Timedelta) -> tuple[bool, str | None, int, pd.Timestamp | None]:
    """emitted, suppressed_by, hits, last emission. Suppression by cooldown keeps counting hits, emission begins anew."""
    if not fired:
        return False, "not_fired", 0, last
    hits += 1
    if hits < max(1, hysteresis):
        return False, "hysteresis", hits, last
    if last is not None and at - last < cooldown:
        return False, "cooldown", hits, last
    return True, None, 0, at


def noise_control(decisions: DataFrame, hysteresis: int, cooldown_minutes: int) -> DataFrame:
    """topic, at, fired, emitted, suppressed_by of decisions(topic, at, fired).

    Sorted partitions are folded as a stream with the state of the current topic alone, so a topic with very many
    decisions is never held as a whole.
    """
    cooldown = pd.Timedelta(minutes=max(0, cooldown_minutes))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        topic, hits, last = object(), 0, None
        for frame in frames:
            out = []
            for t, at, fired in frame.itertuples(index=False):
                if t != topic:
                    topic, hits, last = t, 0, None
                emitted, why, hits, last = step(bool(fired), at, hits, last, hysteresis, cooldown)
                out.append((t, at, bool(fired), emitted, why))
            yield pd.DataFrame(out, columns=["topic", "at", "fired", "emitted", "suppressed_by"])

    return decisions.select("topic", "at", "fired").repartition("topic").sortWithinPartitions("topic", "at").mapInPandas(fold, NOISE)


def against_previous(runs: DataFrame, ok: str) -> DataFrame:
    """Each run with the id and metric of the latest earlier run of its topic that was ok."""
    before = Window.partitionBy("topic").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.expr(ok), F.struct(F.col("run_id").alias("previous_run"), F.col("metric").alias("previous_metric"))), ignorenulls=True).over(before)
    return runs.withColumn("p", last).select(*runs.columns, "p.previous_run", "p.previous_metric")


def interval_violations(emissions: DataFrame, cooldown: str) -> DataFrame:
    """Emissions less than the previous one's cooldown after it, in whole minutes."""
    w = Window.partitionBy("topic").orderBy("at")
    minutes = F.floor((F.unix_timestamp("at") - F.unix_timestamp(F.lag("at").over(w))) / 60)
    return emissions.withColumn("minutes", minutes).withColumn("needed", F.lag(cooldown).over(w)).where("minutes < needed")


def latency(rows: DataFrame, group: str, value: str, buckets: int = 64) -> DataFrame:
    """n, mean, p50, p95 (the value at floor((n - 1) * p) of the sorted ones) of each group.

    Equal values are counted first. Ranks are running sums within a bucket of values and over the few buckets of a group,
    so that a group of very many values is no one task's work.
    """
    counts = rows.select(group, F.col(value).alias("v")).where(F.col("v").isNotNull()).groupBy(group, "v").agg(F.count("*").alias("n"))
    ends = counts.groupBy(group).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("all"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    share = F.coalesce(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    dealt = counts.join(ends, group).withColumn("bucket", F.least(F.lit(buckets - 1), F.floor(share * buckets)))
    sizes = dealt.groupBy(group, "bucket").agg(F.sum("n").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.partitionBy(group).orderBy("bucket")) - F.col("size")).drop("size")
    last = dealt.join(before, [group, "bucket"]).withColumn("last", F.col("before") + F.sum("n").over(Window.partitionBy(group, "bucket").orderBy("v")) - 1)
    at = lambda p: F.min(F.when(F.col("last") >= F.floor((F.col("all") - 1) * F.lit(p)), F.col("v")))
    return last.groupBy(group).agg(F.first("all").alias("n"), F.round(F.first("mean"), 6).alias("mean_ms"), at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), F.round(1000 / F.first("mean"), 6).alias("qps"))


def below_runs(runs: DataFrame, threshold: float) -> DataFrame:
    """Runs with the number of consecutive ones below the threshold up to them."""
    w = Window.partitionBy("topic").orderBy("run_id")
    island = F.sum((F.col("metric") >= threshold).cast("int")).over(w)
    return runs.withColumn("island", island).withColumn("below_runs", F.sum((F.col("metric") < threshold).cast("long")).over(Window.partitionBy("topic", "island").orderBy("run_id"))).drop("island")
