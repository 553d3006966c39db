"""Monitoring: rules on runs, history of decisions, digests, alert events, run summaries, watchdog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULE = "trigger_id string, type string, severity string, min_new int, min_added int, min_updated int, min_disputed int, metric string, op string, value string, target string, keywords array<string>"


def number(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(default))


def compared(left: Column, op: Column, right: Column) -> Column:
    """left op right for lt, lte, gt, gte, eq and neq; false for any other."""
    is_ = lambda name: op == name
    return F.coalesce(F.when(is_("lt"), left < right).when(is_("lte"), left <= right).when(is_("gt"), left > right).when(is_("gte"), left >= right).when(is_("eq"), left == right).when(is_("neq"), left != right), F.lit(False))


def decisions(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """topic, run_id, trigger_id, severity, fired, error of each run and rule.

    runs: topic, run_id, new_sources, added, updated, disputed, metrics map<string,double>, texts map<string,string>. rules:
    as RULE; there are few, they are configuration. A count whose least is 0 or null doesn't fire. A rule of unknown type
    gives an error and no decision (fired is null).
    """
    both = runs.crossJoin(F.broadcast(rules))
    least = lambda c, m: (F.coalesce(F.col(m), F.lit(0)) > 0) & (F.coalesce(F.col(c), F.lit(0)) >= F.col(m))
    told = F.lower(F.coalesce(F.element_at("texts", F.coalesce("target", F.lit("synthesis"))), F.lit("")))
    hit = F.exists(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: (F.trim(k) != "") & F.contains(told, F.lower(F.trim(k))))
    fired = (
        F.when(F.col("type") == "new_documents", F.coalesce("new_sources", F.lit(0)) >= F.coalesce("min_new", F.lit(1)))
        .when(F.col("type") == "kb_diff_count", least("added", "min_added") | least("updated", "min_updated") | least("disputed", "min_disputed"))
        .when(F.col("type") == "metric_threshold", compared(F.coalesce(F.element_at("metrics", F.col("metric")), F.lit(0.0)), F.coalesce("op", F.lit("lt")), number(F.col("value"))))
        .when(F.col("type") == "keyword_presence", F.coalesce(hit, F.lit(False)))
    )
    error = F.when(fired.isNull(), F.concat(F.lit("unknown type "), F.coalesce("type", F.lit(""))))
    return both.select("topic", "run_id", "trigger_id", F.lower(F.coalesce("severity", F.lit("low"))).alias("severity"), fired.alias("fired"), error.alias("error"))


def history(made: DataFrame) -> DataFrame:
    """One row for each trigger of decisions(topic, trigger_id, severity, run_id, at, fired, emitted, suppressed_by, cooldown)."""
    by = lambda s: F.count_if(F.coalesce("suppressed_by", F.lit("none")) == s)
    emitted = made.where("emitted")
    w = Window.partitionBy("topic", "trigger_id").orderBy("at", "run_id")
    minutes = F.floor((F.unix_timestamp("at") - F.unix_timestamp(F.lag("at").over(w))) / 60)
    gaps = emitted.select("topic", "trigger_id", minutes.alias("minutes"), F.lag("cooldown").over(w).alias("needed"))
    apart = gaps.groupBy("topic", "trigger_id").agg(F.min("minutes").alias("min_interval"), F.count_if((F.col("needed") > 0) & (F.col("minutes") < F.col("needed"))).alias("violations"))
    counts = made.groupBy("topic", "trigger_id").agg(
        F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"), F.count("*").alias("decisions"), F.count_if("fired").alias("fired"), F.count_if("emitted").alias("emitted"),
        F.count_if(F.col("emitted") & (F.col("severity") == "high")).alias("emitted_high"), by("not_fired").alias("not_fired"), by("hysteresis").alias("hysteresis"), by("cooldown").alias("cooled"), by("none").alias("passed"),
    )
    return counts.join(apart, ["topic", "trigger_id"], "left").withColumn("violations", F.coalesce("violations", F.lit(0)))


def routed(made: DataFrame) -> DataFrame:
    """Emitted decisions with where they go: high ones as a critical event, medium ones to the digest with a warning, the others to the log."""
    return made.where("emitted").withColumn("route", F.when(F.col("severity") == "high", "critical").when(F.col("severity") == "medium", "digest").otherwise("log"))


def digest(queue: DataFrame, most: int = 50) -> DataFrame:
    """topic, items, runs, first items: one row for each topic of a queue(topic, run_id, trigger_id). At most `most` items are listed, in order; all are counted."""
    turn = F.row_number().over(Window.partitionBy("topic").orderBy("run_id", "trigger_id"))
    counts = queue.groupBy("topic").agg(F.count("*").alias("items"), F.countDistinct("run_id").alias("runs"))
    listed = queue.withColumn("turn", turn).where(F.col("turn") <= most).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "run_id", "trigger_id").alias("item")))).alias("ls"))
    return counts.join(listed, "topic").select("topic", "items", "runs", F.array_join(F.transform("ls", lambda x: x["item"]), ",").alias("listed"))


def alert_events(runs: DataFrame, limits: dict[str, float]) -> DataFrame:
    """run_id, event, severity, observed: what is over its limit in a run, one row for each.

    runs hold numbers named as the limits; a limit of the name least_x bounds x from below. Names that end in _errors are
    critical, others warnings. A null number gives no event.
    """
    rows = []
    for name, limit in limits.items():
        column = name.removeprefix("least_")
        out = F.col(column) < limit if name.startswith("least_") else F.col(column) > limit
        rows.append(F.when(out, F.struct(F.lit(f"{column}_{'below' if name.startswith('least_') else 'over'}_limit").alias("event"), F.lit("critical" if column.endswith("_errors") else "warning").alias("severity"), F.col(column).cast("double").alias("observed"))))
    return runs.select("run_id", F.explode(F.array_compact(F.array(*rows))).alias("e")).select("run_id", "e.*")


def summary(made: DataFrame) -> DataFrame:
    """run_id and sums over its topics: topics, fired, emitted, by severity, and rates."""
    n = lambda s: F.count_if(F.col("emitted") & (F.col("severity") == s)).alias(s)
    found = made.groupBy("run_id").agg(F.countDistinct("topic").alias("topics"), F.count("*").alias("decisions"), F.count_if("fired").alias("fired"), F.count_if("emitted").alias("emitted"), n("high"), n("medium"), n("low"))
    return found.withColumn("fired_rate", F.round(F.col("fired") / F.col("decisions"), 6)).withColumn("emitted_rate", F.round(F.coalesce(F.try_divide(F.col("emitted"), F.col("fired")), F.lit(0.0)), 6))


def watchdog(runs: DataFrame) -> DataFrame:
    """source, found, silent_runs, errors of runs(run_id, source, found, errors): the errors of a run are spread over its sources that found nothing, at least one each."""
    silent = F.col("found") == 0
    per_run = runs.groupBy("run_id").agg(F.max("errors").alias("run_errors"), F.count_if(silent).alias("zeros"))
    share = F.when(silent & (F.col("run_errors") > 0), F.greatest(F.lit(1.0), F.col("run_errors") / F.col("zeros"))).otherwise(0.0)
    return runs.join(per_run, "run_id").groupBy("source").agg(F.sum("found").cast("long").alias("found"), F.count_if(silent).alias("silent_runs"), F.round(F.sum(share), 6).alias("errors"))


def disabled(scored: DataFrame, threshold: float, runs: int) -> DataFrame:
    """topic of scored(topic, run_id, below_runs) whose last run is the runs-th or later below the threshold in a row."""
    last = scored.groupBy("topic").agg(F.max_by("below_runs", "run_id").alias("below_runs"))
    return last.withColumn("disabled", F.col("below_runs") >= runs)


def soak(spark, steps: int, minutes: int, pattern: str, every: int = 10, length: int = 3) -> DataFrame:
    """step, at (minutes since the start), value of a synthetic timeline: constant (always 1), pulse (1 at every every-th step) or burst (length steps in every every)."""
    at = F.col("id")
    value = {"constant": F.lit(1), "pulse": F.when(at % every == 0, 1).otherwise(0), "burst": F.when(at % every < length, 1).otherwise(0)}[pattern]
    return spark.range(steps).select(at.alias("step"), (at * minutes).alias("minute"), value.alias("value"))


def every_nth(runs: DataFrame, n: int) -> DataFrame:
    """The first run of a topic and each n-th after it."""
    return runs.withColumn("ordinal", F.row_number().over(Window.partitionBy("topic").orderBy("run_id")) - 1).where(F.col("ordinal") % max(1, n) == 0)


def last_runs(runs: DataFrame, n: int) -> DataFrame:
    """The n last runs of a topic."""
    return runs.withColumn("turn", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("run_id")))).where(F.col("turn") <= n).drop("turn")
