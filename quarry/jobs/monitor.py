"""Queries on monitoring, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.jobs.catalogue import query
from quarry.operators import alerts, monitoring
from quarry.sources import views

#: Rules: id, type, severity, least counts, metric, op, value, target, keywords.
RULES = [
    ("new", "new_documents", "High", 14, None, None, None, None, None, None, None, None),
    ("kb", "kb_diff_count", "medium", None, 0, 0, 98, None, None, None, None, None),
    ("cold", "metric_threshold", None, None, None, None, None, "mean", "lt", "42.5", None, None),
    ("odd", "metric_threshold", "low", None, None, None, None, "missing", "neq", "abc", None, None),
    ("word", "keyword_presence", "medium", None, None, None, None, None, None, None, "gaps", ["K: 97", " "]),
    ("none", "volume", "low", None, None, None, None, None, None, None, None, None),
]
RUNS = """rn AS (SELECT event_type AS topic, strftime(date_trunc('hour', ts), '%Y%m%dT%H%M%SZ') AS run_id, date_trunc('hour', ts) AS t, count(*) AS n, avg(value) AS metric, max(CAST(props->>'$.k' AS BIGINT)) AS k, string_agg('k: ' || (props->>'$.k'), ' ' ORDER BY event_id) AS told FROM events GROUP BY 1, 2, 3),
  dc AS (SELECT topic, run_id, t, 'new' AS trigger_id, 'high' AS severity, n >= 14 AS fired FROM rn UNION ALL SELECT topic, run_id, t, 'kb', 'medium', k >= 98 FROM rn UNION ALL SELECT topic, run_id, t, 'cold', 'low', metric < 42.5 FROM rn
    UNION ALL SELECT topic, run_id, t, 'odd', 'low', false FROM rn UNION ALL SELECT topic, run_id, t, 'word', 'medium', contains(told, 'k: 97') FROM rn)"""


def _runs(spark, sf_dir):
    hour, k = F.date_trunc("hour", F.col("ts").cast("timestamp")), F.get_json_object("props", "$.k").cast("long")
    found = views.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("topic"), hour.alias("at")).agg(
        F.count("*").alias("new_sources"), F.avg("value").alias("mean"), F.max(k).alias("disputed"), F.array_sort(F.collect_list(F.struct("event_id", F.concat(F.lit("k: "), k.cast("string")).alias("t")))).alias("told")
    )
    return found.select("topic", F.date_format("at", "yyyyMMdd'T'HHmmss'Z'").alias("run_id"), "at", "new_sources", F.lit(5).alias("added"), F.lit(5).alias("updated"), "disputed", F.create_map(F.lit("mean"), "mean").alias("metrics"), F.create_map(F.lit("gaps"), F.array_join(F.transform("told", lambda x: x.t), " ")).alias("texts"))


def _decisions(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return alerts.decisions(runs, spark.createDataFrame(RULES, alerts.RULE)).join(runs.select("topic", "run_id", "at"), ["topic", "run_id"])


@query(f"WITH {RUNS} SELECT topic, run_id, trigger_id, severity, fired, NULL::VARCHAR AS error FROM dc UNION ALL SELECT topic, run_id, 'none', 'low', NULL, 'unknown type volume' FROM rn")
def monitor_rules(spark, sf_dir):
    return _decisions(spark, sf_dir).drop("at")


#: The state goes along with the decisions of a trigger in order of time: hits so far, time of the last emission.
NOISE = """nm AS (SELECT *, topic || '/' || trigger_id AS key, row_number() OVER (PARTITION BY topic, trigger_id ORDER BY t) AS i FROM dc),
  st AS (SELECT key, i, fired, t, CASE WHEN NOT fired THEN 'not_fired' ELSE 'hysteresis' END AS why, CAST(fired AS INT) AS hits, NULL::TIMESTAMP AS last FROM nm WHERE i = 1
    UNION ALL SELECT nm.key, nm.i, nm.fired, nm.t, CASE WHEN NOT nm.fired THEN 'not_fired' WHEN hits + 1 < 2 THEN 'hysteresis' WHEN last IS NOT NULL AND nm.t - last < INTERVAL 360 MINUTE THEN 'cooldown' END,
      CASE WHEN NOT nm.fired THEN 0 WHEN hits + 1 < 2 OR (last IS NOT NULL AND nm.t - last < INTERVAL 360 MINUTE) THEN hits + 1 ELSE 0 END,
      CASE WHEN nm.fired AND hits + 1 >= 2 AND (last IS NULL OR nm.t - last >= INTERVAL 360 MINUTE) THEN nm.t ELSE last END FROM st JOIN nm ON nm.key = st.key AND nm.i = st.i + 1),
  md AS (SELECT nm.*, why, why IS NULL AS emitted FROM nm JOIN st USING (key, i))"""


def _made(spark, sf_dir):
    """Decisions after noise control (2 hits, 360 minutes), by topic and trigger."""
    rows = _decisions(spark, sf_dir).where("fired IS NOT NULL")
    key = F.concat_ws("/", "topic", "trigger_id")
    done = monitoring.noise_control(rows.select(key.alias("topic"), "at", "fired"), 2, 360).select(F.col("topic").alias("key"), "at", "emitted", "suppressed_by")
    return rows.withColumn("key", key).join(done, ["key", "at"]).select("topic", "trigger_id", "severity", "run_id", "at", "fired", "emitted", "suppressed_by", (60 + 30 * (F.col("at").cast("long") % 5)).alias("cooldown"))


@query(f"WITH RECURSIVE r AS ({views.RUNS_SQL}), dc AS (SELECT topic, '' AS trigger_id, r.\"at\" AS t, metric > 45 AS fired FROM r), {NOISE} SELECT topic, strftime(t, '%Y-%m-%d %H') AS at_hour, fired, emitted, why AS suppressed_by FROM md")
def noise_control(spark, sf_dir):
    made = monitoring.noise_control(views.runs(spark, sf_dir).select("topic", "at", (F.col("metric") > 45).alias("fired")), 2, 360)
    return made.select("topic", F.date_format("at", "yyyy-MM-dd HH").alias("at_hour"), "fired", "emitted", "suppressed_by")


@query(f"""WITH RECURSIVE {RUNS}, {NOISE}, cd AS (SELECT *, 60 + 30 * (CAST(epoch(t) AS BIGINT) % 5) AS cooldown FROM md),
  g AS (SELECT topic, trigger_id, CAST(floor((epoch(t) - epoch(lag(t) OVER w)) / 60) AS BIGINT) AS minutes, lag(cooldown) OVER w AS needed FROM cd WHERE emitted WINDOW w AS (PARTITION BY topic, trigger_id ORDER BY t)),
  a AS (SELECT topic, trigger_id, min(minutes) AS min_interval, count(*) FILTER (needed > 0 AND minutes < needed) AS violations FROM g GROUP BY ALL),
  c AS (SELECT topic, trigger_id, min(run_id) AS first_run, max(run_id) AS last_run, count(*) AS decisions, count(*) FILTER (fired) AS fired, count(*) FILTER (emitted) AS emitted, count(*) FILTER (emitted AND severity = 'high') AS emitted_high,
    count(*) FILTER (why = 'not_fired') AS not_fired, count(*) FILTER (why = 'hysteresis') AS hysteresis, count(*) FILTER (why = 'cooldown') AS cooled, count(*) FILTER (why IS NULL) AS passed FROM md GROUP BY ALL)
  SELECT c.*, min_interval, coalesce(violations, 0) AS violations FROM c LEFT JOIN a USING (topic, trigger_id)""")
def history_check(spark, sf_dir):
    return alerts.history(_made(spark, sf_dir))


@query(f"""WITH RECURSIVE {RUNS}, {NOISE}, q AS (SELECT topic, run_id, trigger_id FROM md WHERE emitted AND severity = 'medium'), l AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY run_id, trigger_id) AS turn FROM q)
  SELECT topic, count(*) AS items, count(DISTINCT run_id) AS runs, string_agg(run_id || ':' || trigger_id, ',' ORDER BY turn) FILTER (turn <= 50) AS listed FROM l GROUP BY topic""")
def digest_group(spark, sf_dir):
    return alerts.digest(alerts.routed(_made(spark, sf_dir)).where("route = 'digest'"))


@query("""WITH r AS (SELECT strftime(date_trunc('hour', ts), '%Y%m%dT%H') AS run_id, count(*) FILTER (event_type = 'error') AS fetch_errors, count(*) AS items, avg(value) AS mean_value FROM events GROUP BY 1)
  SELECT run_id, 'fetch_errors_over_limit' AS event, 'critical' AS severity, fetch_errors::DOUBLE AS observed FROM r WHERE fetch_errors > 4 UNION ALL SELECT run_id, 'items_below_limit', 'warning', items::DOUBLE FROM r WHERE items < 10
  UNION ALL SELECT run_id, 'mean_value_over_limit', 'warning', round(mean_value, 6) FROM r WHERE round(mean_value, 6) > 60""")
def alert_events(spark, sf_dir):
    hour = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd'T'HH")
    runs = views.table(spark, sf_dir, "events").groupBy(hour.alias("run_id")).agg(F.count_if(F.col("event_type") == "error").alias("fetch_errors"), F.count("*").alias("items"), F.round(F.avg("value"), 6).alias("mean_value"))
    return alerts.alert_events(runs, {"fetch_errors": 4, "least_items": 10, "mean_value": 60.0})


@query(f"""WITH RECURSIVE {RUNS}, {NOISE} SELECT run_id, count(DISTINCT topic) AS topics, count(*) AS decisions, count(*) FILTER (fired) AS fired, count(*) FILTER (emitted) AS emitted, count(*) FILTER (emitted AND severity = 'high') AS high, count(*) FILTER (emitted AND severity = 'medium') AS medium,
  count(*) FILTER (emitted AND severity = 'low') AS low, round(count(*) FILTER (fired) / count(*), 6) AS fired_rate, coalesce(round(count(*) FILTER (emitted) / nullif(count(*) FILTER (fired), 0), 6), 0) AS emitted_rate FROM md GROUP BY run_id""")
def run_summary(spark, sf_dir):
    return alerts.summary(_made(spark, sf_dir))


@query("""WITH c AS (SELECT strftime(date_trunc('day', ts), '%Y%m%d') AS run_id, user_id % 20 AS source, count(*) FILTER (event_type = 'purchase') AS found, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1, 2),
  r AS (SELECT run_id, max(e) AS errors, count(*) FILTER (found = 0) AS zeros FROM c GROUP BY run_id)
  SELECT source, CAST(sum(found) AS BIGINT) AS found, count(*) FILTER (found = 0) AS silent_runs, round(sum(CASE WHEN found = 0 AND errors > 0 THEN greatest(1.0::DOUBLE, errors / zeros) ELSE 0 END), 6)::DOUBLE AS errors FROM c JOIN r USING (run_id) GROUP BY source""")
def reliability_watchdog(spark, sf_dir):
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd")
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return alerts.watchdog(views.table(spark, sf_dir, "events").groupBy(day.alias("run_id"), (F.col("user_id") % 20).alias("source")).agg(kind("purchase").alias("found"), kind("error").alias("errors")))


@query(f"""WITH r AS ({views.RUNS_SQL}), i AS (SELECT *, sum(CAST(metric >= 52 AS INT)) OVER (PARTITION BY topic ORDER BY run_id) AS island FROM r), b AS (SELECT topic, run_id, CAST(sum(CAST(metric < 52 AS INT)) OVER (PARTITION BY topic, island ORDER BY run_id) AS BIGINT) AS below_runs FROM i)
  SELECT topic, arg_max(below_runs, run_id) AS below_runs, arg_max(below_runs, run_id) >= 2 AS disabled FROM b GROUP BY topic""")
def auto_disable(spark, sf_dir):
    return alerts.disabled(monitoring.below_runs(views.runs(spark, sf_dir), 52), 52, 2)


@query(f"""WITH r AS ({views.RUNS_SQL}), n AS (SELECT topic, run_id, row_number() OVER (PARTITION BY topic ORDER BY run_id) - 1 AS ordinal, row_number() OVER (PARTITION BY topic ORDER BY run_id DESC) AS turn FROM r)
  SELECT topic, run_id, CAST(ordinal AS INT) AS ordinal FROM n WHERE turn <= 104 AND (ordinal - (SELECT count(*) FROM r q WHERE q.topic = n.topic) + least(104, (SELECT count(*) FROM r q WHERE q.topic = n.topic))) % 7 = 0""")
def run_schedule(spark, sf_dir):
    """Of the last 104 runs of a topic the first and each seventh; ordinal counts from its first run of all."""
    runs = views.runs(spark, sf_dir).select("topic", "run_id")
    told = alerts.every_nth(runs, 1).withColumnRenamed("ordinal", "place")
    return alerts.every_nth(alerts.last_runs(told, 104), 7).select("topic", "run_id", F.col("place").alias("ordinal"))
