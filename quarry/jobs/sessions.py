"""Queries on sessions, feedback and hooks, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.jobs.catalogue import query
from quarry.operators import hooks, sessions
from quarry.sources import views

#: The turns of conversations as commands of sessions: created, recorded, closed, reopened, deleted, some where they aren't allowed.
KIND = "CASE WHEN conv_id % 10 <> 4 AND turn = 0 THEN 'create' WHEN conv_id % 9 = 3 AND turn = 3 THEN 'delete' WHEN conv_id % 9 = 3 AND turn = 4 THEN 'create' WHEN (conv_id + turn) % 6 = 0 THEN 'close' WHEN (conv_id + turn) % 6 = 2 THEN 'reopen' WHEN (conv_id + turn) % 17 = 5 THEN 'create' ELSE 'record' END"
WORDS = r"list_transform(regexp_extract_all({}, '[a-zA-Z0-9]+'), lambda x: lower(x))"
LOG = f"""cm AS (SELECT 's' || conv_id AS name, turn AS "at", {KIND} AS kind, text, turn, conv_id FROM conversations),
  fs AS (SELECT name, "at", kind, text, turn, conv_id, row_number() OVER (PARTITION BY name ORDER BY "at") AS n FROM cm),
  st AS (SELECT fs.*, FALSE AS there, FALSE AS op, CASE WHEN kind <> 'create' THEN 'not found' END AS error, kind = 'create' AS there2, kind = 'create' AS op2, CASE WHEN kind = 'create' THEN 1 ELSE 0 END AS life FROM fs WHERE n = 1
    UNION ALL SELECT f.*, s.there2, s.op2, CASE WHEN f.kind = 'create' THEN CASE WHEN s.there2 THEN 'already exists' END WHEN NOT s.there2 THEN 'not found' WHEN f.kind = 'close' AND NOT s.op2 THEN 'already closed' WHEN f.kind = 'reopen' AND s.op2 THEN 'already open' WHEN f.kind = 'record' AND NOT s.op2 THEN 'closed; reopen it first' END,
      CASE f.kind WHEN 'create' THEN TRUE WHEN 'delete' THEN FALSE ELSE s.there2 END, CASE WHEN f.kind = 'create' AND NOT s.there2 THEN TRUE WHEN f.kind = 'delete' THEN FALSE WHEN f.kind = 'close' THEN FALSE WHEN f.kind = 'reopen' AND s.there2 THEN TRUE ELSE s.op2 END,
      s.life + CASE WHEN f.kind = 'create' AND NOT s.there2 THEN 1 ELSE 0 END FROM st s JOIN fs f ON f.name = s.name AND f.n = s.n + 1),
  en AS (SELECT name, arg_max(there2, n) AS there, arg_max(op2, n) AS op, max(life) AS life FROM st GROUP BY name),
  rc AS (SELECT st.* FROM st JOIN en ON en.name = st.name AND en.life = st.life AND en.there WHERE st.kind = 'record' AND error IS NULL),
  rr AS (SELECT *, {WORDS.format("text")} AS ws, list_transform(range(0, turn % 3), lambda k: '(Pdoc_' || (conv_id + k) % 40 || ':S1)') AS cs FROM rc), rw AS (SELECT *, list_sort(list_distinct(list_filter(ws, lambda x: length(x) >= 7))) AS gaps, ws[1:2] AS claims FROM rr)"""


def _done(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    kind = F.expr(KIND)
    words = F.transform(F.regexp_extract_all("text", F.lit("[a-zA-Z0-9]+"), 0), F.lower)
    cite = F.transform(F.sequence(F.lit(0), (t % 3).cast("int")), lambda k: F.concat(F.lit("(Pdoc_"), ((c + k) % 40).cast("string"), F.lit(":S1)")))
    rows = views.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("s"), c.cast("string")).alias("name"), t.alias("at"), kind.alias("kind"), F.lit("about").alias("description"), F.col("text").alias("question"), F.lit("r.md").alias("report_path"), F.when(t % 4 != 0, (t * 10 + 0.5)).cast("double").alias("elapsed_ms"), F.slice(words, 1, 2).alias("key_claims"),
        F.array_sort(F.array_distinct(F.filter(words, lambda x: F.length(x) >= 7))).alias("gaps"), F.slice(cite, 1, (t % 3).cast("int")).alias("citations"), F.col("text").alias("synthesis"), (c % 5).alias("evidence_count"), (t % 5 == 0).alias("aggregation"),
    )
    return sessions.judged(rows)


@query(f"""WITH RECURSIVE {LOG} SELECT name, "at", kind, error FROM st""")
def session_commands(spark, sf_dir):
    return _done(spark, sf_dir).select("name", "at", "kind", "error")


@query(f"""WITH RECURSIVE {LOG}, k AS (SELECT st.name, min("at") FILTER (kind = 'create') AS created_at, max("at") FILTER (kind = 'close') AS closed FROM st JOIN en ON en.name = st.name AND en.life = st.life WHERE error IS NULL GROUP BY st.name)
  SELECT en.name, CASE WHEN op THEN 'open' ELSE 'closed' END AS status, created_at, CASE WHEN NOT op THEN closed END AS closed_at, (SELECT count(*) FROM rc WHERE rc.name = en.name) AS query_count FROM en JOIN k ON k.name = en.name WHERE there""")
def session_list(spark, sf_dir):
    return sessions.listed(_done(spark, sf_dir)).select("name", "status", "created_at", "closed_at", "query_count")


@query(f"""WITH RECURSIVE {LOG}, g AS (SELECT name, gap FROM (SELECT name, n, unnest(gaps) AS gap FROM rw) GROUP BY ALL HAVING count(*) >= 2), gg AS (SELECT name, array_to_string(list_sort(list(gap)), '|') AS recurring FROM g GROUP BY name),
  x AS (SELECT name, count(*) AS query_count, CAST(sum(conv_id % 5) AS BIGINT) AS total_evidence, round(avg(CASE WHEN turn % 4 <> 0 THEN turn * 10 + 0.5::DOUBLE END), 3) AS avg_elapsed_ms, count(*) FILTER (turn % 5 = 0) AS aggregation_used, CAST(sum(len(cs)) AS BIGINT) AS total_citations, flatten(list(cs ORDER BY n)) AS fc, flatten(list(gaps ORDER BY n)) AS fg, flatten(list(claims ORDER BY n)) AS fk FROM rw GROUP BY name)
  SELECT en.name, CASE WHEN op THEN 'open' ELSE 'closed' END AS status, coalesce(query_count, 0) AS query_count, coalesce(total_evidence, 0) AS total_evidence, coalesce(total_citations, 0) AS total_citations, coalesce(aggregation_used, 0) AS aggregation_used, avg_elapsed_ms, coalesce(array_to_string(list_sort(list_distinct(list_transform(fc, lambda c: regexp_extract(c, '^\\(P(.*):S1', 1)))), '|'), '') AS papers, coalesce(array_to_string(list_sort(list_distinct(fc)), '|'), '') AS citations,
    coalesce(array_to_string(fg, '|'), '') AS gaps, coalesce(recurring, '') AS recurring_gaps, coalesce(array_to_string(fk, '|'), '') AS key_claims FROM en LEFT JOIN x ON x.name = en.name LEFT JOIN gg ON gg.name = en.name WHERE there""")
def session_report(spark, sf_dir):
    told = sessions.summary(_done(spark, sf_dir))
    flat = lambda c, name: F.array_join(c, "|").alias(name)
    return told.select("name", "status", "query_count", "total_evidence", "total_citations", "aggregation_used", "avg_elapsed_ms", flat("papers", "papers"), flat("unique_citations", "citations"), flat("gaps", "gaps"), flat("recurring_gaps", "recurring_gaps"), flat("key_claims", "key_claims"))


SAID = "CASE event_type WHEN 'view' THEN 'fetch_success' WHEN 'click' THEN 'evidence_used' WHEN 'purchase' THEN 'claim_confirmed' WHEN 'signup' THEN 'liked' ELSE event_type END"


@query(f"""WITH e AS (SELECT CASE WHEN user_id % 25 = 0 THEN ' ' ELSE 'src' || user_id % 20 END AS source, {SAID} AS kind FROM events)
  SELECT source AS source_name, count(*) FILTER (source <> ' ' AND kind IN ('fetch_success', 'evidence_used', 'claim_confirmed')) AS accepted, count(*) FILTER (source = ' ') AS nameless, count(*) FILTER (source <> ' ' AND kind NOT IN ('fetch_success', 'evidence_used', 'claim_confirmed')) AS unknown FROM e GROUP BY source""")
def feedback_insert(spark, sf_dir):
    name = F.when(F.col("user_id") % 25 == 0, " ").otherwise(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")))
    told = sessions.feedback(views.table(spark, sf_dir, "events").select(name.alias("source_name"), F.expr(SAID).alias("event_type"), "value"))
    n = lambda c, name: F.count_if(c).alias(name)
    return told.groupBy("source_name").agg(n(F.col("accepted"), "accepted"), n(F.col("reason") == "source missing", "nameless"), n(F.col("reason") == "unknown event_type", "unknown"))


def _high(run: dict) -> list[dict]:
    return [{"trigger_id": "high_metric", "severity": "High" if run["n"] > 4 else "medium", "fired": run["metric"] > 50, "reason": f"n={run['n']}", "threshold": {"metric": 50}}]


def _odd(run: dict) -> list:
    return [{"severity": "urgent"}, "text"] if run["n"] % 2 else [{}]


def _broken(run: dict) -> list[dict]:
    raise ValueError("no data")


@query(f"""WITH r AS ({views.RUNS_SQL}), d AS (SELECT topic, run_id, unnest([{{'hook': 'high', 'trigger_id': 'high_metric', 'severity': CASE WHEN n > 4 THEN 'high' ELSE 'medium' END, 'fired': metric > 50, 'reason': 'n=' || n, 'threshold': '{{"metric": 50}}', 'error': NULL}},
    {{'hook': 'odd', 'trigger_id': CASE WHEN n % 2 = 0 THEN 'custom_hook_trigger' END, 'severity': CASE WHEN n % 2 = 0 THEN 'low' END, 'fired': CASE WHEN n % 2 = 0 THEN FALSE END, 'reason': CASE WHEN n % 2 = 0 THEN '' END, 'threshold': CASE WHEN n % 2 = 0 THEN '{{}}' END, 'error': CASE WHEN n % 2 = 1 THEN 'invalid severity ''urgent''' END}},
    CASE WHEN n % 2 = 1 THEN {{'hook': 'odd', 'trigger_id': NULL, 'severity': NULL, 'fired': NULL, 'reason': NULL, 'threshold': NULL, 'error': 'decision must be a dict'}} END, {{'hook': 'broken', 'trigger_id': NULL, 'severity': NULL, 'fired': NULL, 'reason': NULL, 'threshold': NULL, 'error': 'failed: no data'}},
    {{'hook': 'unknown', 'trigger_id': NULL, 'severity': NULL, 'fired': NULL, 'reason': NULL, 'threshold': NULL, 'error': 'hook not allowed'}}]) AS d FROM r) SELECT topic, run_id, d.hook AS hook, d.trigger_id AS trigger_id, d.severity AS severity, d.fired AS fired, d.reason AS reason, d.threshold AS threshold, d.error AS error FROM d WHERE d IS NOT NULL""")
def hook_decisions(spark, sf_dir):
    runs = views.runs(spark, sf_dir).select("topic", "run_id", "metric", "n")
    return hooks.decisions(runs, {"high": _high, "odd": _odd, "broken": _broken}, ["high", "odd", "broken", "unknown"]).drop("observed")
