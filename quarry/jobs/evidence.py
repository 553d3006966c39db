"""Queries on live and static evidence, trust, gates, regressions and the event stream, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.jobs.catalogue import BM25, FEEDBACK_SQL, ONE, SNIPPETS, one, query
from quarry.operators import evidence, retrieval, stores
from quarry.sources import views
from quarry.streaming.tail import tail


@query(f"""WITH {SNIPPETS}, {ONE}, {BM25}, tr AS (WITH {FEEDBACK_SQL} SELECT source_name, 0.5::DOUBLE + 0.75::DOUBLE * score AS multiplier FROM z),
  t AS (SELECT snippet_id, round(b.score * coalesce(multiplier, 1.0::DOUBLE), 9) AS score FROM b JOIN s USING (snippet_id) LEFT JOIN tr ON lower(trim(paper_id)) = lower(trim(source_name)))
  SELECT snippet_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY t.score DESC, snippet_id) AS INT) AS rank FROM t QUALIFY rank <= 20""")
def trust_weighted_retrieval(spark, sf_dir):
    s = views.snippets(spark, sf_dir)
    trust = stores.trust(stores.reliability(views.feedback(spark, sf_dir)))
    weighted = evidence.trust_weighted(one(spark, sf_dir), s.select("snippet_id", F.col("paper_id").alias("venue")), trust)
    best = weighted.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "snippet_id").limit(20)
    return retrieval.top_k(best, "qid", "snippet_id", 20).select("snippet_id", F.round("score", 6).alias("score"), "rank")


LIVE = """n AS (SELECT page_id, length(html) AS n FROM pages), x AS (SELECT min(n) AS low, max(n) AS high FROM n),
  lv AS (SELECT 'Pdoc_' || page_id || ':S1' AS snippet_id, CASE WHEN low = high THEN 1.0 ELSE (n - low) / (high - low) END::DOUBLE AS score FROM n, x)"""


def _live(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages").select(F.format_string("Pdoc_%d:S1", "page_id").alias("snippet_id"), F.length("html").alias("n"))
    return evidence.scaled(pages, "n").select("snippet_id", "score")


def _static(spark, sf_dir):
    return views.snippets(spark, sf_dir).select("snippet_id", F.col("quality").alias("score"))


@query(f"""WITH {SNIPPETS}, {LIVE} SELECT snippet_id, round(CASE WHEN lv.score IS NULL THEN s.quality ELSE least(1.0::DOUBLE, 1.05::DOUBLE * lv.score) END, 6) AS score, lv.score IS NOT NULL AS live FROM lv FULL JOIN s USING (snippet_id)""")
def live_static_merge(spark, sf_dir):
    return evidence.live_over_static(_live(spark, sf_dir), _static(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"""WITH {SNIPPETS}, {LIVE}, u AS (SELECT snippet_id, true AS live, score FROM lv UNION ALL SELECT snippet_id, false, quality FROM s ANTI JOIN lv USING (snippet_id))
  SELECT snippet_id, live, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY live DESC, u.score DESC, snippet_id) AS INT) AS rank FROM u QUALIFY rank <= 100""")
def live_first_merge(spark, sf_dir):
    return evidence.live_first(_live(spark, sf_dir), _static(spark, sf_dir), 100).withColumn("score", F.round("score", 6))


@query(f"""WITH c AS (SELECT claim_id, topic, claim_id % 30 AS run, (claim_id % 30) * 3600 + claim_id % 50 AS "at" FROM ({views.CLAIMS_SQL}))
  SELECT claim_id, topic, run, "at" FROM c WHERE "at" > (SELECT max("at") FROM c WHERE run = 20)""")
def kb_changes_since(spark, sf_dir):
    run = F.col("claim_id") % 30
    changes = views.claims(spark, sf_dir).select("claim_id", "topic", run.alias("run"), (run * 3600 + F.col("claim_id") % 50).alias("at"))
    return evidence.changes_since(changes, 20)


@query("""WITH k AS (SELECT source, 2.0::DOUBLE AS weight, length(text) >= 400 AS passed FROM documents JOIN labels USING (doc_id) UNION ALL SELECT source, 1.0, quality = 1 FROM documents JOIN labels USING (doc_id)
    UNION ALL SELECT source, 1.5, toxic = 0 FROM documents JOIN labels USING (doc_id))
  SELECT source, count(*) AS checks, count(*) FILTER (passed) AS passed, round(sum(CASE WHEN passed THEN weight ELSE 0 END) / sum(weight), 4)::DOUBLE AS score FROM k GROUP BY source""")
def gold_eval(spark, sf_dir):
    both = views.table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n")).join(views.table(spark, sf_dir, "labels"), "doc_id")
    check = lambda weight, passed: F.struct(F.lit(weight).alias("weight"), passed.alias("passed"))
    checks = F.explode(F.array(check(2.0, F.col("n") >= 400), check(1.0, F.col("quality") == 1), check(1.5, F.col("toxic") == 0)))
    return evidence.gold_scores(both.select("source", checks.alias("c")).select("source", "c.*"), "source")


@query(f"""WITH r AS ({views.RUNS_SQL}), p AS (SELECT topic, run_id, metric, lag(metric) OVER (PARTITION BY topic ORDER BY run_id) AS before FROM r)
  SELECT topic, run_id, round((metric - before) * 100 / nullif(before, 0), 4) AS change, coalesce((metric - before) * 100 / nullif(before, 0) > 10, false) AS regressed FROM p""")
def regression_check(spark, sf_dir):
    return evidence.regressions(views.runs(spark, sf_dir).select("topic", "run_id", "metric"), 10.0).select("topic", "run_id", F.round("change", 4).alias("change"), "regressed")


@query("""SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS largest FROM events WHERE ts > (SELECT max(ts) - INTERVAL 7 DAY FROM events) GROUP BY event_type""")
def event_tail(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    last = events.agg(F.max("ts")).first()[0]
    new = F.col("ts") > F.lit(last) - F.expr("INTERVAL 7 DAY")
    return tail(spark, f"{sf_dir}/events.parquet*", events.schema, new).groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("largest"))
