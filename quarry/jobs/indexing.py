"""Queries on the index of snippets as it grows, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.jobs.catalogue import BM25, MANY, SNIPPETS, SQL, query
from quarry.operators import expansion, index
from quarry.functions import scores
from quarry.sources import views


def _grown(spark, sf_dir):
    """Seven tenths of the snippets indexed, a tenth and two tenths appended: three segments, and what was done."""
    s = views.snippets(spark, sf_dir)

    def make():
        place, done = views.place(spark, "grown"), []
        for most in (6, 7, 9, 9):
            own, told = index.refresh(s.where(f"doc_id % 10 <= {most}"), place)
            done.append(told)
        return own, done

    return views.kept(spark, sf_dir, "documents", "grown", make)


@query(SQL["index_build"])
def index_append(spark, sf_dir):
    """The terms of the index that grew by segments: those of a full build."""
    own, _ = _grown(spark, sf_dir)
    counts = own.table(spark, "postings").groupBy("term").agg(F.sum("tf").alias("tf"))
    n = F.broadcast(own.table(spark, "stats").select("n"))
    return own.table(spark, "terms").join(counts, "term").crossJoin(n).select("term", "df", "tf", F.round(scores.idf(F.col("n"), F.col("df")), 9).alias("idf"))


@query(f"WITH {SNIPPETS}, {MANY}, {BM25}, r AS (SELECT qid, snippet_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, snippet_id) AS rank FROM b) SELECT qid, snippet_id, round(round(score, 9), 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def index_append_topk(spark, sf_dir):
    """A search over three segments."""
    own, _ = _grown(spark, sf_dir)
    found = index.best(spark, own, expansion.plan(views.questions(spark, sf_dir), {}), 5)
    return found.select("qid", "snippet_id", F.round("score", 6).alias("score"), "rank")


@query("""WITH n AS (SELECT count(*) FILTER (doc_id % 10 <= 6) AS a, count(*) FILTER (doc_id % 10 = 7) AS b, count(*) FILTER (doc_id % 10 >= 8) AS c FROM documents)
  SELECT 1 AS step, 'full' AS action, a AS added, 0::BIGINT AS removed, 0::BIGINT AS changed, 1 AS segments FROM n UNION ALL SELECT 2, 'append', b, 0, 0, 2 FROM n UNION ALL SELECT 3, 'append', c, 0, 0, 3 FROM n UNION ALL SELECT 4, 'noop', 0, 0, 0, 3 FROM n""")
def index_refresh(spark, sf_dir):
    """What each refresh did."""
    _, done = _grown(spark, sf_dir)
    rows = [(i, d["action"], d["added"], d["removed"], d["changed"], d["segments"]) for i, d in enumerate(done, 1)]
    return spark.createDataFrame(rows, "step int, action string, added long, removed long, changed long, segments int")


@query(SQL["index_build"])
def index_compact(spark, sf_dir):
    """The terms of the three segments merged into one."""
    grown, _ = _grown(spark, sf_dir)
    own = views.kept(spark, sf_dir, "documents", "compact", lambda: index.compact(spark, grown))
    counts = own.table(spark, "postings").groupBy("term").agg(F.sum("tf").alias("tf"))
    n = F.broadcast(own.table(spark, "stats").select("n"))
    return own.table(spark, "terms").join(counts, "term").crossJoin(n).select("term", "df", "tf", F.round(scores.idf(F.col("n"), F.col("df")), 9).alias("idf"))
