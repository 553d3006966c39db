"""Queries on the inverted-file vector index, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.jobs.catalogue import VEC, query
from quarry.operators import extraction, retrieval, vector_index
from quarry.sources import views

CELLS, PROBES, K, ROUNDS = 64, 16, 10, 2


def ivf_sql(rows: str = "TRUE", rounds: int = ROUNDS) -> str:
    """iv(vec_id, v, c): the cell of every vector, of cells fitted on those with rows; ce(c, v, n): the cells."""
    near = lambda c: f"round(list_dot_product({c}.v, {c}.v) - 2 * list_dot_product(k.v, {c}.v), 12)"
    first = lambda c: f"row_number() OVER (PARTITION BY vec_id ORDER BY {near(c)}, {c}.c) = 1"
    steps = [f"""k AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY NOT ({rows}), sha256(vec_id::VARCHAR), vec_id) AS r, count(*) FILTER ({rows}) OVER () AS n, {rows} AS fits FROM embeddings),
  c0 AS MATERIALIZED (SELECT r - 1 AS c, v FROM k WHERE r <= greatest(1, least({CELLS}, n // 4)))"""]
    for i in range(rounds):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT k.v, c{i}.c AS c FROM k, c{i} WHERE fits QUALIFY {first(f"c{i}")}),
  u{i} AS (SELECT c, list(m ORDER BY i) AS v FROM (SELECT c, i, avg(v[i]) AS m FROM a{i}, range(1, 65) t(i) GROUP BY ALL) GROUP BY c),
  c{i + 1} AS MATERIALIZED (SELECT c{i}.c AS c, coalesce(u{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN u{i} ON u{i}.c = c{i}.c)""")
    steps.append(f"""iv AS MATERIALIZED (SELECT vec_id, k.v, fits, c{rounds}.c AS c FROM k, c{rounds} QUALIFY {first(f"c{rounds}")}), ce AS (SELECT c, any_value(c{rounds}.v) AS v, count(iv.c) AS n FROM c{rounds} LEFT JOIN iv USING (c) GROUP BY c)""")
    return ", ".join(steps)


PROBED = f"""pr AS (SELECT k.vec_id AS query_id, k.v AS q, ce.c AS c, ce.n AS n FROM iv k, ce WHERE k.vec_id % 50 = 0 AND ce.n > 0 QUALIFY row_number() OVER (PARTITION BY k.vec_id ORDER BY round(list_dot_product(ce.v, ce.v) - 2 * list_dot_product(k.v, ce.v), 12), ce.c) <= {PROBES}),
  pv AS (SELECT query_id, vec_id, round(list_dot_product(q, iv.v), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(q, iv.v), 9) DESC, vec_id) AS rank FROM pr JOIN iv USING (c) WHERE vec_id <> query_id)"""

def built(spark: SparkSession, sf_dir: str) -> vector_index.VectorIndex:
    """The index of all vectors."""
    return views.kept(spark, sf_dir, "embeddings", "whole", lambda: vector_index.build(views.table(spark, sf_dir, "embeddings"), views.place(spark, "vectors"), CELLS, rounds=ROUNDS))


def grown(spark: SparkSession, sf_dir: str) -> vector_index.VectorIndex:
    """The index of four fifths of the vectors, and the rest appended."""
    v = views.table(spark, sf_dir, "embeddings")

    def make():
        own = vector_index.build(v.where("vec_id % 5 <> 0"), views.place(spark, "vectors"), CELLS, rounds=ROUNDS)
        return vector_index.append(own, v.where("vec_id % 5 = 0"))

    return views.kept(spark, sf_dir, "embeddings", "grown", make)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query(f"WITH {VEC} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM vt WHERE rank <= {K}")
def vector_ivf_topk(spark, sf_dir):
    """The exact nearest by way of the index: further cells are read only where their balls reach the k-th score."""
    found = vector_index.search(spark, built(spark, sf_dir), _asked(spark, sf_dir), K, PROBES, exact=True)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {ivf_sql()}, {PROBED} SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM pv WHERE rank <= {K}")
def vector_ivf_probe(spark, sf_dir):
    found = vector_index.search(spark, built(spark, sf_dir), _asked(spark, sf_dir), K, PROBES)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _recall(spark, sf_dir):
    exact = retrieval.vector_scores(views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), _asked(spark, sf_dir), K)
    return extraction.recall(vector_index.search(spark, built(spark, sf_dir), _asked(spark, sf_dir), K, PROBES), exact)


RECALL = f"""{VEC}, {ivf_sql()}, {PROBED}, rc AS (SELECT count(*) AS queries, round(avg(r), 6) AS recall FROM (SELECT vt.query_id, count(pv.vec_id) / count(*) AS r FROM vt LEFT JOIN pv ON pv.query_id = vt.query_id AND pv.vec_id = vt.vec_id AND pv.rank <= {K} WHERE vt.rank <= {K} GROUP BY vt.query_id))"""


@query(f"WITH {RECALL} SELECT * FROM rc")
def recall_at_k(spark, sf_dir):
    return _recall(spark, sf_dir)


@query(f"""WITH {RECALL}, w AS (SELECT query_id, sum(n) AS met FROM pr GROUP BY query_id), o AS (SELECT met, row_number() OVER (ORDER BY met) - 1 AS i, count(*) OVER () AS n FROM w),
  p AS (SELECT CAST(max(met) FILTER (i = floor((n - 1) * 0.95)) AS BIGINT) AS ann_p95, (SELECT count(*) FROM embeddings) AS exact_p95 FROM o)
  SELECT recall, exact_p95, ann_p95, recall >= 0.98 AS recall_ok, round(greatest(0, (exact_p95 - ann_p95) / exact_p95), 4) AS gain, (exact_p95 - ann_p95) / exact_p95 >= 0.30 AS gain_ok, recall >= 0.98 AND (exact_p95 - ann_p95) / exact_p95 >= 0.30 AS passed FROM rc, p""")
def vector_gate(spark, sf_dir):
    """Recall, and the vectors that a question meets, by the index and by a scan, instead of milliseconds, which differ from run to run."""
    manifest = built(spark, sf_dir).manifest(spark)
    met = vector_index.probes(manifest, _asked(spark, sf_dir)).where(F.col("turn") <= PROBES).join(manifest.select("cell", "n"), "cell").groupBy("query_id").agg(F.sum("n").alias("met"))
    ordered = met.select("met", (F.row_number().over(Window.orderBy("met")) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))  # a row a question
    ann = ordered.agg(F.max(F.when(F.col("i") == F.floor((F.col("n") - 1) * 0.95), F.col("met"))).alias("ann_p95"))
    measured = _recall(spark, sf_dir).select("recall").crossJoin(manifest.agg(F.sum("n").alias("exact_p95"))).crossJoin(ann)
    return vector_index.gate(measured).select("recall", "exact_p95", "ann_p95", "recall_ok", "gain", "gain_ok", "passed")


@query(f"WITH {ivf_sql('vec_id % 5 <> 0')} SELECT c AS cell, count(*) FILTER (fits) AS built, count(*) FILTER (NOT fits) AS appended FROM c{ROUNDS} LEFT JOIN iv USING (c) GROUP BY c")
def vector_append(spark, sf_dir):
    manifest = grown(spark, sf_dir).manifest(spark)
    first = manifest.agg(F.min("segment").alias("first"))
    kind = manifest.crossJoin(F.broadcast(first))
    n = lambda own: F.sum(F.when((F.col("segment") == F.col("first")) == own, F.col("n")).otherwise(0))
    return kind.groupBy(F.col("cell").cast("long").alias("cell")).agg(n(True).alias("built"), n(False).alias("appended"))


@query(f"""WITH {ivf_sql('vec_id % 5 <> 0')}, x AS (SELECT CASE WHEN fits THEN 1 ELSE 2 END AS segment, vec_id, c FROM iv)
  SELECT segment, count(*) AS listed, count(*) AS stored, count(DISTINCT vec_id) AS distinct_ids, count(DISTINCT c) AS cells, TRUE AS consistent FROM x GROUP BY segment""")
def vector_load_check(spark, sf_dir):
    told = vector_index.checked(spark, grown(spark, sf_dir))
    return told.select(F.substring("segment", 1, 6).cast("int").alias("segment"), "listed", "stored", "distinct_ids", "cells", "consistent")


@query(f"WITH {VEC} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM vt WHERE rank <= {K}")
def vector_grown_topk(spark, sf_dir):
    """A search in the index that was appended to: the same neighbours."""
    found = vector_index.search(spark, grown(spark, sf_dir), _asked(spark, sf_dir), K, PROBES, exact=True)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")
