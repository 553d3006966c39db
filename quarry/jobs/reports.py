"""Queries on evidence clusters and report checks, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import CITATION
from quarry.jobs.catalogue import TOKENS, TOKEN_SET, query
from quarry.operators import clusters, reports
from quarry.sources import views

NEG = "['no', 'not', 'never', 'without', 'none', 'cannot', 'dont']"


def _packs(spark, sf_dir):
    """Packs of twenty documents that follow each other and have a vector; every ninth text is denied."""
    d, v = views.table(spark, sf_dir, "documents"), views.table(spark, sf_dir, "embeddings")
    i = F.col("doc_id")
    return d.join(v, d["doc_id"] == v["vec_id"]).select(
        F.floor(i / 20).alias("pack"), (i % 20).alias("rank"), F.format_string("Pdoc_%d:S1", i).alias("snippet_id"), F.col("source").alias("paper_id"), ((i * 37) % 100 / 100).alias("score"),
        F.when(i % 9 == 0, F.concat(F.lit("not increase "), "text")).when(i % 4 == 0, F.concat(F.lit("decrease "), "text")).otherwise(F.col("text")).alias("text"), F.col("embedding").alias("vector"),
    )


OPPOSED = " OR ".join(f"(list_contains(a.ts, '{u}') AND list_contains(b.ts, '{d}')) OR (list_contains(a.ts, '{d}') AND list_contains(b.ts, '{u}'))" for u, d in clusters.DIRECTIONS)
CLUSTERS = f"""WITH RECURSIVE i AS (SELECT doc_id // 20 AS pack, CAST(row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS INT) AS pos, 'Pdoc_' || doc_id || ':S1' AS snippet_id, source AS paper_id, (doc_id * 37) % 100 / 100 AS score,
    list_distinct(regexp_extract_all(lower(CASE WHEN doc_id % 9 = 0 THEN 'not increase ' WHEN doc_id % 4 = 0 THEN 'decrease ' ELSE '' END || text), '[a-z0-9]+')) AS ts, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON doc_id = vec_id),
  p AS (SELECT a.pack, a.pos AS x, b.pos AS y, list_dot_product(a.v, b.v) AS near, CASE WHEN len(list_intersect(a.ts, b.ts)) / greatest(1, len(list_distinct(list_concat(a.ts, b.ts)))) < 0.25 THEN 0.0
      ELSE CASE WHEN list_has_any(a.ts, {NEG}) <> list_has_any(b.ts, {NEG}) THEN 0.5 ELSE 0 END + CASE WHEN {OPPOSED} THEN 0.35 ELSE 0 END END::DOUBLE AS apart FROM i a JOIN i b ON a.pack = b.pack AND a.pos < b.pos),
  e AS (SELECT pack, x AS u, y AS w FROM p WHERE near >= 0.3 UNION ALL SELECT pack, y, x FROM p WHERE near >= 0.3),
  r AS (SELECT pack, pos AS u, pos AS w FROM i UNION SELECT r.pack, r.u, e.w FROM r JOIN e ON r.pack = e.pack AND r.w = e.u),
  c AS (SELECT pack, u AS pos, min(w) AS cluster FROM r GROUP BY pack, u),
  g AS (SELECT p.pack, c.cluster, avg(near) AS near, avg(apart) AS apart FROM p JOIN c ON c.pack = p.pack AND c.pos = p.x JOIN c d ON d.pack = p.pack AND d.pos = p.y AND d.cluster = c.cluster GROUP BY ALL),
  z AS (SELECT pack, cluster, count(*) AS items, count(DISTINCT paper_id) AS papers, first(snippet_id ORDER BY score DESC, pos) AS snippet_id FROM i JOIN c USING (pack, pos) GROUP BY ALL),
  f AS (SELECT pack, cluster, CASE WHEN apart >= 0.4 THEN 'conflict' WHEN apart >= 0.2 THEN 'mixed' ELSE 'consensus' END AS label, CASE WHEN near IS NULL THEN 1.0 ELSE round(greatest(0, least(1, near - apart)), 4) END::DOUBLE AS consensus, items, papers, snippet_id FROM z LEFT JOIN g USING (pack, cluster)),
  k AS (SELECT pack, CAST(row_number() OVER (PARTITION BY pack ORDER BY CASE label WHEN 'consensus' THEN 0 WHEN 'mixed' THEN 1 ELSE 2 END, items DESC, cluster) AS INT) AS place, cluster, label, consensus, items, papers, snippet_id FROM f)"""


@query(f"{CLUSTERS} SELECT * FROM k")
def cluster_consensus(spark, sf_dir):
    return clusters.clusters(_packs(spark, sf_dir), similarity=0.3)


@query(f"""{CLUSTERS} SELECT pack, count(*) AS clusters, count(*) FILTER (label = 'consensus') AS consensus, count(*) FILTER (label = 'mixed') AS mixed, count(*) FILTER (label = 'conflict') AS conflict, count(*) FILTER (papers > 1) AS cross_document FROM k GROUP BY pack""")
def cluster_summary(spark, sf_dir):
    return clusters.summary(clusters.clusters(_packs(spark, sf_dir), similarity=0.3))


#: A report for each document: its lines with citations to its snippets (every third without), and an experiment.
LINES = r"""ln AS (SELECT doc_id AS id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
  sy AS (SELECT id, string_agg(CASE WHEN i % 3 = 0 THEN line WHEN i % 7 = 1 THEN 'However not more ' || line || ' (Pdoc_' || id || ':S' || i || ')' ELSE line || ' (Pdoc_' || id || ':S' || i || ') (SNAP:x' || i || ':S1)' END, chr(10) ORDER BY i) AS text FROM ln GROUP BY id),
  ev AS (SELECT id, 'Pdoc_' || id || ':S' || i AS snippet_id, CASE WHEN id % 4 = 0 THEN 'less of other things' ELSE line END AS text FROM ln WHERE i % 5 <> 4),
  rp AS (SELECT id, text, CASE WHEN id % 6 = 0 THEN [] ELSE ['(Pdoc_' || id || ':S1)', 'Pdoc_' || id, '(SNAP:x1:S1)'] END AS listed, 'try ' || id AS proposal, CASE WHEN id % 3 = 0 THEN [] ELSE ['(Pdoc_1:S1)'] END AS bound FROM sy)"""


def _reports(spark, sf_dir):
    i, id_ = F.col("i").cast("string"), F.col("id").cast("string")
    lines = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("i", F.col("at") + 1)
    own = F.concat(F.lit("(Pdoc_"), id_, F.lit(":S"), i, F.lit(")"))
    told = F.when(F.col("i") % 3 == 0, F.col("line")).when(F.col("i") % 7 == 1, F.concat(F.lit("However not more "), "line", F.lit(" "), own)).otherwise(F.concat("line", F.lit(" "), own, F.lit(" (SNAP:x"), i, F.lit(":S1)")))
    texts = lines.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", told.alias("t")))), lambda x: x.t), "\n").alias("text"))
    none = F.array().cast("array<string>")
    listed = F.when(F.col("id") % 6 == 0, none).otherwise(F.array(F.concat(F.lit("(Pdoc_"), id_, F.lit(":S1)")), F.concat(F.lit("Pdoc_"), id_), F.lit("(SNAP:x1:S1)")))
    bound = F.when(F.col("id") % 3 == 0, none).otherwise(F.array(F.lit("(Pdoc_1:S1)")))
    experiment = F.array(F.struct(F.concat(F.lit("try "), id_).alias("proposal"), bound.alias("citations")))
    evidence = lines.where("i % 5 <> 4").select("id", F.concat(F.lit("Pdoc_"), id_, F.lit(":S"), i).alias("snippet_id"), F.when(F.col("id") % 4 == 0, "less of other things").otherwise(F.col("line")).alias("text"))
    return texts.select("id", "text", listed.alias("listed"), experiment.alias("experiments"), F.lit(False).alias("direct")), evidence


CIT = CITATION.replace("'", "''")
FULL = "f AS (SELECT id, i AS line_no, ls[i] AS line FROM (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM rp)))"


@query(f"""WITH {LINES}, u AS (SELECT id, listed, proposal, bound, list_distinct(regexp_extract_all(text || chr(10) || proposal, '{CIT}')) AS used FROM rp)
  SELECT id, 'no_citations' AS error, '' AS detail FROM u WHERE len(used) = 0 UNION ALL SELECT id, 'bad_format', c FROM (SELECT id, unnest(listed) AS c FROM u) WHERE NOT regexp_full_match(c, '{CIT}')
  UNION ALL SELECT id, 'not_listed', unnest(list_filter(used, lambda x: NOT list_contains(listed, x))) FROM u UNION ALL SELECT id, 'experiment_without', proposal FROM u WHERE len(bound) = 0""")
def citation_audit(spark, sf_dir):
    return reports.audit(_reports(spark, sf_dir)[0])


@query(f"""WITH {LINES}, {FULL}, c AS (SELECT id, line_no, line, regexp_extract_all(line, '{CIT}') AS cited, regexp_replace(line, '{CIT}', '', 'g') AS claim FROM f),
  x AS (SELECT id, line_no, unnest(cited) AS q FROM c), t AS (SELECT x.id, line_no, string_agg(ev.text, ' ') AS told FROM x JOIN ev ON ev.id = x.id AND q = '(' || snippet_id || ')' GROUP BY ALL),
  k AS (SELECT id, line_no, {TOKEN_SET.format("claim")} AS c, {TOKEN_SET.format("coalesce(told, '')")} AS e FROM c LEFT JOIN t USING (id, line_no) WHERE len(cited) > 0 AND NOT contains(lower(line), 'insufficient evidence') AND NOT contains(lower(line), 'not found in sources.'))
  SELECT id, CAST(line_no AS INT) AS line_no, CAST(len(list_intersect(c, e)) AS BIGINT) AS shared, round(len(list_intersect(c, e)) / len(c), 3) AS overlap,
    CASE WHEN len(e) = 0 THEN 'missing' WHEN len(list_intersect(c, e)) / len(c) < 0.15 OR len(list_intersect(c, e)) < 2 THEN 'low' ELSE 'ok' END AS status FROM k WHERE len(c) > 0""")
def claim_support(spark, sf_dir):
    return reports.claim_support(*_reports(spark, sf_dir))


def _line_vectors(spark, sf_dir, lines):
    v = views.table(spark, sf_dir, "embeddings")
    n = v.count()
    at = lambda times: (F.col("id") * times + F.col("line_no")) % n
    own = lambda name: v.select(F.col("vec_id").alias(f"{name}_id"), F.col("embedding").alias(f"{name}_vector"))
    keyed = lines.select("id", "line_no", at(7).alias("claim_id"), at(3).alias("told_id"))
    return keyed.join(own("claim"), "claim_id").join(own("told"), "told_id").select("id", "line_no", "claim_vector", "told_vector")


ANY = lambda words, c: f"regexp_matches(lower({c}), '{'|'.join(words)}')"
PROXY_OPPOSED = " OR ".join(f"(list_contains(a, '{u}') AND list_contains(b, '{d}')) OR (list_contains(a, '{d}') AND list_contains(b, '{u}'))" for u, d in reports.DIRECTIONS)
NEG2 = "['no', 'not', 'never', 'without', 'none', 'cannot']"
SEMANTIC = rf"""WITH {LINES}, {FULL}, c AS (SELECT id, line_no, regexp_extract_all(line, '\(P[^:()\s]+:S\d+\)') AS cited, trim(regexp_replace(line, '\(P[^:()\s]+:S\d+\)', '', 'g')) AS claim FROM f),
  x AS (SELECT id, line_no, unnest(cited) AS q FROM c), t AS (SELECT x.id, line_no, string_agg(ev.text, ' ') AS told FROM x JOIN ev ON ev.id = x.id AND q = '(' || snippet_id || ')' GROUP BY ALL),
  n AS (SELECT count(*) AS n FROM embeddings),
  s AS (SELECT id, line_no, claim, told, greatest(0, least(1, (list_dot_product(v.embedding::DOUBLE[], w.embedding::DOUBLE[]) + 1) / 2)) AS support, {TOKENS.format("claim")} AS a, {TOKENS.format("told")} AS b
        FROM c JOIN t USING (id, line_no), n JOIN embeddings v ON v.vec_id = (id * 7 + line_no) % n JOIN embeddings w ON w.vec_id = (id * 3 + line_no) % n WHERE claim <> '' AND trim(told) <> ''),
  k AS (SELECT id, line_no, support, greatest(0, least(1, CASE WHEN list_has_any(a, {NEG2}) <> list_has_any(b, {NEG2}) THEN 0.45 ELSE 0 END + CASE WHEN {PROXY_OPPOSED} THEN 0.35 ELSE 0 END
      + CASE WHEN ({ANY(reports.UP, "claim")} AND {ANY(reports.DOWN, "told")}) OR ({ANY(reports.DOWN, "claim")} AND {ANY(reports.UP, "told")}) THEN 0.25 ELSE 0 END + CASE WHEN {ANY(reports.CONTRASTS, "claim")} AND support < 0.5 THEN 0.10 ELSE 0 END + 0.20 * (1 - support)))::DOUBLE AS contradiction FROM s),
  z AS (SELECT *, CASE WHEN support < 0.55 THEN 'weak_support' WHEN contradiction > 0.30 THEN 'possible_contradiction' ELSE 'supported' END AS status FROM k)"""


def _semantic(spark, sf_dir):
    own, evidence = _reports(spark, sf_dir)
    return reports.semantic_lines(own, evidence, _line_vectors(spark, sf_dir, reports.cited_lines(own)))


@query(f"{SEMANTIC} SELECT id, CAST(line_no AS INT) AS line_no, round(support, 6) AS support, round(contradiction, 6) AS contradiction, status FROM z")
def semantic_line_status(spark, sf_dir):
    return _semantic(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("support", "contradiction")})


@query(f"""{SEMANTIC} SELECT id, round(avg(support), 4) AS support_avg, round(min(support), 4) AS support_min, round(max(contradiction), 4) AS contradiction_max, count(*) FILTER (status = 'weak_support') AS below,
  count(*) FILTER (status = 'possible_contradiction') AS contradicted, CASE WHEN count(*) FILTER (status <> 'supported') = 0 THEN 'pass' ELSE 'warn' END AS status FROM z GROUP BY id""")
def semantic_report_status(spark, sf_dir):
    return reports.semantic_summary(_semantic(spark, sf_dir))
