"""Domain views over the given tables: papers, snippets, questions, feedback, sessions, claims, runs; and the index of snippets."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import index
from quarry.sources.shared import shared_dir

SECTIONS = ("abstract", "introduction", "related_work", "method", "experiments", "results", "limitations", "future_work", "discussion", "conclusion", "body")
VENUES = ("CVPR 2020", "arXiv", "NeurIPS", "Journal of Tests", "ICML", "Workshop")
FEEDBACK = {"view": "fetch_success", "error": "fetch_error", "click": "evidence_used", "purchase": "claim_confirmed", "signup": "user_upvote"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snippet_id, doc_id, paper_id (the source), section, venue, year, citations, quality, text of each document."""
    i = F.col("doc_id")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.format_string("Pdoc_%d:S1", i).alias("snippet_id"),
        "doc_id",
        F.col("source").alias("paper_id"),
        "lang",
        pick(SECTIONS).alias("section"),
        pick(VENUES).alias("venue"),
        (2005 + i % 20).cast("int").alias("year"),
        ((i * 37) % 500).alias("citations"),
        (F.lit(0.2) + (i % 9) / F.lit(10.0)).alias("quality"),
        "text",
    )


_kept: dict[tuple, object] = {}


def kept(spark: SparkSession, sf_dir: str, table_name: str, what: str, make: Callable[[], object]):
    """What make() gives, made once for each session and state of the table's files."""
    files = table(spark, sf_dir, table_name).select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").distinct().collect()
    state = (what, spark.sparkContext.applicationId, shared_dir(spark), sf_dir, tuple(sorted(map(tuple, files))))
    if state not in _kept:
        _kept[state] = make()
    return _kept[state]


def place(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def snippet_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of snippets, written to the shared folder once for each session and state of the table's files."""
    return kept(spark, sf_dir, "documents", "snippets", lambda: index.build(snippets(spark, sf_dir), place(spark, "index")))


def claims_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of claims by claim_id, likewise."""
    rows = claims(spark, sf_dir).select(F.col("claim_id").cast("string").alias("snippet_id"), F.col("topic").alias("paper_id"), F.lit("claim").alias("section"), F.col("claim").alias("text"))
    return kept(spark, sf_dir, "documents", "claims", lambda: index.build(rows, place(spark, "claims")))


def snippets_sql() -> str:
    pick = lambda values: f"[{', '.join(repr(v) for v in values)}][doc_id % {len(values)} + 1]"
    return f"""SELECT 'Pdoc_' || doc_id || ':S1' AS snippet_id, doc_id, source AS paper_id, lang, {pick(SECTIONS)} AS section, {pick(VENUES)} AS venue,
      CAST(2005 + doc_id % 20 AS INT) AS year, (doc_id * 37) % 500 AS citations, 0.2::DOUBLE + (doc_id % 9) / 10.0::DOUBLE AS quality, text FROM documents"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, question: each benchmark item, whole."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: documents whose lines are paragraphs; every fifth begins with an abstract, the next of five puts a numbered heading between its lines."""
    i = F.col("doc_id") % 5
    lines = lambda by: F.replace(F.col("text"), F.lit("\n"), F.lit(by))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(i == 0, F.concat(F.lit("Abstract\n"), lines("\n\n"))).when(i == 1, lines("\n2.1 Results:\n")).otherwise(lines("\n\n")).alias("text"))


STRUCTURED_SQL = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Abstract' || chr(10) || replace(text, chr(10), chr(10) || chr(10)) WHEN 1 THEN replace(text, chr(10), chr(10) || '2.1 Results:' || chr(10)) ELSE replace(text, chr(10), chr(10) || chr(10)) END AS text FROM documents"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_name, event_type, value."""
    kind = F.create_map(*[F.lit(x) for pair in FEEDBACK.items() for x in pair])
    return table(spark, sf_dir, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_name"), kind[F.col("event_type")].alias("event_type"), (F.col("value") / 500).alias("value"))


def claims(spark: SparkSession, sf_dir: str, words: int = 24) -> DataFrame:
    """claim_id, topic, claim: every document in claims of words words, line by line, numbered within the document; the first of every seventh document is denied."""
    told = lambda ws: F.transform(F.sequence(F.lit(0), ((F.size(ws) - 1) / words).cast("int")), lambda p: F.array_join(F.slice(ws, p * words + 1, words), " "))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")), lambda ws: F.size(ws) > 0)
    parts = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.flatten(F.transform(lines, told))).alias("part", "told"))
    denied = (F.col("doc_id") % 7 == 0) & (F.col("part") == 0)
    return parts.select((F.col("doc_id") * 10000000 + F.col("part")).alias("claim_id"), F.col("lang").alias("topic"), F.when(denied, F.concat(F.lit("not "), "told")).otherwise(F.col("told")).alias("claim"))


CLAIMS_SQL = """SELECT doc_id * 10000000 + n AS claim_id, lang AS topic, CASE WHEN doc_id % 7 = 0 AND n = 0 THEN 'not ' ELSE '' END || array_to_string(ws[part * 24 + 1 : part * 24 + 24], ' ') AS claim
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, part) - 1 AS n FROM (SELECT *, unnest(range(0, CAST(ceil(len(ws) / 24.0) AS BIGINT))) AS part FROM (SELECT doc_id, lang, i, list_filter(string_split_regex(string_split(text, chr(10))[i], '\\s+'), lambda x: x <> '') AS ws
    FROM (SELECT doc_id, lang, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) WHERE len(ws) > 0))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, run_id, at, metric, n: each hour of each event type is a run."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("topic"), hour.alias("at")).agg(F.avg("value").alias("metric"), F.count("*").alias("n")).withColumn("run_id", F.date_format("at", "yyyyMMdd'T'HHmmss'Z'"))


RUNS_SQL = """SELECT event_type AS topic, date_trunc('hour', ts) AS at, avg(value) AS metric, count(*) AS n, strftime(date_trunc('hour', ts), '%Y%m%dT%H%M%SZ') AS run_id FROM events GROUP BY 1, 2"""
