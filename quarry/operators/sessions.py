"""Research sessions from a log of commands: guarded transitions, recorded questions, lists, details and summaries.

A session is there from a `create` until a `delete`, which takes its records with it, and is open or closed meanwhile. A
command that its session's state doesn't allow is refused and changes nothing. What a command meets follows from the last
commands of some kinds before it, so all sessions are judged by windows over the log, not one command after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text

COMMANDS = "name string, at long, kind string, description string, question string, report_path string, elapsed_ms double, key_claims array<string>, gaps array<string>, citations array<string>, synthesis string, evidence_count long, aggregation boolean"
KINDS = ("create", "close", "reopen", "delete", "record")


def _before(name: str = "name"):
    return Window.partitionBy(name).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)


def judged(commands: DataFrame) -> DataFrame:
    """commands with error (null if the command is done), life (the number of effective creates up to it) and open (the state it meets).

    at orders the commands of a session and is theirs alone.
    """
    kind = F.col("kind")
    there = F.coalesce(F.last(F.when(kind.isin("create", "delete"), kind), True).over(_before()) == "create", F.lit(False))
    met = commands.withColumn("there", there)
    born = (kind == "create") & ~F.col("there")
    turned = F.when(born | ((kind == "reopen") & F.col("there")), True).when((kind == "close") & F.col("there"), False)
    met = met.withColumn("open", F.col("there") & F.coalesce(F.last(turned, True).over(_before()), F.lit(False)))
    error = (
        F.when(~kind.isin(*KINDS), "unknown command")
        .when(kind == "create", F.when(F.col("there"), "already exists"))
        .when(~F.col("there"), "not found")
        .when((kind == "close") & ~F.col("open"), "already closed")
        .when((kind == "reopen") & F.col("open"), "already open")
        .when((kind == "record") & ~F.col("open"), "closed; reopen it first")
    )
    life = F.count_if(born).over(_before().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return met.withColumn("error", F.coalesce(error, F.when(kind.isNull(), "unknown command"))).withColumn("life", life)


def sessions(done: DataFrame) -> DataFrame:
    """name, life, description, status, created_at, closed_at of the sessions that are there after the judged commands."""
    fine = done.where("error IS NULL")
    last = fine.groupBy("name").agg(F.max("life").alias("life"), F.max_by(F.col("kind") == "delete", "at").alias("gone"))
    own = fine.join(last.where("not gone"), ["name", "life"])
    turn = F.col("kind").isin("create", "close", "reopen")
    told = own.groupBy("name", "life").agg(F.max(F.when(F.col("kind") == "create", F.struct("at", F.coalesce("description", F.lit("")).alias("description")))).alias("c"), F.max(F.when(turn, F.struct("at", "kind"))).alias("t"))
    closed = F.col("t.kind") == "close"
    return told.select("name", "life", "c.description", F.when(closed, "closed").otherwise("open").alias("status"), F.col("c.at").alias("created_at"), F.when(closed, F.col("t.at")).alias("closed_at"))


def records(done: DataFrame, preview: int = 500) -> DataFrame:
    """The records of sessions that are there, with the first characters of their syntheses; lists and counts that are missing are empty."""
    none = F.array().cast("array<string>")
    rows = done.where("error IS NULL AND kind = 'record'").join(sessions(done).select("name", "life"), ["name", "life"], "left_semi")
    return rows.select("name", "at", "question", "report_path", "elapsed_ms", *[F.coalesce(c, none).alias(c) for c in ("key_claims", "gaps", "citations")], F.substring(F.coalesce("synthesis", F.lit("")), 1, preview).alias("synthesis_preview"), F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), F.coalesce("aggregation", F.lit(False)).alias("aggregation"))


def listed(done: DataFrame, status: str | None = None) -> DataFrame:
    """Sessions with query_count, the newest first; of one status, if given."""
    own = sessions(done) if status is None else sessions(done).where(F.col("status") == status)
    counts = records(done).groupBy("name").agg(F.count("*").alias("query_count"))
    return own.join(counts, "name", "left").withColumn("query_count", F.coalesce("query_count", F.lit(0))).orderBy(F.desc("created_at"), "name")


def summary(done: DataFrame) -> DataFrame:
    """One row for each session: counts, papers, citations, gaps (all, and those of two questions or more), claims, mean time.

    Lists over all questions keep their order; those of distinct values are sorted. What is counted is counted over rows, so
    only the lists that a session asks for are as long as the session.
    """
    rows = records(done)
    every = lambda c: rows.select("name", "at", F.posexplode(c).alias("pos", "x"))
    in_order = lambda c: every(c).groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "pos", "x"))), lambda e: e.x).alias(c))
    cited = every("citations")
    papers = cited.select("name", text.paper_of(F.col("x")).alias("p")).where("p <> ''").groupBy("name").agg(F.array_sort(F.collect_set("p")).alias("papers"))
    citations = cited.groupBy("name").agg(F.count("*").alias("total_citations"), F.array_sort(F.collect_set("x")).alias("unique_citations"))
    twice = every("gaps").select("name", "at", "x").distinct().groupBy("name", "x").agg(F.count("*").alias("n")).where("n >= 2").groupBy("name").agg(F.array_sort(F.collect_list("x")).alias("recurring_gaps"))
    counts = rows.groupBy("name").agg(F.count("*").alias("query_count"), F.sum("evidence_count").alias("total_evidence"), F.round(F.avg("elapsed_ms"), 3).alias("avg_elapsed_ms"), F.count_if("aggregation").alias("aggregation_used"))
    told = sessions(done).select("name", "status")
    for part in (counts, papers, citations, in_order("gaps"), twice, in_order("key_claims")):
        told = told.join(part, "name", "left")
    none = F.array().cast("array<string>")
    lists = [F.coalesce(c, none).alias(c) for c in ("papers", "unique_citations", "gaps", "recurring_gaps", "key_claims")]
    return told.select("name", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("query_count", "total_evidence", "total_citations", "aggregation_used")], "avg_elapsed_ms", *lists)


def carried(done: DataFrame) -> DataFrame:
    """The shortest log that leads to the same sessions: for the next batch of commands to be judged after it."""
    own = sessions(done)
    rows = done.where("error IS NULL AND kind <> 'delete'").join(own.select("name", "life", "closed_at", "created_at"), ["name", "life"])
    kept = rows.where("kind IN ('create', 'record') OR (kind = 'close' AND at = closed_at)")
    return kept.select(*[c.split()[0] for c in COMMANDS.split(", ")])


#: What may be said of a source.
FEEDBACK = ("fetch_success", "fetch_error", "extraction_quality", "claim_confirmed", "claim_disputed", "claim_stale", "evidence_used", "user_upvote", "user_downvote")


def feedback(events: DataFrame) -> DataFrame:
    """events(source_name, event_type, value) with accepted, and the reason where it isn't; a missing value is 1."""
    known: Column = F.coalesce(F.col("event_type").isin(*FEEDBACK), F.lit(False))
    reason = F.when(F.trim(F.coalesce("source_name", F.lit(""))) == "", "source missing").when(~known, "unknown event_type")
    return events.withColumn("value", F.coalesce("value", F.lit(1.0))).withColumn("reason", reason).withColumn("accepted", reason.isNull())


def known_sources(known: DataFrame, accepted: DataFrame, start: float = 0.5) -> DataFrame:
    """source_name, score: known ones as they are, new ones of accepted feedback with the score that sources start with."""
    new = accepted.where("accepted").select("source_name").distinct().join(known, "source_name", "left_anti")
    return known.select("source_name", "score").union(new.select("source_name", F.lit(start)))
