"""Texts to sections, paragraphs and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How headings begin, and their sections, in order of precedence.
HEADINGS = (
    ("abstract", "abstract"),
    ("introduction", "introduction"),
    ("background", "background"),
    ("related work", "related_work"),
    ("method", "method"),
    ("approach", "method"),
    ("experiments", "experiments"),
    ("results", "results"),
    ("discussion", "discussion"),
    ("limitations", "limitations"),
    ("future work", "future_work"),
    ("conclusion", "conclusion"),
)


def words_of(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def is_heading(line: Column) -> Column:
    """Ten words or fewer, and all in capitals, or each word capitalised, or without a full stop or comma at the end."""
    few = F.size(words_of(line)).between(1, 10)
    titled = line.rlike("[A-Z]") & ~line.rlike(r"[A-Za-z][A-Z]|(^|[^A-Za-z])[a-z]")
    return few & ((line == F.upper(line)) | titled | ~line.rlike("[.,]$"))


def section_of(line: Column) -> Column:
    """The section that a heading names, numbers in front of it aside; null for other lines."""
    name = F.regexp_replace(F.regexp_replace(F.lower(line), r"^\d+(\.\d+)*\s*", ""), "^:+|:+$", "")
    found = F.lit(None).cast("string")
    for start, section in reversed(HEADINGS):
        found = F.when(name.startswith(start), section).otherwise(found)
    return F.when(is_heading(line), found)


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (from 1), section, text of docs(doc_id, text). A blank line or a heading ends a paragraph; lines before any heading are body.

    Sections and paragraphs are windows over the lines of one document, a group that its text bounds.
    """
    lines = F.transform(F.split("text", r"\r\n|\n|\r"), lambda x: F.trim(x))
    rows = docs.select("doc_id", F.posexplode(lines).alias("at", "line")).withColumn("heading", section_of(F.col("line")))
    order = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.col("heading").isNotNull() | (F.col("line") == "")
    told = rows.select("doc_id", "at", "line", gap.alias("gap"), F.coalesce(F.last("heading", ignorenulls=True).over(order), F.lit("body")).alias("section"), F.sum(gap.cast("int")).over(order).alias("island"))
    joined = told.where(~F.col("gap")).groupBy("doc_id", "island").agg(F.min("section").alias("section"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x.line), " ").alias("text"))
    return joined.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("island")).alias("paragraph"), "section", "text")


def chunks(docs: DataFrame, words: int = 120) -> DataFrame:
    """doc_id, chunk (from 1), section, n_words, text: each paragraph in runs of words words."""
    split = paragraphs(docs).select("doc_id", "paragraph", "section", words_of(F.col("text")).alias("ws"))
    parts = split.select("doc_id", "paragraph", "section", "ws", F.explode(F.sequence(F.lit(0), ((F.size("ws") - 1) / words).cast("int"))).alias("part"))
    cut = parts.select("doc_id", "paragraph", "section", "part", F.slice("ws", F.col("part") * words + 1, words).alias("ws"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("paragraph", "part"))
    return cut.select("doc_id", number.alias("chunk"), "section", F.size("ws").cast("long").alias("n_words"), F.array_join("ws", " ").alias("text"))


def snippet_id(paper_id: Column, chunk: Column) -> Column:
    """P, the paper's letters and digits with one _ for whatever else stands between them, and the number of the chunk."""
    name = F.regexp_replace(F.regexp_replace(paper_id, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("P"), name, F.lit(":S"), chunk.cast("string"))
