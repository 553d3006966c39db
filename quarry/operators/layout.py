"""Page layout: labels of blocks, columns, reading order, confidence, over blocks(page, x0, y0, x1, y1, text, width, height)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scores, text

CAPTION = r"^(fig\.|figure |table |tab\.|algorithm )"


def label(body: Column, x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """header, footer, caption, footnote, table, body_left or body_right; other for an empty block."""
    t = F.trim(body)
    low, tight = F.lower(t), text.compact(body)
    digits = F.length(F.regexp_replace(tight, "[^0-9]", ""))
    marks = F.length(F.regexp_replace(tight, "[^:;,_%-]", ""))
    foot = (height > 0) & (y0 > height * 0.84) & (t.rlike(r"^\d+[\].)]\s") | t.rlike(r"^[*†‡]\s") | low.rlike(r"^(notes?:|footnote|\*)") | ((F.length(t) < 220) & low.rlike(r"\bdoi\b|\bhttp\b|\barxiv\b")))
    # a wide gap inside a line is gone once white space is collapsed
    table = tight.contains("|") | body.contains("\t") | ((F.length(tight) > 25) & (digits >= 6) & (marks >= 4))
    return (
        F.when(t == "", "other")
        .when((height > 0) & (y1 < height * 0.06) & (F.length(t) < 140), "header")
        .when((height > 0) & (y0 > height * 0.95) & (F.length(t) < 140), "footer")
        .when(low.rlike(CAPTION), "caption")
        .when(foot, "footnote")
        .when(table, "table")
        .otherwise(F.when((x0 + x1) / 2 <= width / 2, "body_left").otherwise("body_right"))
    )


def labelled(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("label", label(*(F.col(c) for c in ("text", "x0", "y0", "x1", "y1", "width", "height")))).withColumn("band", F.floor(F.col("y0") / 24))


def kept(blocks: DataFrame) -> DataFrame:
    """Without noise, captions, short blocks at the top and bottom edges, and slivers."""
    tight = text.compact(F.col("text"))
    letters = F.length(F.regexp_replace(tight, r"(?U)[^\p{L}\p{N}]", ""))
    noise = (F.length(tight) <= 2) | (letters == 0) | (letters / F.length(tight) < 0.2)
    edge = (F.col("height") > 0) & ((F.col("y1") < F.col("height") * 0.06) | (F.col("y0") > F.col("height") * 0.94)) & (F.length(F.trim("text")) < 120)
    thin = (F.col("x1") - F.col("x0") < F.greatest(F.lit(8.0), F.col("width") * 0.01)) | (F.col("y1") - F.col("y0") < 2.0)
    return blocks.where(~noise & ~F.lower(F.trim("text")).rlike(CAPTION) & ~edge & ~thin)


def columns(blocks: DataFrame) -> DataFrame:
    """page, blocks, two_columns, split of kept blocks: eight or more whose middles leave a wide gap at the median, with blocks on both sides in the upper part.

    Half of a page's blocks lie on either side by construction, so the sides are balanced. A page bounds its blocks.
    """
    middle = (F.col("x0") + F.col("x1")) / 2
    pages = blocks.groupBy("page").agg(F.array_sort(F.collect_list(middle)).alias("ms"), F.first("width").alias("width"), F.collect_list(F.when(F.col("y0") < F.when(F.col("height") > 0, F.col("height")).otherwise(F.lit(1200.0)) * 0.55, middle)).alias("top"), F.count("*").alias("blocks"))
    half = F.floor(F.col("blocks") / 2).cast("int")
    left, right = F.element_at("ms", F.greatest(half, F.lit(1))), F.element_at("ms", half + 1)
    split = (left + right) / 2
    told = pages.where("blocks > 0").select("page", "blocks", "width", "top", left.alias("left"), right.alias("right"), split.alias("split"))
    sides = (F.size("top") == 0) | (F.exists("top", lambda m: m <= F.col("split")) & F.exists("top", lambda m: m > F.col("split")))
    two = (F.col("blocks") >= 8) & (F.col("right") - F.col("left") >= F.greatest(F.lit(20.0), F.col("width") * 0.08)) & sides
    return told.select("page", "blocks", two.alias("two_columns"), F.when(two, F.col("split")).otherwise(0.0).alias("split"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """page, place, text of kept blocks: on pages of two columns the left before the right, each by bands of 24 and then from left to right; on others by height."""
    own = kept(blocks)
    told = own.join(columns(own), "page")
    side = F.when(F.col("two_columns") & ((F.col("x0") + F.col("x1")) / 2 > F.col("split")), 1).otherwise(0)
    band = F.when(F.col("two_columns"), F.floor(F.col("y0") / 24)).otherwise(0)
    order = Window.partitionBy("page").orderBy(side, band, "y0", "x0", "text")
    return told.select("page", F.row_number().over(order).alias("place"), F.trim("text").alias("text"))


def page_texts(blocks: DataFrame, tables: str = "linearize", notes: str = "append") -> DataFrame:
    """page, text, confidence and the count of each label: left and right body, tables, captions, footnotes, each in reading order; tables and notes may be 'drop'."""
    own = labelled(blocks).where(F.trim("text") != "")
    rank = F.expr(f"CASE label WHEN 'body_left' THEN 1 WHEN 'body_right' THEN 2 WHEN 'table' THEN {3 if tables != 'drop' else 'NULL'} WHEN 'caption' THEN 4 WHEN 'footnote' THEN {5 if notes != 'drop' else 'NULL'} END")
    body = F.when(F.col("label").isin("table", "footnote"), text.compact(F.col("text"))).otherwise(F.trim("text"))
    wide = F.col("label").isin("body_left", "body_right") & (F.col("x0") < F.col("width") * 0.35) & (F.col("x1") > F.col("width") * 0.65)
    n = lambda *names: F.count_if(F.col("label").isin(*names))
    pages = own.withColumn("turn", rank).groupBy("page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("turn").isNotNull(), F.struct("turn", "band", "y0", "x0", body.alias("t"))))), lambda x: x.t), "\n").alias("text"),
        F.count("*").alias("total"), n("body_left", "body_right").alias("body"), n("table").alias("tables"), n("footnote").alias("footnotes"), n("caption").alias("captions"), n("header", "footer").alias("edges"), F.count_if(wide).alias("wide"),
    )
    share = lambda *cs: sum((F.col(c) for c in cs[1:]), F.col(cs[0])) / F.col("total")
    score = 0.45 * share("body") + 0.20 * (1 - share("edges")) + 0.20 * F.least(F.lit(1.0), F.length(text.compact(F.col("text"))) / 2200) + 0.15 * (1 - F.least(F.lit(0.9), share("tables", "footnotes", "captions")))
    return pages.select("page", "text", F.round(scores.clamp(score * (1 - F.least(F.lit(0.4), share("wide")))), 9).alias("confidence"), "body", "tables", "footnotes", "captions", "edges")


def region_counts(pages: DataFrame) -> DataFrame:
    """label, n: the sums of a map of counts over pages(counts map<string,int>)."""
    return pages.select(F.explode("counts").alias("label", "n")).groupBy("label").agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n"))
