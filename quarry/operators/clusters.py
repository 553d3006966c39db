"""Evidence clusters: single linkage by cosine similarity within a pack of evidence, and whether a cluster's members agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scores

#: Opposite directions.
DIRECTIONS = (
    ("increase", "decrease"),
    ("increased", "decreased"),
    ("higher", "lower"),
    ("more", "less"),
    ("improve", "worsen"),
    ("better", "worse"),
    ("gain", "loss"),
    ("positive", "negative"),
    ("faster", "slower"),
    ("larger", "smaller"),
)


def lower_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))


def opposed(a: Column, b: Column, pairs=DIRECTIONS) -> Column:
    """Whether one token set has a direction and the other its opposite."""
    has = lambda t, w: F.array_contains(t, w)
    out = F.lit(False)
    for up, down in pairs:
        out = out | (has(a, up) & has(b, down)) | (has(a, down) & has(b, up))
    return out


def disagreement(a: Column, b: Column) -> Column:
    """Of token sets: 0 under a Jaccard of 0.25; else 0.5 for negation in one only and 0.35 for opposite directions."""
    negated = lambda t: F.arrays_overlap(t, F.array(*[F.lit(w) for w in scores.NEGATIONS]))
    shared = F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))
    score = F.when(negated(a) != negated(b), 0.5).otherwise(0.0) + F.when(opposed(a, b), 0.35).otherwise(0.0)
    return F.when(shared < 0.25, 0.0).otherwise(F.least(F.lit(1.0), score))


def clusters(evidence: DataFrame, similarity: float = 0.55, conflict: float = 0.40, most: int = 20) -> DataFrame:
    """pack, place, cluster, label, consensus, items, papers, snippet_id, of evidence(pack, rank, snippet_id, paper_id, score, text, vector).

    The most best-ranked items of a pack are clustered; vectors have unit length. A pack is a group of most items, so its
    pairs are bounded. cluster is the smallest rank of a cluster, snippet_id that of its best item, place the order:
    consensus, mixed, conflict, the larger first. Items with a null vector stay alone.
    """
    turn = F.row_number().over(Window.partitionBy("pack").orderBy("rank", "snippet_id"))
    items = evidence.withColumn("at", turn).where(F.col("at") <= most).select("pack", "at", "snippet_id", "paper_id", "score", lower_tokens(F.col("text")).alias("ts"), "vector")
    a, b = items.alias("a"), items.alias("b")
    pairs = a.join(b, (F.col("a.pack") == F.col("b.pack")) & (F.col("a.at") < F.col("b.at"))).select(
        F.col("a.pack").alias("pack"), F.col("a.at").alias("x"), F.col("b.at").alias("y"), F.coalesce(scores.dot(F.col("a.vector"), F.col("b.vector")), F.lit(-1.0)).alias("near"), disagreement(F.col("a.ts"), F.col("b.ts")).alias("apart")
    )
    links = pairs.where(F.col("near") >= similarity).groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("links"))
    # each link gives the members of its two clusters the smaller of their labels
    merge = lambda own, link: F.transform(own, lambda v: F.when(v == F.greatest(own[link.x - 1], own[link.y - 1]), F.least(own[link.x - 1], own[link.y - 1])).otherwise(v))
    labels = links.select("pack", F.aggregate("links", F.sequence(F.lit(1), F.lit(most)), merge).alias("own"))
    placed = items.join(labels, "pack", "left").select("pack", "at", "snippet_id", "paper_id", "score", F.coalesce(F.col("own")[F.col("at") - 1], F.col("at")).alias("cluster"))
    where = placed.select("pack", "at", "cluster")
    inside = pairs.join(where.withColumnRenamed("at", "x"), ["pack", "x"]).join(where.select("pack", F.col("at").alias("y"), F.col("cluster").alias("other")), ["pack", "y"]).where("cluster = other")
    agreed = inside.groupBy("pack", "cluster").agg(F.avg("near").alias("near"), F.avg("apart").alias("apart"))
    sizes = placed.groupBy("pack", "cluster").agg(F.count("*").alias("items"), F.countDistinct("paper_id").alias("papers"), F.min_by("snippet_id", F.struct(-F.col("score"), F.col("at"))).alias("snippet_id"))
    label = F.when(F.col("apart") >= conflict, "conflict").when(F.col("apart") >= conflict / 2, "mixed").otherwise("consensus")
    full = sizes.join(agreed, ["pack", "cluster"], "left").withColumn("label", label).withColumn("consensus", F.when(F.col("near").isNull(), 1.0).otherwise(F.round(scores.clamp(F.col("near") - F.col("apart")), 4)))
    order = Window.partitionBy("pack").orderBy(F.expr("CASE label WHEN 'consensus' THEN 0 WHEN 'mixed' THEN 1 ELSE 2 END"), F.desc("items"), "cluster")
    return full.select("pack", F.row_number().over(order).alias("place"), "cluster", "label", "consensus", "items", "papers", "snippet_id")


def summary(found: DataFrame) -> DataFrame:
    """pack, clusters, those of each label and those of several papers."""
    n = lambda label: F.count_if(F.col("label") == label).alias(label)
    return found.groupBy("pack").agg(F.count("*").alias("clusters"), n("consensus"), n("mixed"), n("conflict"), F.count_if(F.col("papers") > 1).alias("cross_document"))
