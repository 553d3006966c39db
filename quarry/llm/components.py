"""Connected components of links by repeated contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise


def components(links: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = materialise) -> DataFrame:
    """node, component of links(a, b): the smallest node that can be reached. Nodes without links aren't returned.

    keep(df, name) writes a table of a round and reads it back; a Scratch's removes them when its block ends.

    In each round every node goes to the first of itself and its neighbours in an order drawn for the round, and the
    links are carried over to where their ends went. The links shrink by a constant share a round on average, chains
    and stars alike. A node's neighbours are only ever reduced to one, so a node with very many is no large group.
    """
    spark = links.sparkSession
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges, labels, turn = keep(both, "links"), None, 0
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        first = edges.groupBy("a").agg(F.min(rank("b")).alias("m"))
        went = keep(first.select(F.col("a").alias("node"), F.least(rank("a"), "m")["n"].alias("to")), "went")
        if labels is None:
            labels = went.select("node", F.col("to").alias("label"))
        else:
            moved = went.select(F.col("node").alias("label"), "to")
            labels = keep(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        carried = edges.join(went.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(went.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = keep(carried.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        turn += 1
    if labels is None:
        return spark.createDataFrame([], "node long, component long")
    return labels.join(labels.groupBy("label").agg(F.min("node").alias("component")), "label").select("node", "component")
