"""Connected components by contraction: nodes hook onto their least neighbour, edges are relabelled, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantrylens.llm.shared import saved


def connected(edges: DataFrame) -> DataFrame:
    """node and label of every node in ``edges`` (columns a, b); equal labels are one component.

    Names are hashes, so that along a path a round leaves about half of the nodes (a path named in
    order would lose one a round). All tables stay distributed; a node with very many edges is
    aggregated before the shuffle and its joins can be split.
    """
    left = saved(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("node"), F.col("a").alias("to")).union(left.select(F.col("b"), F.col("a")))
        hooks = saved(ends.groupBy("node").agg(F.min("to").alias("to")), "hooks")
        if labels is None:
            labels = hooks.select("node", F.col("to").alias("label"))
        else:
            moved = hooks.select(F.col("node").alias("label"), "to")
            labels = saved(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        a = hooks.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = hooks.select(F.col("node").alias("b"), F.col("to").alias("y"))
        renamed = left.join(a, "a").join(b, "b").where(F.col("x") != F.col("y"))
        left = saved(renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("a").alias("label")).where("false")
    return labels
