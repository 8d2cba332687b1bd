"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webtables.llm.common import materialise
from webtables.operators.skew import join_summary


def components(links: DataFrame) -> DataFrame:
    """Node and component of every node that the links (a, b) touch.

    Each round points every node at its neighbour, or itself, of the lowest
    random priority and contracts the links accordingly, which shrinks any
    graph by a constant share, chains included. Nodes stay in tables: the
    driver only learns whether links are left. No links give no rows.
    """
    links = materialise(links.select("a", "b").filter("a <> b").distinct())
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = nodes.select("node", F.col("node").alias("component"))
    turn = 0
    while not links.isEmpty():
        turn += 1
        both = links.union(links.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("p"), F.col(c).alias("n"))
        low = both.groupBy("a").agg(F.min(rank("b")).alias("low"))
        parents = materialise(low.select("a", F.least("low", rank("a"))["n"].alias("parent")))
        near = parents.withColumnsRenamed({"parent": "parent_a"})
        far = parents.select(F.col("a").alias("b"), F.col("parent").alias("parent_b"))
        moved = join_summary(join_summary(links, near, "a", "b"), far, "b", "a")
        links = materialise(
            moved.select(F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).filter("a <> b").distinct()
        )
        step = parents.select(F.col("a").alias("component"), "parent")
        kept = labels.withColumn("_salt", F.lit(0)).join(
            step.withColumn("_salt", F.lit(0)), ["component", "_salt"], "left"
        )
        labels = materialise(kept.select("node", F.coalesce("parent", "component").alias("component")))
    return labels
