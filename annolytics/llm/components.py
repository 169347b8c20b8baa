"""Connected components of an edge table, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from annolytics.llm.tables import written


def components(edges: DataFrame, *, most_rounds: int = 100) -> DataFrame:
    """node, root for every node of edges (src, dst: long): root is the smallest node it reaches. Self-loops are allowed.

    Each round sends a node to its smallest neighbour, or that neighbour's, if smaller than itself, and then keeps only the edges
    between nodes that are still different, so edges inside a found group are read once. The smallest node of a component is sent
    nowhere, so when no edge is left every node has it as its root. Rounds grow with the logarithm of the longest path. Each
    round's edges and labels are written to the shared folder.
    """
    edges = written(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    labels = written(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    edges = edges.where("src <> dst")
    for _ in range(most_rounds):
        if edges.isEmpty():
            return labels
        # src < dst: only the larger end of an edge can move, and the smaller stays known as its own
        near = edges.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("to"))
        next_ = near.select(F.col("node").alias("to"), F.col("to").alias("further"))
        moves = written(near.join(next_, "to", "left").select("node", F.coalesce("further", "to").alias("to")), "moves")
        sent = lambda df, c: df.join(moves.select(F.col("node").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        moved = sent(sent(edges, "src"), "dst").where("src <> dst")
        edges = written(moved.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
        labels = written(sent(labels, "root").select("node", "root"), "labels")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
