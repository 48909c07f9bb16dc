"""Connected components of a link table, by contraction towards smaller nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links (a, b); comp is the component's smallest node.

    Each round sends every node to the smallest node among itself and its neighbours, and on to where that one goes.
    Links are then drawn between the places the nodes have gone to; links whose ends have met are dropped and equal
    ones merge, so the links of a hub are gone after one round and a chain shrinks to a fraction. The smallest node
    of a component never moves, so it is where all of them end. Tables live in the shared folder; only whether links
    are left reaches the driver.
    """
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = None
    while labels is None or not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("a").alias("near")).union(edges.select("b", "a"))
        step = materialize(ends.groupBy("node").agg(F.min("near").alias("to")))
        onward = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        step = materialize(step.join(onward, "to").select("node", F.col("further").alias("to")))
        at_a = step.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        at_b = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(at_a, "a").join(at_b, "b").where("ta <> tb")
        edges = materialize(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        if labels is None:
            labels = step.select("node", F.col("to").alias("comp"))
        else:
            gone = step.select(F.col("node").alias("comp"), "to")
            labels = materialize(labels.join(gone, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
    return labels
