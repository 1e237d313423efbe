"""Connected components of a graph given as an edge table, by repeated contraction.

In each round every node points to its smallest neighbour (or itself), pointers are followed
twice, and the edges are rewritten to the nodes reached; edges inside one node vanish. The
rounds end when no edge is left. Minima are summed up before they are shuffled, so a node
with very many edges is no bottleneck; nothing but a count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.llm.tables import settle


def _follow(pointers: DataFrame) -> DataFrame:
    further = pointers.select(F.col("node").alias("at"), F.col("to").alias("further"))
    return pointers.join(further, pointers["to"] == further["at"]).select("node", F.col("further").alias("to"))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of ``edges`` (``a``, ``b``)."""
    left = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    known = left.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    first = True
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("to"))
        pointers = settle(_follow(_follow(settle(smallest, "pointers"))), "pointers")
        if first:
            known = pointers.withColumnRenamed("to", "component")
        else:
            known = settle(known.join(pointers, known["component"] == pointers["node"], "left").select(known["node"], F.coalesce("to", "component").alias("component")), "components")
        to_a = pointers.select(F.col("node").alias("a"), F.col("to").alias("new_a"))
        to_b = pointers.select(F.col("node").alias("b"), F.col("to").alias("new_b"))
        moved = left.join(to_a, "a").join(to_b, "b").where("new_a <> new_b")
        left = settle(moved.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct(), "edges")
        first = False
    return known
