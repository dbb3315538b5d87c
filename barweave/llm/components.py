"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.base import stored


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); a component's root is one of its nodes.

    Rounds of hooking and contraction: every node points to its smallest neighbour if
    that is smaller, pointers are followed to their ends, and the links between ends
    make the next, smaller graph.  Node ids should come in random order (hashes do), so
    that chains of pointers are short.  All steps are joins and map-side combined
    minima; a node with very many links is never gathered.
    """
    edges = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
    found = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), label)
        while True:
            up = to.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            jumped = stored(to.join(up, "root").select("node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("_moved")), label)
            to = jumped.drop("_moved")
            if jumped.where("_moved").isEmpty():
                break
        if found is None:
            found = to
        else:
            further = to.select(F.col("node").alias("root"), F.col("root").alias("_to"))
            found = stored(found.join(further, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), label)
        at_a, at_b = to.select(F.col("node").alias("a"), F.col("root").alias("_a")), to.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        between = edges.join(at_a, "a").join(at_b, "b").where("_a <> _b")
        edges = stored(between.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), label)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if found is None else found
