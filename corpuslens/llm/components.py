"""Connected components by contraction: in each round every node takes the smallest of its neighbours, follows that
node's own choice once, and the edges between the chosen nodes are all that is left for the next round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import save


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b); root is the smallest node of its component.

    Written tables end each round, so a lost executor repeats at most one of them. Rounds grow with the logarithm of
    the longest path. No row leaves the executors but the test whether edges are left.
    """
    edges = save(edges.where("a <> b").select("a", "b").distinct(), "edges")
    roots = None
    while True:
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("w")), F.struct(F.col("b").alias("u"), F.col("a").alias("w")))).alias("e"))
        step = save(both.groupBy("e.u").agg(F.least(F.col("u"), F.min("e.w")).alias("p")), "step")
        after = step.select(F.col("u").alias("p"), F.col("p").alias("q"))
        step = save(step.join(after, "p").select("u", F.col("q").alias("p")), "jump")
        if roots is None:
            roots = step.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            roots = roots.join(step, roots["root"] == step["u"], "left").select("node", F.coalesce("p", "root").alias("root"))
            roots = save(roots, "roots")
        a, b = step.select(F.col("u").alias("a"), F.col("p").alias("pa")), step.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        edges = edges.join(a, "a").join(b, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        edges = save(edges, "edges")
        if edges.isEmpty():
            return roots
