"""Connected components of a link table, as rounds of contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardweir.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links(a, b)`` of longs -> ``(node, comp)`` for every node that occurs; comp: its smallest node.

    In each round every node points to the smallest of itself and its neighbours, pointers are
    followed once more, and links between different targets make the next round's graph. Every node
    but the local minima goes away, so a few rounds do; the tables of past rounds are deleted. Loops
    and repeated links are allowed; no links give no rows.
    """
    edges = scratch.write(links.select("a", "b").distinct(), "edges")
    label = None
    while True:
        both = edges.selectExpr("inline(array(struct(a as u, b as v), struct(b as u, a as v)))")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        step = scratch.write(low, "step")
        next_hop = step.select(F.col("u").alias("m"), F.col("m").alias("m2"))
        step2 = scratch.write(step.join(next_hop, "m").select("u", F.col("m2").alias("m")), "hop")
        to_a, to_b = step2.select(F.col("u").alias("a"), F.col("m").alias("x")), step2.select(F.col("u").alias("b"), F.col("m").alias("y"))
        rest = edges.join(to_a, "a").join(to_b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if label is None:
            new = scratch.write(step2.select(F.col("u").alias("node"), F.col("m").alias("comp")), "label")
        else:
            moved = step2.select(F.col("u").alias("comp"), F.col("m").alias("to"))
            new = scratch.write(label.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "label")
            scratch.drop(label)
        label = new
        rest = scratch.write(rest, "edges")
        scratch.drop(edges, step, step2)
        edges = rest
        if edges.isEmpty():
            scratch.drop(edges)
            return label
