"""Connected components of a link table, by DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch

ROUNDS = 60


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """links(a, b), of any orderable type -> (node, root): root is the smallest node of node's component. Only nodes with a link to another are in it.

    Alternates the large-star and small-star steps: each turns the links of a node towards the smallest node it knows, until every node points straight
    to its root. Rounds grow as the logarithm of the longest path. A node with very many links costs partial aggregates, and its join is one that the
    adaptive planner splits. Each round is a written table, so a lost executor repeats one round at most. Nulls link nothing; loops and repeats add nothing.
    """
    edges = scratch.keep(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    for k in range(1, ROUNDS):
        # large star: every neighbour above a node links to the smallest neighbour (or the node)
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every neighbour below a node, and the node, link to the smallest one
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m")), F.struct(F.col("a").alias("x"), F.col("m")))).alias("e"))
        after = scratch.keep(small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        edges = after
        # a star forest: each node has one link, and no root has one
        n, nodes = after.agg(F.count("*"), F.countDistinct("a")).first()
        if n == nodes and after.join(after.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components: no end")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
