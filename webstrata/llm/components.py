"""Connected components of a link table, by alternating stars; nothing is gathered on the driver but two counts a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.common import drop, written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """A written table (node, root) for every node of a link table (a, b); root is the smallest node that links reach.

    Each round hangs every larger neighbour on a node's smallest one, then every
    smaller-or-equal one, until all edges lead to roots; rounds grow with the logarithm of
    the longest chain. Hubs are met by partial aggregation and joins that Spark
    can split, never by gathering a node's neighbours. Self-links and repeats are harmless.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(most_rounds):
        if settled(edges):
            roots = written(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
            drop(edges)
            return roots
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u move to u's smallest
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        # small star: neighbours below u, and u, move to the smallest of them
        least = moved.groupBy("u").agg(F.min("v").alias("m"))
        hung = moved.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, written(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(last)
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")


def settled(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most, and none from a node that others hang on."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down + up > 1").isEmpty()
