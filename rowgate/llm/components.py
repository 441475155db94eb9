"""Connected components by alternating stars, with nothing on the driver but two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgate.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link: root is the smallest node that can be reached.

    Links whose ends are equal or null are ignored, so a node that has no other link is not in the result; an empty
    table gives an empty result. Rounds go on until the stars no longer change, each from a table in the shared folder.
    A node's links are aggregated before they are shuffled and never gathered."""
    scratch = Scratch(links.sparkSession, "components")
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    edges = scratch.table(edges, keep=False)
    state = None
    while True:
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first()
        if now == state or not now[0]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
                edges.select("lo", "lo").distinct()
            )
        state = now
        edges = scratch.table(_small_star(_large_star(edges)), keep=False)
        scratch.drop(keep_last=1)
