"""Connected components of a table of links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.session import materialize


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component): every node that has a link, with the smallest node of its component.

    Links of a node with itself, repeated links and links with a null end change nothing. Each round
    ties the larger neighbours of a node to its smallest one, then the smaller ones; the number of
    rounds grows with the logarithm of the longest chain. A round is written to the shared folder, so
    that the loss of an executor repeats one round at most. A node with very many links is a hot key of
    a join only, where Spark splits it; its minimum is found by an aggregate that combines first.
    """
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u > v").distinct()
    edges = materialize(edges, "links")
    sign = _sign(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, sign = sign, _sign(edges)
        if sign == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
