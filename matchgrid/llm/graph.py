"""Connected components as rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    """Tells edge sets apart: their number, the exclusive or of their hashes, and a sum of 28 bits of each (which 2**35 edges don't overflow)."""
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.bitwiseAND(0xFFFFFFF))).first()
    return tuple(x or 0 for x in row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the smallest node that it reaches.

    Alternates the large-star and small-star steps: each node links its larger
    neighbours, then all its neighbours, to its smallest one, until nothing
    changes. Rounds grow with the logarithm of a component's diameter, minima
    are combined before they are shuffled, and joins are ones whose large
    partitions Spark can split, so a huge component needs no huge task.
    Links may repeat, link a node to itself (which names the node) or hold
    nulls (which are left out); without links there are no rows.
    """
    links = links.where("a is not null and b is not null")
    alone = links.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        small = large.join(least, "u").select(F.explode(pairs).alias("e")).select("e.*").where("u <> v").distinct()
        edges = written(small, "small-star")
        if (now := _state(edges)) == state:
            break
        state = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("root").alias("root"))
