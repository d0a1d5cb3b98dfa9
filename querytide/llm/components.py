"""Connected components of a table of links."""

from pyspark.sql import DataFrame, functions as F

from ..functions.stage import staged, unstage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours of u (larger ones, or smaller ones and u itself) link to u's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v <= u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.where("m < u").select("u", F.col("m").alias("v"))
        out = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (least node of its component) of every node in a link (columns u, v).

    Alternating large-star and small-star steps: the number of rounds grows with the logarithm of the longest
    chain, and links stay in files. Loops and repeats are dropped; no links give no rows.
    """
    edges = staged(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        starred = staged(_star(_star(edges, True), False))
        changed = starred.select("u", "v").exceptAll(edges.select("u", "v")).isEmpty() and edges.exceptAll(starred).isEmpty()
        unstage(edges)
        edges = starred
        if changed:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
