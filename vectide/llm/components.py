"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vectide.session import cut_lineage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links`(a, b) but the roots themselves; root is the smallest node
    that can be reached.

    Each round hangs all larger neighbours of a node, then all smaller ones, on its smallest neighbour.
    Minima are partial aggregates and the joins are plain equi-joins, so a node with very many links is
    split by AQE; the number of rounds grows with the logarithm of the longest chain. Every round ends
    in a reliable checkpoint. Nulls and loops are left out; an empty table gives an empty result.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    edges = cut_lineage(
        links.filter(F.col("a") != F.col("b")).select(high.alias("a"), low.alias("b")).distinct())
    before = _mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
            F.col("m").alias("b")).distinct()
        edges = cut_lineage(small)
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
