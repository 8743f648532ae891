"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): every node that has an edge, with the least node of its component.

    Each round hangs a node's larger neighbours on its least neighbour, then its smaller
    ones; trees get flatter until all edges point at the least node. Only a minimum is kept
    per node, so a node with very many edges is no burden. Self-edges and repeated edges do
    no harm; an empty table gives an empty result."""
    spark = edges.sparkSession
    now = materialise(_ordered(edges.select("a", "b")), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, F.col("b") > F.col("a"))
        small = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now = materialise(_ordered(_star(small, F.lit(True), own=True)), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, the larger node first."""
    return edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, moved, own: bool = False) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("low"))
    least = least.select("hub", F.least("hub", "low").alias("low"))
    hung = edges.filter(moved).join(least, F.col("a") == F.col("hub")).select(
        F.col("b").alias("a"), F.col("low").alias("b"))
    if own:
        hung = hung.unionByName(least.select(F.col("hub").alias("a"), F.col("low").alias("b")))
    return hung


def _mark(edges: DataFrame):
    """Changes whenever the set of edges does."""
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")),
                     F.sum(F.shiftright(F.xxhash64("b", "a"), 20))).first()
