"""Connected components of a table of links, in rounds of two grouped steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    """``u`` with the least of itself and its neighbours; a hub's neighbours are reduced before they move."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each ``u`` has one edge and no ``v`` is a ``u``, so that each edge leads to its component's least node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    crossed = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(
        F.max((F.col("up") + F.col("down") > 1) & (F.col("up") > 0)))
    return not crossed.first()[0]


def connected_components(links: DataFrame) -> DataFrame:
    """``node, label`` for every end of a link ``a, b``; ``label`` is the least node of the component.

    Alternates the large-star and small-star steps until only stars are left. Every round is a table in
    the shared folder, so lineage stays short; no node's neighbours are gathered. The tables go with their
    last reader, but for the one that the result reads.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "edges")
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Repeats, at most one for each edge and direction, go with the next step's.
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v"), "large-star")
        discard(edges)
        hubs = _least(large)
        small = large.join(hubs, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            hubs.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, "small-star")
        discard(large)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
