"""Connected components of a link table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequilt.runtime import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node with a link, from long columns ``u`` and ``v``.

    Each round hangs the larger neighbours of a node onto the smallest one, then
    the smaller ones likewise; the rounds, about as many as the logarithm of the
    longest chain, end when a round changes nothing. Every round is written to
    the shared folder, so lineage stays short. Only a count and a checksum of the
    links reach the driver. Loops and repeated links are harmless.
    """
    edges = materialize(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    before = _mark(edges)
    while before[0]:
        edges = materialize(_small_star(_large_star(edges)), "links")
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    edges = edges.where("u <> v")
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
