"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltrail.session import materialize

MAX_ROUNDS = 60  # rounds grow with the logarithm of the longest path; more means an error


def components(links: DataFrame) -> DataFrame:
    """`id`, `component` (the smallest id reachable) of every id in `links`(a, b), two bigint columns.

    Each round points neighbours at the smallest id around them, first the larger ones, then the
    smaller ones. All steps are minima and joins on ids, so a node with many links is summed before
    the shuffle. Links may repeat, stand in either direction or join an id with itself.
    """
    tall = links.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = materialize(tall.where("u <> v").distinct(), "edges")
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        edges = materialize(_small_star(_large_star(edges)), "edges")
        new = _state(edges)
        if new == state:
            ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return ids.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        state = new
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).head())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is linked with the smallest node around u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))  # u's neighbours below it
    up = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))  # u's neighbours above it
    return up.join(least, "u", "left").select(F.col("w").alias("u"), F.coalesce("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its neighbours below it are linked with the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
