"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import forget, hot_join, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: neighbours move to the least node near them; hubs tell theirs by broadcast."""
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
    moved = hot_join(near, least, "a", 2 * edges.count())
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(a, b): each node that has an edge, but the least of its component, with that least node.

    edges: columns a and b of one orderable type; loops, repeats and either direction are allowed,
    rows with a null are left out. Nodes without an edge aren't returned. No edges: no rows. Each
    round is written to the shared folder; nothing but two numbers a round comes to the driver.
    """
    now = edges.dropna().where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, "edges")
    before = _print_of(now)
    while before[0]:
        half = written(_stars(now, True), "large-stars")
        old, now = now, written(_stars(half, False), "stars")
        forget(half, old)
        after = _print_of(now)
        if after == before:
            break
        before = after
    return now
