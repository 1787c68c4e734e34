"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.llm.common import saved


def _star(pairs: DataFrame, both: bool) -> DataFrame:
    """Link every neighbour of a node to the node's smallest neighbour: those above it (large) or not above it (small)."""
    if both:
        near = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = pairs
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    linked = near.join(least, near["u"] == least["c"])
    moved = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if both else \
        linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every id in the links (a, b); ids in no link are absent.

    Minima are pre-aggregated and the joins have unique keys on one side, so Spark can split a node with very many links.
    The rounds end when a round changes nothing; each is written to the shared folder.
    """
    pairs = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        pairs = saved(_star(_star(pairs, True), False), "links")
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
