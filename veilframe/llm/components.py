"""Connected components of an edge table by alternating large-star and small-star steps.

Edges never leave the cluster. Each step hooks neighbours to minima found with a pre-aggregated
``groupBy``. What is known of a hub is broadcast to its edges (at most ``HUBS`` hubs), all other edges are joined
with it; a node's edges so never meet in one task. Steps are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import HUB, HUBS, discard, materialise


def _hooked(e: DataFrame, low: DataFrame, edges: int) -> DataFrame:
    """The edges (a, b) with ``m`` of (a, m, degree) in ``low``."""
    hub = F.broadcast(low.filter(F.col("degree") > max(HUB, 2 * edges // HUBS)).select("a", F.col("m").alias("hub_m")))
    # A hub's edges need no join; a key from their other end spreads them over the tasks of the one that follows.
    tagged = e.join(hub, "a", "left").withColumn("k", F.when(F.col("hub_m").isNull(), F.col("a")).otherwise(F.xxhash64("b")))
    return tagged.join(low.select(F.col("a").alias("k"), "m"), "k", "left").select("a", "b", F.coalesce("hub_m", "m").alias("m"))


def _large_star(e: DataFrame, edges: int) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("degree"))
    return _hooked(both.filter("b > a"), low, edges).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame, edges: int) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    hooked = _hooked(e, low, edges).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooked.unionByName(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b) longs. Returns (node, component) for every node that has an edge to another
    node; component is the smallest node reachable. No edges: no rows."""
    e = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "cc")
    seen, n = None, e.count()
    while True:
        step = materialise(_small_star(_large_star(e, n), n).filter("a > b").distinct(), "cc")
        n, total = step.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(e)
        e = step
        if not n or (n, total) == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = (n, total)
