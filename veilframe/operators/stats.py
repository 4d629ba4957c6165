"""Load statistics: backend picks, latency summaries and order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.plans.storage import persisted


def round_robin(i: Column, nodes: int) -> Column:
    """The node of the i-th request. Least connections picks the same while nothing completes."""
    return F.pmod(i, F.lit(nodes)).cast("int")


def random_node(nodes: int, seed: int | None = None) -> Column:
    return F.floor(F.rand(seed) * nodes).cast("int")


def least_connections(open_per_node: list[int]) -> int:
    """The node with the fewest open connections, the lowest if several."""
    return min(range(len(open_per_node)), key=lambda i: (open_per_node[i], i))


def node_stats(df: DataFrame, node: str, latency: str, ok: str) -> DataFrame:
    """(node, count, ok, fail, avg_ms, min_ms, max_ms), rounded to 2."""
    good = F.sum(F.col(ok).cast("long"))
    return df.groupBy(F.col(node).alias("node")).agg(F.count("*").alias("count"), good.alias("ok"), (F.count("*") - good).alias("fail"), *(F.round(f(latency), 2).alias(f"{n}_ms") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))))


def concurrency_stats(df: DataFrame, latency: str, seconds: float) -> DataFrame:
    """(n, qps, avg_ms, min_ms, max_ms, p50, p95, p99); percentiles interpolate between the two ranks next to
    them, which are found by counting (``ranked_values``)."""
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    place = {p: (F.col("n") - 1) * s for p, s in shares.items()}
    ranks = ranked_values(df, latency, F.array_distinct(F.flatten(F.array(*(F.array(F.floor(x), F.ceil(x)) for x in place.values())))))
    found = ranks.agg(F.map_from_entries(F.collect_list(F.struct("rank", F.col("value").cast("double").alias("value")))).alias("at"))  # at most six
    sums = df.agg(F.count(latency).alias("n"), *(F.round(f(latency), 2).alias(f"{n}_ms") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))))
    value = lambda x: F.element_at("at", x)
    between = {p: F.when(F.col("n") > 0, value(F.floor(x)) + (x - F.floor(x)) * (value(F.ceil(x)) - value(F.floor(x)))) for p, x in place.items()}
    got = sums.unionByName(found, allowMissingColumns=True).agg(*(F.first(c, ignorenulls=True).alias(c) for c in (*sums.columns, "at")))
    return got.select("n", F.round(F.col("n") / seconds, 2).alias("qps"), "avg_ms", "min_ms", "max_ms", *(F.round(c, 2).alias(p) for p, c in between.items()))


def ranked_values(df: DataFrame, column: str, ranks: Column) -> DataFrame:
    """(rank, value) of the wanted 0-based ranks of a column, exactly, by counting.

    ``ranks``: array of ranks as an expression of ``n``, the number of values. Values are first counted
    (partial aggregation), so the running total goes over distinct values laid out in ranges: each range
    is totalled on its own and shifted by the ranges before it; nothing is sorted in one task.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("c"))
    spread = counts.repartitionByRange("value").withColumn("part", F.spark_partition_id())
    spread = persisted(spread.withColumn("upto", F.sum("c").over(Window.partitionBy("part").orderBy("value"))), "ranks")
    parts = spread.groupBy("part").agg(F.max("upto").alias("total"))
    shift = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"), F.sum("total").over(Window.partitionBy()).alias("n"))
    placed = spread.join(F.broadcast(shift), "part").withColumn("last", F.col("before") + F.col("upto")).withColumn("first", F.col("last") - F.col("c"))
    return placed.select("value", "first", "last", F.explode(ranks).alias("rank")).filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))).select("rank", "value")


def bench_percentiles(df: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(share, value): the value at index int(n * share) of the sorted list."""
    ranks = F.array(*(F.least(F.floor(F.col("n") * s), F.col("n") - 1) for s in shares))
    got = ranked_values(df, column, F.array_distinct(ranks))
    n = df.filter(F.col(column).isNotNull()).agg(F.count("*").alias("n"))
    wanted = n.select(F.explode(F.array(*(F.struct(F.lit(s).alias("share"), F.least(F.floor(F.col("n") * s), F.col("n") - 1).alias("rank")) for s in shares))).alias("w")).select("w.share", "w.rank")
    return wanted.join(got, "rank").select("share", "value")
