"""Local differential privacy: randomised response and unbiased estimates. Spends no central budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.noise import SecureNoise
from veilframe.functions.text import let

SECURE = SecureNoise()


def _keep(epsilon: float, k: int = 2) -> float:
    e = math.exp(epsilon)
    return e / (e + k - 1)


def perturb_binary(value: Column, epsilon: float, key: Column, noise: SecureNoise = SECURE) -> Column:
    """The value with probability e^eps / (1 + e^eps), else 1 - value."""
    return F.when(noise.uniform(key) < _keep(epsilon), value).otherwise(1 - value)


def perturb_categorical(value: Column, categories: list[str], epsilon: float, key: Column, noise: SecureNoise = SECURE) -> Column:
    """The value with probability e^eps / (e^eps + k - 1), else one of the other categories, evenly; a
    value outside the categories is replaced by any of them. Of duplicate categories the last counts."""
    k = len(categories)
    if k <= 1:
        return value
    at = F.lit(None).cast("int")
    for i, c in enumerate(categories):  # later duplicates overwrite earlier ones
        at = F.when(value == c, F.lit(i)).otherwise(at)
    pick = noise.uniform(F.concat(key, F.lit("#other")))
    index = lambda n: F.least(F.floor(pick * n).cast("int"), F.lit(n - 1))
    # The index of another category is drawn once and then passes over the own one.
    other = F.when(at.isNull(), index(k)).otherwise(let(index(k - 1), lambda i: i + (i >= at).cast("int")))
    return F.when(noise.uniform(key) < _keep(epsilon, k), value).otherwise(F.element_at(F.array(*map(F.lit, categories)), other + 1))


def estimate_binary(df: DataFrame, column: str, epsilon: float) -> DataFrame:
    """(frequency): the estimated share of ones among reported values."""
    p = _keep(epsilon)
    share = F.avg((F.col(column) == 1).cast("double"))
    estimate = F.lit(0.5) if abs(2 * p - 1) < 1e-10 else (F.col("f") - (1 - p)) / (2 * p - 1)
    return df.agg(share.alias("f")).select(F.when(F.col("f").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate))).alias("frequency"))


def estimate_histogram(df: DataFrame, column: str, categories: list[str], epsilon: float) -> DataFrame:
    """(bucket, frequency) of the categories, clamped and normalised to sum 1 if anything is left;
    reports outside the categories stay in the total."""
    names = list(dict.fromkeys(categories))
    spark, k = df.sparkSession, len(categories)
    domain = spark.createDataFrame([(i, c) for i, c in enumerate(names)], "i int, bucket string")
    if k <= 1:
        return domain.select("bucket", F.lit(1.0).alias("frequency"))
    p = _keep(epsilon, k)
    q = (1 - p) / (k - 1)
    # One row a category after the first aggregation; the total is the sum over all values.
    counts = df.groupBy(F.col(column).cast("string").alias("bucket")).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    mine = counts.filter(F.col("bucket").isin(names))
    joined = domain.join(F.broadcast(mine), "bucket", "left").join(F.broadcast(total))
    share = F.coalesce("n", F.lit(0)) / F.col("total")
    raw = F.lit(1.0 / k) if abs(p - q) < 1e-10 else F.greatest(F.lit(0.0), F.least(F.lit(1.0), (share - q) / (p - q)))
    joined = joined.select("bucket", F.when(F.col("total") == 0, 0.0).otherwise(raw).alias("e"))
    everything = F.sum("e").over(Window.partitionBy())
    return joined.select("bucket", F.when(everything > 0, F.col("e") / everything).otherwise(F.col("e")).alias("frequency"))
