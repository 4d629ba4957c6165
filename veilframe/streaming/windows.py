"""Windowed private releases over a stream.

A window is released once, when the watermark has closed it: the stateful aggregation appends only
closed windows, and each micro-batch charges the ledger for the windows it holds before it writes them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe.functions.noise import SecureNoise
from veilframe.operators.dp import noisy_count, noisy_sum
from veilframe.plans.budget import BudgetAccountant
from veilframe.plans.storage import persisted, shared_dir


def windowed(events: DataFrame, time: str, window: str, value: str, lower: float, upper: float, lateness: str = "10 minutes", slide: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(window_start, window_end, keys..., n, s) of events, late ones beyond the watermark dropped."""
    clipped = F.greatest(F.lit(float(lower)), F.least(F.lit(float(upper)), F.coalesce(F.col(value).cast("double"), F.lit(0.0))))
    w = F.window(time, window, slide) if slide else F.window(time, window)
    got = events.withWatermark(time, lateness).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(clipped).alias("s"))
    return got.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "s")


def noised(windows: DataFrame, epsilon: float, sensitivity: float, noise: SecureNoise | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Half the budget of a window for its count, half for its sum."""
    noise = noise or SecureNoise()
    key = F.concat_ws("/", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"), *(F.col(k).cast("string") for k in keys))
    return windows.select(
        "window_start", "window_end", *keys,
        noisy_count(F.col("n"), epsilon / 2, noise=noise, key=F.concat(key, F.lit("#n"))).alias("count"),
        noisy_sum(F.col("s"), sensitivity, epsilon / 2, noise=noise, key=F.concat(key, F.lit("#s"))).alias("sum"),
    )


def release_stream(windows: DataFrame, accountant: BudgetAccountant, epsilon: float, sensitivity: float, sink: Callable[[DataFrame, int], None], keys: tuple[str, ...] = (), noise: SecureNoise | None = None, checkpoint: str | None = None, overlap: int = 1) -> StreamingQuery:
    """Start the query: for each micro-batch with closed windows, spend, draw, write, hand the result to
    ``sink``. A batch that is run again, as after a restart, is found by its number: what was drawn for it goes to
    the sink again, without another charge or draw. Tumbling windows are disjoint and compose in parallel, so a batch costs epsilon once; with
    sliding windows an event is in ``overlap`` (window / slide) of them and costs as many times."""

    where = checkpoint or f"{shared_dir(windows.sparkSession)}/veilframe/stream-{accountant.namespace}"

    def each(batch: DataFrame, number: int) -> None:
        spark, path = batch.sparkSession, f"{where}/released/{number}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            closed = persisted(batch, "closed")
            if closed.isEmpty():
                return
            accountant.spend(epsilon * overlap)
            noised(closed, epsilon, sensitivity, noise, keys).write.mode("overwrite").parquet(path)
        sink(spark.read.parquet(path), number)

    return windows.writeStream.outputMode("append").option("checkpointLocation", where).foreachBatch(each).trigger(availableNow=True).start()
