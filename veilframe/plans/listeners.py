"""Metrics that collect themselves: counts ride along with jobs and micro-batches and are added when these end.

``counted`` marks a DataFrame, of a batch or a stream, so that whatever job reads it counts on the way. ``listen``
registers two listeners of the session once; from then on a job that ends well adds what it counted, one that fails adds
nothing, and a micro-batch adds once by its number in its query, however often it is run.

Events arrive after the job that they tell of: ``settled`` waits for those on their way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.java_gateway import ensure_callback_server_started
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from veilframe.plans.params import Metrics

PREFIX = "veilframe:"


def counted(df: DataFrame, name: str, **counts: Column) -> DataFrame:
    """``df``, which counts as it is read: ``counts`` are aggregates, added to the counters of these names. ``name``
    is told apart from other marked DataFrames of one job."""
    if not counts:
        return df
    return df.observe(PREFIX + name, *(c.alias(k) for k, c in counts.items()))


def counted_fields(classified: DataFrame, rules: list[str], name: str = "classified") -> DataFrame:
    """Classified fields that count themselves, reviews and the hits of ``rules``."""

    def of(rule: str) -> Callable[[Column], Column]:
        return lambda t: t["rule_id"] == rule

    hits = {f"rule:{r}": F.sum(F.size(F.filter("tags", of(r)))) for r in rules}
    return counted(classified, name, fields=F.count(F.lit(1)), needs_review=F.count_if(F.col("needs_review")), **hits)


class _Jobs:
    """What batch jobs have counted. Micro-batches are jobs too, but tell of themselves."""

    def __init__(self, metrics: Metrics):
        self.metrics = metrics

    def onSuccess(self, function, execution, nanoseconds):  # noqa: N802
        if execution.getClass().getSimpleName() == "IncrementalExecution":
            return
        found = execution.observedMetrics()
        names = found.keysIterator()
        while names.hasNext():
            name = names.next()
            if name.startswith(PREFIX):
                row = found.apply(name)
                for i, field in enumerate(row.schema().fieldNames()):
                    self.metrics.count(field, row.get(i) or 0)
                self.metrics.timed(name, nanoseconds / 1e9)

    def onFailure(self, function, execution, exception):  # noqa: N802
        self.metrics.count("failed_jobs")

    class Java:
        implements = ["org.apache.spark.sql.util.QueryExecutionListener"]


class _Batches(StreamingQueryListener):
    """What micro-batches have counted, each by its number once."""

    def __init__(self, metrics: Metrics):
        self.metrics, self.last = metrics, {}

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        found = {k: row for k, row in p.observedMetrics.items() if k.startswith(PREFIX)}
        if not found or p.batchId <= self.last.get(p.id, -1):
            return
        self.last[p.id] = p.batchId
        for row in found.values():
            for field, n in row.asDict().items():
                self.metrics.count(field, n or 0)

    def onQueryTerminated(self, event):  # noqa: N802
        if event.exception:
            self.metrics.count("failed_streams")


def listen(spark: SparkSession, metrics: Metrics) -> Callable[[], None]:
    """Start adding what marked DataFrames count to ``metrics``; the result ends it."""
    ensure_callback_server_started(SparkContext._gateway)
    jobs, batches = _Jobs(metrics), _Batches(metrics)
    manager = spark._jsparkSession.listenerManager()
    manager.register(jobs)
    spark.streams.addListener(batches)

    def stop() -> None:
        settled(spark)
        manager.unregister(jobs)
        spark.streams.removeListener(batches)

    return stop


def settled(spark: SparkSession, milliseconds: int = 30_000) -> None:
    """Wait until the events of ended jobs have been heard."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(milliseconds)
