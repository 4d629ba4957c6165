import pytest
from pyspark.sql import functions as F

from veilframe.plans import classify, listeners
from veilframe.plans.params import Metrics


@pytest.fixture
def metrics(spark):
    m = Metrics()
    stop = listeners.listen(spark, m)
    yield m
    stop()


def test_jobs_add_what_they_counted(spark, metrics):
    c = classify.build("general-pii")
    df = spark.createDataFrame([(1, "13800138000"), (2, "none"), (3, "13800138001")], "id long, phone string")
    own = listeners.counted_fields(c.classify_fields(df, "id"), ["RULE_PII_PHONE", "RULE_PII_NAME"])
    assert own.count() == 3
    listeners.settled(spark)
    assert metrics.counters["fields"] == 3 and metrics.counters["rule:RULE_PII_PHONE"] == 2 and metrics.counters["rule:RULE_PII_NAME"] == 0
    own.collect()  # another job, counted too
    df.count()  # not marked
    listeners.settled(spark)
    assert metrics.counters["fields"] == 6
    two = listeners.counted(df, "a", seen=F.count(F.lit(1))).unionByName(listeners.counted(df.filter("id > 1"), "b", seen=F.count(F.lit(1)), most=F.max("id")))
    two.collect()
    listeners.settled(spark)
    assert metrics.counters["seen"] == 5 and metrics.counters["most"] == 3 and listeners.counted(df, "none") is df


def test_failed_jobs_add_nothing(spark, metrics):
    df = listeners.counted(spark.range(10), "r", rows=F.count(F.lit(1)))
    with pytest.raises(Exception, match="stop"):
        df.select(F.when(F.col("id") == 7, F.raise_error(F.lit("stop"))).otherwise(F.col("id"))).collect()
    listeners.settled(spark)
    assert metrics.counters["rows"] == 0 and metrics.counters["failed_jobs"] == 1


@pytest.mark.parametrize("sink", ["batch", "files"])
def test_micro_batches_count_once(spark, metrics, tmp_path, sink):
    """A batch that fails and is run again, and a restart after all is done."""
    source, state = tmp_path / "in", tmp_path / "state"
    spark.range(25).repartition(3).write.parquet(str(source))
    files = len(list(source.glob("*.parquet")))
    fail = [True]

    def each(batch, number):
        batch.write.mode("overwrite").parquet(str(tmp_path / f"out{number}"))
        if number == 1 and fail[0]:
            fail[0] = False
            raise ValueError("lost")

    def run():
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(source))
        writer = listeners.counted(stream, "s", rows=F.count(F.lit(1)), total=F.sum("id")).writeStream.option("checkpointLocation", str(state)).trigger(availableNow=True)
        return writer.foreachBatch(each).start() if sink == "batch" else writer.format("parquet").option("path", str(tmp_path / "out")).start()

    if sink == "batch":
        with pytest.raises(Exception, match="lost"):
            run().awaitTermination()
    for _ in range(2):
        run().awaitTermination()
    listeners.settled(spark)
    assert files > 1 and metrics.counters["rows"] == 25 and metrics.counters["total"] == 300
