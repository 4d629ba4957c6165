import json

import pytest
from pyspark.sql import functions as F

from veilframe.functions.noise import HashNoise
from veilframe.operators import stats
from veilframe.plans import pipeline
from veilframe.plans.budget import BudgetAccountant, BudgetExhausted, PrivacyError
from veilframe.sources import ingest
from veilframe.streaming import windows


def test_csv(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_bytes("﻿email,phone,name\na@b.c,13800138000,Bob\nx@y.z\n\"q\"\"q\",1,\"two\nlines\",extra\n".encode())
    got = [tuple(r) for r in ingest.read_csv(spark, str(f)).collect()]
    assert got == [("a@b.c", "13800138000", "Bob"), ("x@y.z", "", ""), ('q"q', "1", "two\nlines")]
    assert ingest.process_file(spark, str(f), "mask_dataframe").first()["email"] == "a***@b.c"
    with pytest.raises(PrivacyError):
        ingest.process_file(spark, "x.txt", "mask_dataframe")
    with pytest.raises(PrivacyError):
        ingest.process_file(spark, str(f), "k_anonymize")
    with pytest.raises(PrivacyError):
        ingest.process_file(spark, str(f), "mask_dataframe", limit=50)
    big = tmp_path / "big.csv"
    big.write_bytes(b"name\n" + b"Bob\n" * (3 << 20))
    with pytest.raises(PrivacyError):
        ingest.process_file(spark, str(big), "mask_dataframe")
    got = pipeline.run_file(spark, str(f), str(tmp_path / "out"), "records")
    assert {r["name"] for r in got.collect()} >= {"B**b"}
    with pytest.raises(PrivacyError):
        pipeline.run_file(spark, str(f), str(tmp_path / "none"), "other")


def test_json(spark, tmp_path):
    f = tmp_path / "a.json"
    f.write_text(json.dumps([{"b": 1.0, "a": "x", "ok": True}, {"b": 2.5, "n": {"k": [1]}, "big": 12345678901}]))
    rows = [r.asDict() for r in ingest.read_json(spark, str(f)).collect()]
    assert rows[0] == {"a": "x", "b": "1", "big": "", "n": "", "ok": "true"}
    assert rows[1] == {"a": "", "b": "2.5", "big": "12345678901", "n": '{"k":[1]}', "ok": ""}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    for kind in ("parquet", "orc", "json", "csv"):
        ingest.write(df, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).collect() == df.collect()
    assert ingest.read_csv(spark, str(tmp_path / "csv")).collect()[0]["s"] == "a"


def test_order_statistics(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 1, 9, 7, 7, 7, 3]] + [(None,)], "v double")
    want = sorted([5, 1, 1, 9, 7, 7, 7, 3])
    got = {r["rank"]: r["value"] for r in stats.ranked_values(df, "v", F.sequence(F.lit(0), F.col("n") - 1)).collect()}
    assert got == dict(enumerate(want))
    assert {r["share"]: r["value"] for r in stats.bench_percentiles(df, "v").collect()} == {0.5: 7, 0.95: 9, 0.99: 9}
    assert stats.least_connections([2, 1, 1]) == 1
    assert spark.range(3).select(stats.random_node(2).alias("n")).filter("n between 0 and 1").count() == 3


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [(f"2024-01-01 00:0{i}:00", 1.0) for i in range(6)] + [("2024-01-01 02:00:00", 1.0)]
    spark.createDataFrame(rows, "ts string, v double").select(F.to_timestamp("ts").alias("ts"), "v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    BudgetAccountant.reset("stream")
    a = BudgetAccountant.instance("stream", 1.0, 0.0)
    events = spark.readStream.schema("ts timestamp, v double").parquet(str(tmp_path / "in"))
    out = []
    w = windows.windowed(events, "ts", "2 minutes", "v", 0, 1, "1 minute")
    q = windows.release_stream(w, a, 1.0, 1.0, lambda df, n: out.extend(df.orderBy("window_start").collect()), noise=HashNoise("x"), checkpoint=str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert len(out) == 3 and all(r["count"] >= 0 for r in out)
    assert a.remaining()["epsilon"] == 0
    with pytest.raises(BudgetExhausted):
        a.spend(0.1)
    assert a.refused == 1


def test_a_repeated_batch_is_neither_charged_nor_drawn_again(spark, tmp_path, monkeypatch):
    """The same micro-batch handed over twice, as after a restart."""
    held = []

    class Stream:  # hands out the function that a query would call
        sparkSession = spark

        def __getattr__(self, name):
            return lambda *a, **k: held.append(a[0]) or self if name == "foreachBatch" else self

    stream = Stream()
    stream.writeStream = stream
    BudgetAccountant.reset("again")
    a, out = BudgetAccountant.instance("again", 10.0, 0.0), []
    windows.release_stream(stream, a, 1.0, 1.0, lambda df, n: out.append((n, df.collect())), checkpoint=str(tmp_path))
    batch = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-01 00:02:00", 5, 3.0)], "window_start string, window_end string, n long, s double").withColumns({c: F.to_timestamp(c) for c in ("window_start", "window_end")})
    for number in (0, 0, 1):
        held[0](batch, number)
    held[0](batch.limit(0), 2)
    assert [n for n, _ in out] == [0, 0, 1] and out[0] == out[1] != out[2]
    assert a.remaining()["epsilon"] == 8


def test_latency_percentiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)] + [(None,)], "v double")
    r = stats.concurrency_stats(df, "v", 2.0).first()
    assert (r["n"], r["qps"], r["p50"], r["p95"], r["p99"]) == (4, 2.0, 2.5, 3.85, 3.97)
    assert stats.concurrency_stats(df.limit(0), "v", 2.0).first()["p50"] is None
