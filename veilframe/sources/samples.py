"""A sample input for every operation of the client: what to try first, and what to test a deployment with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.client import PrivacyClient
from veilframe.operators import kanon

Run = Callable[[PrivacyClient, DataFrame], DataFrame]


@dataclass(frozen=True)
class Sample:
    schema: str
    rows: tuple
    run: Run

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)


def _one(name: str, build: Callable[[PrivacyClient], Column]) -> Run:
    return lambda c, df: df.select("*", build(c).alias(name))


_NUMBERS = ("v double", tuple((float(i),) for i in range(1, 6)))
_PAY = ("dept string, salary double", (("eng", 1000.0), ("eng", 3000.0), ("hr", 2000.0), ("sales", 4000.0)))
_TEAMS = ("dept string", (("eng",), ("hr",), ("eng",), ("sales",), ("eng",)))
_CHUNKS = ("c array<double>", (([1.0, 2.0],), ([3.0, 4.0],), ([5.0, 6.0],)))
_VECTORS = ("e array<double>", (([1.0, 2.0],), ([3.0, 4.0],), ([5.0, 6.0],)))
_COUNTS = ("bucket string, n long, s double", (("eng", 50, 1000.0), ("hr", 20, 400.0), ("sales", 30, 600.0)))
_PEOPLE = ("age int, zip string, gender string", ((30, "100000", "F"), (31, "100001", "F"), (32, "100002", "M"), (33, "100003", "M")))
_CONTACT = ("id long, name string, mobile_phone string, email string", ((1, "Alice", "13800138000", "alice@example.com"), (2, "Bob", "13900139000", "bob@example.com")))
_VISITS = ("id long, diagnosis string, phone string", ((1, "hiv positive", "13800138000"), (2, "flu", "13900139000")))
_DEPTS = ["eng", "hr", "sales", "marketing"]

CATALOGUE: dict[str, Sample] = {
    "mask": Sample("email string", (("alice@example.com",),), _one("masked", lambda c: c.mask("email", "email"))),
    "mask_batch": Sample("names array<string>, vals array<string>", ((["name", "phone"], ["Bob", "13800138000"]),), _one("masked", lambda c: c.mask_batch("names", "vals"))),
    "mask_record": Sample(*_CONTACT, lambda c, df: c.mask_record(df)),
    "mask_dataframe": Sample(*_CONTACT, lambda c, df: c.mask_dataframe(df)),
    "hash": Sample("v string", (("sensitive-value",),), _one("token", lambda c: c.hash("v", "demo-salt"))),
    "truncate": Sample("v string", (("2024-05-06",),), _one("short", lambda c: c.truncate("v", 4))),
    "redact": Sample("v string", (("a-long-secret",),), _one("redacted", lambda c: c.redact("v"))),
    "dp_count": Sample(*_NUMBERS, lambda c, df: c.dp_count(df, "v", 0.1)),
    "dp_sum": Sample(*_PAY, lambda c, df: c.dp_sum(df, "salary", 0.1, lower=0, upper=10_000)),
    "dp_mean": Sample(*_NUMBERS, lambda c, df: c.dp_mean(df, "v", 0.1, lower=0, upper=100)),
    "dp_histogram": Sample(*_TEAMS, lambda c, df: c.dp_histogram(df, "dept", _DEPTS, 0.1)),
    "dp_noisy_count": Sample(*_COUNTS, lambda c, df: c.dp_noisy_count(df, F.col("n"), F.col("bucket"), 0.1)),
    "dp_noisy_sum": Sample(*_COUNTS, lambda c, df: c.dp_noisy_sum(df, F.col("s"), 10_000.0, F.col("bucket"), 0.1)),
    "dp_noisy_mean": Sample(*_COUNTS, lambda c, df: c.dp_noisy_mean(df, F.col("s"), F.col("n"), 100.0, 0.1)),
    "dp_noisy_histogram": Sample(*_COUNTS, lambda c, df: c.dp_noisy_histogram(df.select("bucket", F.col("n").alias("value")), 0.1)),
    "dp_chunked_count": Sample(*_CHUNKS, lambda c, df: c.dp_chunked_count(df, "c", 0.1)),
    "dp_chunked_sum": Sample(*_CHUNKS, lambda c, df: c.dp_chunked_sum(df, "c", 0.1, lower=0, upper=10)),
    "dp_chunked_mean": Sample(*_CHUNKS, lambda c, df: c.dp_chunked_mean(df, "c", 0.1, lower=0, upper=10)),
    "dp_chunked_histogram": Sample("c array<string>", ((["eng", "hr"],), (["eng"],)), lambda c, df: c.dp_chunked_histogram(df, "c", _DEPTS, 0.1)),
    "dp_vector_sum": Sample(*_VECTORS, lambda c, df: c.dp_vector_sum(df, "e", 10.0, 0.1)),
    "dp_vector_mean": Sample(*_VECTORS, lambda c, df: c.dp_vector_mean(df, "e", 10.0, 0.1, min_count=0)),
    "dp_group_by": Sample(*_PAY, lambda c, df: c.dp_group_by(df, "dept", "salary", "sum", 0.1, lower=0, upper=10_000)),
    "dp_aggregate": Sample(*_PAY, lambda c, df: c.dp_aggregate(df, {"salary": ("sum", {"clip_lower": 0, "clip_upper": 10_000}), "dept": ("histogram", {"categories": _DEPTS})}, 0.1)),
    "ldp_binary": Sample("v int", ((0,), (1,), (1,), (0,), (1,)), lambda c, df: c.estimate_binary_frequency(df, "v", 1.0)),
    "ldp_categorical": Sample(*_TEAMS, lambda c, df: c.estimate_categorical_histogram(df, "dept", ["eng", "hr", "sales"], 1.0)),
    "k_anonymize_record": Sample(*_PEOPLE, lambda c, df: c.k_anonymize_record(df, ["age", "zip", "gender"], {"age": kanon.AgeHierarchy(), "zip": kanon.ZipcodeHierarchy(), "gender": kanon.GenderHierarchy()}, 2)),
    "k_anonymize_table": Sample(*_PEOPLE, lambda c, df: c.k_anonymize_table(df, ["age", "zip", "gender"], 2)),
    "obfuscate_query": Sample("q string", (("高血压的治疗方法",), ("附近医院",)), _one("sent", lambda c: c.obfuscate_query("q"))),
    "recommend_params": Sample("v double", tuple((float(i),) for i in range(1, 11)), lambda c, df: c.recommend_params(df, "v")),
    "classify_fields": Sample(*_CONTACT, lambda c, df: c.classifier("general-pii").classify_fields(df, "id")),
    "classify_records": Sample(*_VISITS, lambda c, df: c.classifier("medical").classify_records(df, "id")),
    "classify_table": Sample(*_VISITS, lambda c, df: c.classifier("medical").classify_table(df, "id")),
    "medical_process": Sample(*_VISITS, lambda c, df: c.medical_process(df)),
    "process_records": Sample(*_VISITS, lambda c, df: c.process_records(df)),
}


def run(client: PrivacyClient, spark: SparkSession, name: str) -> DataFrame:
    """The client's answer to a sample."""
    sample = CATALOGUE[name]
    return sample.run(client, sample.frame(spark))
