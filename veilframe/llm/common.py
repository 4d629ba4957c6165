"""Shared helpers: durable intermediate tables, Arrow batch plumbing and hash folds."""

from __future__ import annotations

import contextlib
import ctypes
import re
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.plans.storage import shared_dir

BATCH = 8 << 20
HUB, HUBS = 256, 10_000


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/veilframe/{name}-{uuid.uuid4().hex}"


def as_uri(path: str) -> str:
    """A path of the shared folder as pyarrow's file systems read it."""
    if path.startswith("/"):
        return f"file://{path}"
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the reader over it.

    Cuts lineage durably: a lost executor re-reads files instead of recomputing the upstream.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veilframe_path = path  # type: ignore[attr-defined]
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later plan reads."""
    for t in tables:
        path = getattr(t, "_veilframe_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def hubs(rows: DataFrame, key: str | list[str], total: int) -> DataFrame | None:
    """(key, parts): the keys that more than 1 in ``HUBS`` of the ``total`` rows share, and at least ``HUB`` rows,
    with the number of parts to deal each in. At most ``HUBS`` keys, so the table may be broadcast. None if
    there are none."""
    limit = max(HUB, total // HUBS)
    found = materialise(rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).withColumn("_parts", F.ceil(F.col("_n") / limit)).drop("_n"), "hubs")
    return None if found.isEmpty() else found


def spread_join(rows: DataFrame, table: DataFrame, key: str | list[str], hot: DataFrame | None, how: str = "inner", by: str | None = None) -> DataFrame:
    """``rows.join(table, key, how)`` (inner, left or left_semi) that never gathers a hub's rows in one task.
    ``table`` holds a key once.

    What ``table`` says of hubs (``hot``, from ``hubs``) is broadcast; their rows keep the task they come from as a
    part of the key of the join that all other rows need. With ``by``, for tables of large values, a hub's
    rows are dealt by that column into parts instead, each with a copy of the table's row.
    """
    if hot is None:
        return rows.join(table, key, how)
    keys = [key] if isinstance(key, str) else key
    if by is None:
        values = [c for c in table.columns if c not in keys]
        known = table.select(*keys, F.struct(F.lit(True).alias("_hit"), *values).alias("_far"))
        few = F.broadcast(known.join(F.broadcast(hot.select(*keys)), keys, "left_semi").withColumnRenamed("_far", "_near"))
        named = F.broadcast(hot.select(*keys, F.lit(True).alias("_hub")).join(few, keys, "left"))
        dealt = rows.join(named, keys, "left").withColumn("_part", F.when(F.col("_hub"), F.spark_partition_id()).otherwise(-1))
        both = dealt.join(known.withColumn("_part", F.lit(-1)), [*keys, "_part"], "left").withColumn("_v", F.coalesce("_near", "_far"))
        found = both if how == "left" else both.filter(F.col("_v._hit"))
        return found.select(*rows.columns, *(F.col(f"_v.{c}").alias(c) for c in values if how != "left_semi"))
    parts, one = F.broadcast(hot), F.lit(1).cast("long")
    left = rows.join(parts, keys, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("_parts", one))).drop("_parts")
    right = table.join(parts, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", one) - 1))).drop("_parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")


def text_chunks(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch of at most 1024 rows and about ``limit`` bytes of text; a longer row stands
    alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    lo = size = 0
    for i, n in enumerate(sizes):
        if i > lo and (size + n > limit or i - lo == 1024):
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(sizes):
        yield lo, len(sizes)


_UNITS = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40}


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of the session to ``BATCH`` bytes, unless they are smaller already. Plans read the
    setting when they run, so it stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", spark.conf.get(key).lower())
    size = int(found[1]) << _UNITS.get(found[2], 0) if found else -1
    if size <= 0 or size > BATCH:
        spark.conf.set(key, str(BATCH))


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str, encodes: bool = False) -> DataFrame:
    """``mapInArrow`` with per-task set-up: ``make`` runs once a task and returns the batch function.

    Batches are held to ``BATCH`` bytes, so a batch of long texts stays small. Worker processes are reused: a
    task that does not encode frees the token cache that an earlier one left.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes and (tokens := sys.modules.get("veilframe.llm.tokens")):
            tokens.encoder.cache_clear()
        each = make()
        for b in batches:
            if b.num_rows:
                yield from each(b)
        return_memory()

    return df.mapInArrow(run, schema)


def return_memory() -> None:
    """Give what a task has freed back to the system, where the C library and Arrow can: worker processes
    are reused and would hold their largest task's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def fold(column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)
