"""CSV, JSON and Arrow ingest into string records, upload processing and sinks."""

from __future__ import annotations

from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.masks import mask_dataframe
from veilframe.operators.kanon import k_anonymize_strings
from veilframe.plans.budget import PrivacyError
from veilframe.sources import split

MAX_UPLOAD = 10 << 20


def read_csv(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """All strings, no inference; short rows are padded with "", extra cells dropped, a byte-order mark
    is stripped. Large files are read by many tasks, quoted line feeds or not (``split``); ``whole``: one task a file, which
    also takes files whose lines end in carriage returns alone."""
    if not whole:
        return split.read_csv(spark, path)
    df = spark.read.csv(path, header=True, multiLine=True, mode="PERMISSIVE", quote='"', escape='"', encoding="UTF-8")
    if not df.columns:
        raise PrivacyError("the file is empty")
    return df.na.fill("")


def _stringified(c: Column, kind: T.DataType) -> Column:
    """Numbers without exponent or trailing zero, booleans as words, null as "", nested as JSON."""
    if isinstance(kind, T.StringType):
        out = c
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        plain = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,15)").cast("string"), "0+$", ""), r"\.$", "")
        out = F.when(whole, c.cast("long").cast("string")).otherwise(plain)
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        out = F.to_json(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, whole: bool = False) -> DataFrame:
    """An array of objects (or lines of them): the sorted union of keys, everything as strings.

    Absent keys and nulls are "". Large files are read by many tasks (``split``): their objects are written as lines first;
    ``whole``: one task a file. Give a ``schema`` to spare the inference pass.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.json(path, multiLine=True, mode="FAILFAST") if whole else reader.json(split.json_lines(spark, path), mode="FAILFAST")
    if "_corrupt_record" in df.columns:
        raise PrivacyError("not an array of objects")
    return df.select(*(_stringified(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in sorted(df.columns)))


def from_arrow(spark: SparkSession, table: pa.Table | bytes) -> DataFrame:
    """An Arrow table or IPC stream that the driver holds as a DataFrame. ``veilframe.sources.arrow`` reads and writes
    files without the driver."""
    if isinstance(table, bytes):
        table = pa.ipc.open_stream(table).read_all()
    return spark.createDataFrame(table)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of a folder's files, on any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def process_file(spark: SparkSession, path: str, op: str, params: dict | None = None, limit: int | None = MAX_UPLOAD) -> DataFrame:
    """An uploaded .csv or .json of at most ``limit`` bytes (None: any size), masked (``mask_dataframe``) or
    k-anonymised (``k_anonymize``)."""
    params = params or {}
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in (".csv", ".json"):
        raise PrivacyError(f"unsupported file type {suffix!r}")
    if limit is not None and size_of(spark, path) > limit:
        raise PrivacyError(f"the file is larger than {limit} bytes")
    small = limit is not None  # then one task reads the file
    df = read_csv(spark, path, small) if suffix == ".csv" else read_json(spark, path, whole=small)
    if op == "mask_dataframe":
        return mask_dataframe(df, params.get("columns"))
    if op == "k_anonymize":
        if not params.get("qi_cols"):
            raise PrivacyError("qi_cols are required")
        return k_anonymize_strings(df, params["qi_cols"], params.get("k", 5), params.get("max_depth", 10))
    raise PrivacyError(f"unknown operation {op!r}")


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Parquet, ORC, CSV or JSON."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    {"parquet": writer.parquet, "orc": writer.orc, "json": writer.json, "csv": lambda p: writer.csv(p, header=True)}[kind](path)
