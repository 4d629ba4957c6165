"""Durable cut points in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; in local mode, where it is unset, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="veilframe-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def persisted(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once and read back: random draws in it are fixed, lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/veilframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._veilframe_path = path  # type: ignore[attr-defined]
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete ``persisted`` tables that no later plan reads."""
    for t in tables:
        if path := getattr(t, "_veilframe_path", None):
            p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
