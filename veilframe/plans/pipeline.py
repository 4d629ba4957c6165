"""Pipelines: classify records and mask their fields in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import masks
from veilframe.plans.budget import PrivacyError
from veilframe.plans.classify import Classifier, build
from veilframe.sources import ingest


def _masked(df: DataFrame, when=None):
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            m = masks.mask_value(f.name, c)
            c = m if when is None else F.when(when, m).otherwise(c)
        out.append(c.alias(f.name))
    return out


def _levels(df: DataFrame, c: Classifier, columns: list[str]):
    return c.record_level(c.record_tags(columns), c.composite_level(columns))


def medical_process(df: DataFrame, columns: list[str] | None = None, semantics: str = "reference") -> DataFrame:
    """Every record with its ``max_level`` under the medical pack and all string columns masked by name."""
    c = build("medical", semantics=semantics)
    return df.select(*_masked(df), _levels(df, c, columns or df.columns).alias("max_level"))


def process_records(df: DataFrame, mask_l4: bool = True, mask_l5: bool = True, domain: str | None = None, semantics: str = "reference") -> DataFrame:
    """Masked iff either flag is set; with intended semantics only records at the flagged levels are."""
    if semantics == "reference":
        return df.select(*_masked(df)) if mask_l4 or mask_l5 else df
    c = build(domain or "medical", semantics=semantics)
    wanted = [level for level, flag in (("L4", mask_l4), ("L5", mask_l5)) if flag]
    return df.select(*_masked(df, _levels(df, c, df.columns).isin(wanted)))


def run_file(spark: SparkSession, source: str, target: str, pipeline: str = "medical", kind: str = "parquet", **options) -> DataFrame:
    """A CSV or JSON file through a pipeline ("medical" or "records") into a sink; returns what was written."""
    run = {"medical": medical_process, "records": process_records}.get(pipeline)
    if run is None:
        raise PrivacyError(f"unknown pipeline {pipeline!r}")
    df = ingest.read_json(spark, source) if source.lower().endswith(".json") else ingest.read_csv(spark, source)
    ingest.write(run(df, **options), target, kind)
    return spark.read.csv(target, header=True) if kind == "csv" else spark.read.format(kind).load(target)
