"""Streams of uploaded files: classified by rules that may change meanwhile, or processed into a folder.

Both work a micro-batch at a time and leave the same behind when one is run again, as after a restart: what a batch needs
beside its rows is kept under its number before they are touched, and what it writes replaces what an earlier
attempt wrote.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from veilframe.functions.masks import mask_dataframe
from veilframe.operators.kanon import k_anonymize_strings
from veilframe.plans.budget import PrivacyError
from veilframe.plans.classify import Classifier
from veilframe.plans.loader import FrozenStore, RuleStore
from veilframe.plans.storage import dropped, persisted
from veilframe.sources.arrow import located

BROKEN = "_broken"


class _Notes:
    """Small JSON documents under a folder, each written once."""

    def __init__(self, folder: str):
        self.store, self.root = located(folder)

    def get(self, name: str) -> dict | None:
        info = self.store.get_file_info(f"{self.root}/{name}.json")
        if not info.is_file:
            return None
        with self.store.open_input_stream(info.path) as f:
            return json.loads(f.read())

    def put(self, name: str, document: dict) -> None:
        target = f"{self.root}/{name}.json"
        self.store.create_dir(target.rpartition("/")[0], recursive=True)
        scratch = f"{target}.{uuid.uuid4().hex}"
        with self.store.open_output_stream(scratch, compression=None) as f:
            f.write(json.dumps(document, ensure_ascii=False).encode())
        self.store.move(scratch, target)


def classify_stream(rows: DataFrame, store: RuleStore, record_id: str, sink: Callable[[DataFrame, int], None], checkpoint: str, domain: str | None = None, standard: str | None = None, columns: list[str] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Start classifying the fields of a stream's rows by the rules of ``store``, which are read anew for every
    micro-batch and compiled anew where they say something else. ``sink`` gets (record_id, field, ...) of
    ``Classifier.classify_fields`` with ``rules_version``, the digest of the rules that judged the batch. Rules that can't
    be read or compiled leave those in force that were.

    A batch keeps its version: run again, it is judged by the same rules, whatever the files say by then. The
    rules of every version stay in the checkpoint folder, under ``rules``.
    """
    notes, compiled = _Notes(checkpoint), {}

    def classifier(frozen: FrozenStore) -> Classifier:
        if frozen.version not in compiled:
            made = frozen.classifier(domain, standard)
            while len(compiled) > 3:
                compiled.pop(next(iter(compiled)))
            compiled[frozen.version] = made
        return compiled[frozen.version]

    def kept(version: str) -> FrozenStore:
        return FrozenStore(notes.get(f"rules/{version}"), store.semantics, store.policy)

    def in_force(number: int) -> FrozenStore:
        try:
            frozen = store.frozen()
            classifier(frozen)
        except Exception:
            before = notes.get(f"judged/{number - 1}") if number else None
            if not before:
                raise
            return kept(before["version"])
        if notes.get(f"rules/{frozen.version}") is None:
            notes.put(f"rules/{frozen.version}", frozen.documents)
        return frozen

    def each(batch: DataFrame, number: int) -> None:
        judged = notes.get(f"judged/{number}")
        frozen = kept(judged["version"]) if judged else in_force(number)
        if not judged:
            notes.put(f"judged/{number}", {"version": frozen.version})
        out = classifier(frozen).classify_fields(batch, record_id, columns)
        sink(out.withColumn("rules_version", F.lit(frozen.version)), number)

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(**(trigger or {"availableNow": True})).start()


def upload_stream(spark: SparkSession, folder: str, columns: list[str], op: str, target: str, quarantine: str, checkpoint: str, kind: str = "csv", params: dict | None = None, files: int = 100, trigger: dict | None = None) -> StreamingQuery:
    """Start processing the files that come into ``folder`` (CSV with a header, or JSON lines), all columns as strings:
    masked (``mask_dataframe``) or k-anonymised (``k_anonymize``, every micro-batch for itself). Results are Parquet under
    ``target``/batch=n, rows that can't be read (a wrong number of cells, no JSON object) with their file under
    ``quarantine``/batch=n. A batch that is run again replaces its own two folders, so no file is lost or doubled.

    A batch of fewer than k rows can't be k-anonymised: it goes to quarantine as a whole.
    """
    params = params or {}
    if op not in ("mask_dataframe", "k_anonymize"):
        raise PrivacyError(f"unknown operation {op!r}")
    if op == "k_anonymize" and not params.get("qi_cols"):
        raise PrivacyError("qi_cols are required")
    if kind not in ("csv", "json"):
        raise PrivacyError(f"unsupported file type {kind!r}")
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in columns), T.StructField(BROKEN, T.StringType())])
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("columnNameOfCorruptRecord", BROKEN).option("mode", "PERMISSIVE").option("pathGlobFilter", f"*.{kind}")
    reader = reader.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"') if kind == "csv" else reader.option("primitivesAsString", True)
    rows = reader.format(kind).load(folder).withColumn("_file", F.col("_metadata.file_path"))

    def each(batch: DataFrame, number: int) -> None:
        held = persisted(batch, "uploads")
        whole, k = held.filter(F.col(BROKEN).isNull()).select(*columns).na.fill(""), params.get("k", 5)
        odd = held.filter(F.col(BROKEN).isNotNull()).select("_file", F.col(BROKEN).alias("record"))
        if op == "k_anonymize" and 0 < (n := whole.count()) < k:
            text = F.to_json(F.struct(*columns))
            odd = odd.unionByName(held.filter(F.col(BROKEN).isNull()).select("_file", text.alias("record")))
            whole = whole.limit(0)
        done = mask_dataframe(whole, params.get("columns")) if op == "mask_dataframe" else k_anonymize_strings(whole, params["qi_cols"], k, params.get("max_depth", 10))
        done.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")
        odd.write.mode("overwrite").parquet(f"{quarantine.rstrip('/')}/batch={number}")
        dropped(held)

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(**(trigger or {"availableNow": True})).start()
