"""A ledger that outlives its process: an append-only log of charges on the shared file system.

A namespace is a folder. Entry 0 says its totals, entry n its n-th charge and what is spent with it. An entry is
written under a name of its own and then given its number by a step that fails where the number is taken (a hard link
on local disks, a rename without overwriting elsewhere). So of drivers that want the last charge at once one gets
it; the others read what came before them, judge anew and go on. A charge that is in the log is spent, whatever
becomes of its driver: a crash may cost budget, never privacy.

Numbers have no gaps, so the last entry is found by doubling and halving, and only that one is read. The file system
must rename atomically without overwriting: HDFS and its kind do, plain object stores do not.
"""

from __future__ import annotations

import json
import os
import threading
import uuid
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.plans.budget import DEFAULT_DELTA, DEFAULT_EPSILON, DEFAULT_NAMESPACE, BudgetAccountant, BudgetExhausted, PrivacyError, checked_charge
from veilframe.plans.storage import shared_dir

ENTRY = "number long, epsilon double, delta double, spent_epsilon double, spent_delta double, label string, writer string"


class _Log:
    """Numbered entries of a folder, each created once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self.jvm, self.conf = folder, spark._jvm, spark._jsc.hadoopConfiguration()
        path = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.local = Path(path.toUri().getPath()) if path.getFileSystem(self.conf).getScheme() == "file" else None
        if self.local:
            self.local.mkdir(parents=True, exist_ok=True)
        else:
            path.getFileSystem(self.conf).mkdirs(path)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    @staticmethod
    def name(number: int) -> str:
        return f"{number:012d}.json"

    def has(self, number: int) -> bool:
        if self.local:
            return (self.local / self.name(number)).exists()
        p = self._path(self.name(number))
        return p.getFileSystem(self.conf).exists(p)

    def read(self, number: int) -> dict:
        if self.local:
            return json.loads((self.local / self.name(number)).read_text())
        p = self._path(self.name(number))
        stream = p.getFileSystem(self.conf).open(p)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, number: int, entry: dict) -> bool:
        """Whether the entry got the number; False if another has it."""
        text, own = json.dumps(entry | {"number": number}) + "\n", f"_{uuid.uuid4().hex}"  # readers pass over such names
        if self.local:
            scratch = self.local / own
            with scratch.open("w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(scratch, self.local / self.name(number))
            except FileExistsError:
                return False
            finally:
                scratch.unlink()
            return True
        source, target = self._path(own), self._path(self.name(number))
        files = source.getFileSystem(self.conf)
        out = files.create(source, False)
        out.write(bytearray(text.encode()))
        out.close()
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.conf).rename(source, target, none)
        except Exception:
            if not files.exists(target):
                raise
            files.delete(source, False)
            return False
        return True

    def last(self, known: int = 0) -> int:
        """The highest number, at least ``known``, which there is."""
        step = 1
        while self.has(known + step):
            known, step = known + step, 2 * step
        while step > 1:
            step //= 2
            if self.has(known + step):
                known += step
        return known


class DurableAccountant(BudgetAccountant):
    """An accountant whose charges are entries of a log in ``folder``: any number of drivers may charge it. Totals that
    differ from the log's are an error."""

    def __init__(self, spark: SparkSession, folder: str | None = None, namespace: str = DEFAULT_NAMESPACE, epsilon: float = DEFAULT_EPSILON, delta: float = DEFAULT_DELTA):
        if not namespace or not namespace.strip():
            raise PrivacyError("the namespace is empty")
        super().__init__(namespace, epsilon, delta)
        self.folder = f"{(folder or shared_dir(spark) + '/ledger').rstrip('/')}/{quote(namespace, safe='')}"
        self._log, self._seen, self._lock = _Log(spark, self.folder), 0, threading.RLock()
        totals = {"epsilon": epsilon, "delta": delta, "spent_epsilon": 0.0, "spent_delta": 0.0, "label": "totals", "writer": ""}
        if not self._log.create(0, totals):
            found = self._log.read(0)
            if (found["epsilon"], found["delta"]) != (epsilon, delta):
                raise PrivacyError(f"namespace {namespace!r} has other totals")
        self.refresh()

    def refresh(self) -> None:
        """Read what other drivers have charged."""
        with self._lock:
            last = self._log.last(self._seen)
            if last != self._seen:
                entry = self._log.read(last)
                self._seen, self.spent_epsilon, self.spent_delta = last, entry["spent_epsilon"], entry["spent_delta"]

    def spend(self, epsilon: float, delta: float = 0.0, label: str | None = None) -> None:
        checked_charge(epsilon, delta)
        with self._lock:
            while True:
                self.refresh()
                after = self.spent_epsilon + epsilon, self.spent_delta + delta
                if after[0] > self.epsilon or after[1] > self.delta:
                    self.refused += 1
                    raise BudgetExhausted(f"namespace {self.namespace!r} has {self.epsilon - self.spent_epsilon} epsilon and {self.delta - self.spent_delta} delta left")
                entry = {"epsilon": epsilon, "delta": delta, "spent_epsilon": after[0], "spent_delta": after[1], "label": label, "writer": f"{os.uname().nodename}:{os.getpid()}"}
                if self._log.create(self._seen + 1, entry):
                    self._seen, (self.spent_epsilon, self.spent_delta) = self._seen + 1, after
                    self.history.append((epsilon, delta))
                    return

    def remaining(self) -> dict[str, float]:
        self.refresh()
        return {"epsilon": self.epsilon - self.spent_epsilon, "delta": self.delta - self.spent_delta}

    def charges(self, spark: SparkSession) -> DataFrame:
        """The log's charges of all drivers: (number, epsilon, delta, spent_epsilon, spent_delta, label, writer)."""
        return spark.read.schema(ENTRY).json(self.folder).filter("number > 0")


def replay(charges: DataFrame, namespace: str, order: list[str], epsilon: Column, delta: Column, total_epsilon: float, total_delta: float) -> DataFrame:
    """``charges`` with ``accepted``, ``spent_epsilon`` and ``spent_delta`` after each, as ledgers with these totals
    would have met them in ``order``: one that would exceed a total is refused, and smaller ones after it may pass.

    Whether a charge is accepted depends on every one before it in its namespace, so a namespace is walked in order;
    rows stream through sorted partitions, with two sums held. Nulls count as charges of 0.
    """

    def run(batches):
        last, spent, seen = None, [0.0, 0.0], False
        for b in batches:
            out = []
            for n, e, d in zip(b.column("_n").to_pylist(), b.column("_e").to_pylist(), b.column("_d").to_pylist(), strict=True):
                if not seen or n != last:
                    last, spent, seen = n, [0.0, 0.0], True
                fits = spent[0] + e <= total_epsilon and spent[1] + d <= total_delta
                if fits:
                    spent = [spent[0] + e, spent[1] + d]
                out.append((fits, *spent))
            if out:
                told = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.bool_(), pa.float64(), pa.float64()), strict=True)]
                yield pa.record_batch([b.column("_row"), *told], ["_row", "accepted", "spent_epsilon", "spent_delta"])

    own = F.struct(*charges.columns).alias("_row")
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    keyed = charges.select(own, F.col(namespace).cast("string").alias("_n"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), zero(epsilon).alias("_e"), zero(delta).alias("_d"))
    laid = keyed.repartition("_n").sortWithinPartitions("_n", *(f"_o{i}" for i in range(len(order)))).select("_row", "_n", "_e", "_d")
    kind = keyed.schema["_row"].dataType.simpleString()
    return laid.mapInArrow(run, f"_row {kind}, accepted boolean, spent_epsilon double, spent_delta double").select("_row.*", "accepted", "spent_epsilon", "spent_delta")
