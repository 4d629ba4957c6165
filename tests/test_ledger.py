import os
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from tests.conftest import ROOT
from veilframe.client import PrivacyClient
from veilframe.operators import dp
from veilframe.plans import ledger
from veilframe.plans.budget import BudgetAccountant, BudgetExhausted, PrivacyError
from veilframe.plans.ledger import DurableAccountant, replay
from veilframe.plans.params import ParameterResolver


def test_charges_outlive_their_accountant(spark, tmp_path):
    folder = tmp_path.as_uri()
    a = DurableAccountant(spark, folder, "team/é 1", 1.0, 1e-4)
    a.spend(0.25, 1e-5, "first")
    a.spend(0.5)
    again = DurableAccountant(spark, folder, "team/é 1", 1.0, 1e-4)
    assert again.remaining() == {"epsilon": 0.25, "delta": pytest.approx(9e-5)}
    with pytest.raises(BudgetExhausted):
        again.spend(0.3)
    again.spend(0.25)
    with pytest.raises(BudgetExhausted):
        a.spend(0.01)  # sees what the other charged
    with pytest.raises(BudgetExhausted):
        a.spend(0.0, 1e-3)
    a.spend(0.0, 9e-5)
    log = a.charges(spark).orderBy("number").collect()
    assert [(r["number"], r["epsilon"], r["label"]) for r in log] == [(1, 0.25, "first"), (2, 0.5, None), (3, 0.25, None), (4, 0.0, None)]
    with pytest.raises(PrivacyError):
        DurableAccountant(spark, folder, "team/é 1", 2.0, 1e-4)
    assert DurableAccountant(spark, folder, "other", 2.0, 1e-4).remaining()["epsilon"] == 2.0
    with pytest.raises(PrivacyError):
        DurableAccountant(spark, folder, " ", 2.0, 1e-4)
    for bad in ((-0.1, 0.0), (0.1, -1e-9), (float("nan"), 0.0)):
        for accountant in (a, BudgetAccountant("x", 1.0, 1.0)):
            with pytest.raises(PrivacyError):
                accountant.spend(*bad)


def test_the_last_entry_is_found_among_many(spark, tmp_path):
    log = ledger._Log(spark, tmp_path.as_uri())
    for n in range(0, 70):
        assert log.create(n, {"n": n}) and log.last() == n and log.last(n // 2) == n
    assert not log.create(5, {"n": -1}) and log.read(5)["n"] == 5 and not [p for p in tmp_path.iterdir() if p.name.startswith("_")]


def test_stores_that_rename(spark, tmp_path):
    """The path of other file systems than the local one."""
    log = ledger._Log(spark, tmp_path.as_uri())
    log.local = None
    assert log.last() == 0 and not log.has(0)
    assert log.create(0, {"n": "é"}) and log.create(1, {"n": 1}) and not log.create(1, {"n": 2})
    assert log.read(0) == {"n": "é", "number": 0} and log.read(1)["n"] == 1 and log.last() == 1
    assert sorted(p.name for p in tmp_path.iterdir() if p.name[0] not in "._") == [log.name(0), log.name(1)]


def test_threads_share_a_budget(spark, tmp_path):
    """Forty charges at once for ten: ten are in the log, whoever won."""
    won, lost = [], []

    def charge(i):
        a = DurableAccountant(spark, tmp_path.as_uri(), "shared", 10.0, 1.0)
        for _ in range(5):
            try:
                a.spend(1.0, 0.0, str(i))
                won.append(i)
            except BudgetExhausted:
                lost.append(i)

    threads = [threading.Thread(target=charge, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    a = DurableAccountant(spark, tmp_path.as_uri(), "shared", 10.0, 1.0)
    log = a.charges(spark).orderBy("number").collect()
    assert len(won) == len(log) == 10 and len(lost) == 30 and [r["spent_epsilon"] for r in log] == [float(i + 1) for i in range(10)]
    assert sorted(r["label"] for r in log) == sorted(map(str, won))


_RACE = """
import sys, time
from pathlib import Path
from pyspark.sql import SparkSession
from veilframe.plans.budget import BudgetExhausted
from veilframe.plans.ledger import DurableAccountant
folder, own, other = sys.argv[1:]
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
a = DurableAccountant(spark, "file:" + folder, "last", 1.0, 1.0)
Path(folder, own).touch()
while not Path(folder, other).exists():
    time.sleep(0.001)
try:
    a.spend(0.75)
    print("WON")
except BudgetExhausted:
    print("LOST")
"""


def test_processes_race_for_the_last_charge(spark, tmp_path):
    runs = [subprocess.Popen([sys.executable, "-c", _RACE, str(tmp_path), own, other], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=os.environ | {"PYTHONPATH": ROOT}, text=True) for own, other in (("a.up", "b.up"), ("b.up", "a.up"))]
    assert sorted(r.communicate(timeout=300)[0].split()[-1] for r in runs) == ["LOST", "WON"]
    assert DurableAccountant(spark, tmp_path.as_uri(), "last", 1.0, 1.0).remaining()["epsilon"] == 0.25


def test_releases_charge_it(spark, tmp_path):
    a = DurableAccountant(spark, tmp_path.as_uri(), "r", 1.0, 1e-4)
    df = spark.range(50).select(F.col("id").cast("double").alias("v"))
    assert dp.release(lambda: dp.count(df, "v", 0.5), a, 0.5).count() == 1
    client = PrivacyClient(ledger=DurableAccountant(spark, tmp_path.as_uri(), "r", 1.0, 1e-4))
    client.dp_count(df, "v", 0.5)
    with pytest.raises(BudgetExhausted):
        dp.release(lambda: dp.count(df, "v", 0.1), a, 0.1)


def test_replay_is_a_walk(spark):
    rows = [(i, "ab"[i % 2] if i % 5 else None, [0.5, 0.1, None, 0.4, 0.05][i % 5], [0.0, 0.2, 0.1][i % 3], "clash") for i in range(60)]
    got = replay(spark.createDataFrame(rows, "i long, n string, e double, d double, _n string").repartition(4), "n", ["i"], F.col("e"), F.col("d"), 1.5, 0.7).collect()
    spent, want = {}, {}
    for i, n, e, d, _ in rows:
        s = spent.setdefault(n, [0.0, 0.0])
        fits = s[0] + (e or 0) <= 1.5 and s[1] + d <= 0.7
        if fits:
            s[0], s[1] = s[0] + (e or 0), s[1] + d
        want[i] = (fits, *s)
    assert {r["i"]: (r["accepted"], r["spent_epsilon"], r["spent_delta"]) for r in got} == want and len(got) == 60
    assert replay(spark.createDataFrame(rows, "i long, n string, e double, d double, _n string").limit(0), "n", ["i"], F.col("e"), F.col("d"), 1.5, 0.7).count() == 0


def test_rows_are_resolved_as_requests_are(spark):
    r = ParameterResolver({"primitives": {"k_anonymity": {"k": 6}}}, {"a": {"k_anonymity": {"k": 9, "l": 3}}, "b": {"dp": {"epsilon": 3.0}}})
    rows = [(1, "a", None), (2, "b", None), (3, None, 4), (4, "a", 1), (5, "c", 2)]
    got = r.resolve_rows(spark.createDataFrame(rows, "i int, ns string, k int"), "k_anonymity", {"k": F.col("k")}, F.col("ns"), {"max_depth": 4}).collect()
    for row, (_, ns, k) in zip(sorted(got, key=lambda x: x["i"]), rows, strict=True):
        try:
            from veilframe.plans.params import Context

            want = r.resolve("k_anonymity", {"k": k} if k is not None else None, Context(namespace=ns or "default"), {"max_depth": 4})
            assert row["valid"] and row["params"].asDict() == want
        except PrivacyError:
            assert not row["valid"] and k == 1
