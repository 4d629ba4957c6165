import json

import pytest
from pyspark.sql import functions as F

from veilframe.plans import loader
from veilframe.plans.budget import PrivacyError
from veilframe.plans.model import Matcher, Profile, Rule
from veilframe.streaming import uploads


def pack(word, level="L4"):
    return Profile("own", (Rule(f"R_{word}", level, "c", 1, (Matcher("keyword_contains", {"keywords": [word]}),)),), (), ())


def test_rules_change_in_mid_stream(spark, tmp_path):
    """Every row names the rules that judged it; a batch that is run again is judged by its own ones."""
    source, state = tmp_path / "in", tmp_path / "state"
    store = loader.RuleStore(str(tmp_path / "rules"))
    store.write(pack("alpha"))
    for i in range(5):
        spark.createDataFrame([(i * 10 + j, w) for j, w in enumerate(("alpha", "beta", "gamma"))], "id long, v string").coalesce(1).write.mode("append").parquet(str(source))
    out, fail = {}, [True]

    def sink(df, number):
        out.setdefault(number, []).append({r["record_id"]: (r["final_level"], r["rules_version"]) for r in df.collect()})
        if number == 0:
            store.write(pack("beta", "L5"))
        if number == 1:
            (tmp_path / "rules" / "domains" / "own.json").write_text("{ broken")  # stays out of force
        if number == 2:
            store.write(pack("gamma"))
        if number == 3 and fail[0]:
            fail[0] = False
            store.write(pack("alpha", "L2"))
            raise ValueError("lost")

    def run():
        stream = spark.readStream.schema("id long, v string").option("maxFilesPerTrigger", 1).parquet(str(source))
        return uploads.classify_stream(stream, store, "id", sink, str(state), domain="own")

    with pytest.raises(Exception, match="lost"):
        run().awaitTermination()
    run().awaitTermination()
    levels = {n: [sorted({(i % 10, level) for i, (level, _) in seen.items()}) for seen in found] for n, found in out.items()}
    assert levels == {0: [[(0, "L4"), (1, "L1"), (2, "L1")]], 1: [[(0, "L1"), (1, "L5"), (2, "L1")]], 2: [[(0, "L1"), (1, "L5"), (2, "L1")]], 3: [[(0, "L1"), (1, "L1"), (2, "L4")]] * 2, 4: [[(0, "L2"), (1, "L1"), (2, "L1")]]}
    versions = {n: {v for seen in found for _, v in seen.values()} for n, found in out.items()}
    assert all(len(v) == 1 for v in versions.values()) and versions[1] == versions[2] and len(set().union(*versions.values())) == 4
    # What a version says can be read later.
    (first,) = versions[0]
    assert uploads.FrozenStore(json.loads((state / "rules" / f"{first}.json").read_text())).profile("own").rules[0].id == "R_alpha"
    with pytest.raises(PrivacyError):
        store.frozen().write(pack("x"))
    with pytest.raises(PrivacyError):
        store.frozen().profile("none")


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_uploads_are_neither_lost_nor_doubled(spark, tmp_path, kind, monkeypatch):
    source, out, bad, state = (tmp_path / x for x in ("in", "out", "bad", "state"))
    source.mkdir()
    for i in range(6):
        rows = [("13800138%03d" % (10 * i + j), f"na\nme {i}-{j}") for j in range(4)]
        if kind == "csv":
            text = "phone,name\n" + "".join(f'{p},"{n}"\n' for p, n in rows) + ("only one\n" if i % 2 else "a,b,c\n")
        else:
            text = "\n".join([*(json.dumps({"phone": p, "name": n}) for p, n in rows), '{"phone": "cut'])
        (source / f"f{i}.{kind}").write_text(text)
    (source / "other.txt").write_text("x")
    calls, plain = [], uploads.mask_dataframe

    def masks(df, columns=None):
        calls.append(1)
        if len(calls) == 2:
            spark.range(3).write.parquet(str(out / "batch=1"))  # half of an attempt
            raise ValueError("lost")
        return plain(df, columns)

    monkeypatch.setattr(uploads, "mask_dataframe", masks)
    run = lambda: uploads.upload_stream(spark, str(source), ["phone", "name"], "mask_dataframe", str(out), str(bad), str(state), kind, files=2)
    with pytest.raises(Exception, match="lost"):
        run().awaitTermination()
    run().awaitTermination()
    (source / f"late.{kind}").write_text('phone,name\n13900000000,"x"\n' if kind == "csv" else '{"phone": "13900000000", "name": "x"}')
    run().awaitTermination()
    run().awaitTermination()
    got = spark.read.parquet(str(out))
    assert got.count() == 25 and got.select("phone", "name").distinct().count() >= 6 and {r["batch"] for r in got.select("batch").distinct().collect()} == {0, 1, 2, 3}
    assert all("****" in r["phone"] for r in got.collect())
    odd = spark.read.parquet(str(bad))
    assert odd.count() == 6 and odd.select("_file").distinct().count() == 6


def test_small_batches_are_not_anonymised(spark, tmp_path):
    source, out, bad = (tmp_path / x for x in ("in", "out", "bad"))
    source.mkdir()
    (source / "a.csv").write_text("age,zip\n" + "".join(f"{20 + i % 3},1000{i}\n" for i in range(12)))
    (source / "b.csv").write_text("age,zip\n30,1\n31,2\n")
    q = uploads.upload_stream(spark, str(source), ["age", "zip"], "k_anonymize", str(out), str(bad), str(tmp_path / "s"), params={"qi_cols": ["age", "zip"], "k": 5}, files=1)
    q.awaitTermination()
    assert spark.read.parquet(str(out)).groupBy("age", "zip").count().agg(F.min("count")).first()[0] >= 5 and spark.read.parquet(str(bad)).count() == 2
    for wrong in (dict(op="other"), dict(op="k_anonymize"), dict(op="mask_dataframe", kind="xml")):
        with pytest.raises(PrivacyError):
            uploads.upload_stream(spark, str(source), ["age"], target="x", quarantine="y", checkpoint="z", **wrong)
