import datetime
import decimal
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilframe.plans.budget import PrivacyError
from veilframe.sources import arrow, ingest, split


def every_type(spark, n=1000):
    rows = [(i, f"é{i}" if i % 3 else None, i / 7, [1.0 * i, None], {"k": i}, datetime.datetime(2024, 1, 1, 0, i % 60), datetime.date(2024, 1, 1 + i % 28), decimal.Decimal(i), i % 2 == 0, bytes([i % 256]), (i, "x")) for i in range(n)]
    return spark.createDataFrame(rows, "id long, s string, d double, a array<double>, m map<string,int>, t timestamp_ntz, day date, n decimal(10,0), b boolean, raw binary, p struct<x:int,y:string>")


def same(a, b):
    return a.schema.simpleString() == b.schema.simpleString() and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_arrow_round_trip(spark, tmp_path):
    df, path = every_type(spark).repartition(3), (tmp_path / "a").as_uri()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        arrow.write_arrow(df, path)
        back = arrow.read_arrow(spark, path, batches=2)
        assert same(df, back) and back.rdd.getNumPartitions() >= 9
        arrow.write_arrow(df.limit(5).coalesce(1), path)
        assert arrow.read_arrow(spark, path).count() == 1005
        arrow.write_arrow(df.limit(7), path, "overwrite")
        assert arrow.read_arrow(spark, path).count() == 7
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    arrow.write_arrow(df.limit(0), (tmp_path / "none").as_uri())
    assert arrow.read_arrow(spark, (tmp_path / "none").as_uri()).schema.simpleString() == df.schema.simpleString()
    assert arrow.read_arrow(spark, (tmp_path / "none").as_uri()).count() == 0


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    df = spark.range(10)
    arrow.write_arrow(df, str(tmp_path / "a"))
    one = next(p for p in (tmp_path / "a").iterdir() if p.suffix == ".arrow")
    (tmp_path / "a" / "part-lost.arrow").write_bytes(one.read_bytes())
    assert arrow.read_arrow(spark, str(tmp_path / "a")).count() == 10
    failing = df.repartition(2).select(F.when(F.col("id") == 7, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        arrow.write_arrow(failing, str(tmp_path / "a"))
    assert arrow.read_arrow(spark, str(tmp_path / "a")).count() == 10


def test_files_of_others(spark, tmp_path):
    """Folders without a manifest, streams beside files, other column orders and string kinds, a single file."""
    t = pa.table({"k": pa.array([1, 2, 3], pa.int64()), "s": pa.array(["a", None, "c"], pa.large_string())})
    with pa.ipc.new_file(str(tmp_path / "a.arrow"), t.schema) as w:
        for b in t.to_batches(1):
            w.write_batch(b)
    with pa.ipc.new_stream(str(tmp_path / "b.arrows"), t.schema) as w:
        w.write_table(t.select(["k", "s"]))
    u = t.select(["s", "k"])
    with pa.ipc.new_file(str(tmp_path / "c.arrow"), u.schema) as w:
        w.write_table(u)
    (tmp_path / "_other").write_text("x")
    got = arrow.read_arrow(spark, str(tmp_path))
    assert sorted((r["k"], r["s"]) for r in got.collect() if r["s"]) == [(1, "a")] * 3 + [(3, "c")] * 3 and got.count() == 9
    assert arrow.read_arrow(spark, str(tmp_path / "a.arrow"), batches=1).rdd.getNumPartitions() == 3
    for missing in (tmp_path / "no", tmp_path / "empty"):
        if missing.name == "empty":
            missing.mkdir()
        with pytest.raises(Exception, match="no such file|no Arrow file"):
            arrow.read_arrow(spark, str(missing)).count()
    assert issubclass(PrivacyError, ValueError) and json.dumps([])


# -- split files -----------------------------------------------------------------------------------------


def quoted_csv(rng, rows, newline):
    """Cells with line feeds, quotes, separators, blanks, quotes inside plain cells, short and long rows."""

    def cell():
        kind = rng.randrange(9)
        plain = "".join(rng.choice("abc é日") for _ in range(rng.randrange(6)))
        if kind < 4:
            return plain.strip() or "p"
        if kind == 4:
            return 'x5" disk'
        body = "".join(rng.choice(("a", ",", newline, '""', "é", " ", newline * 2)) for _ in range(rng.randrange(1, 14)))
        return f'"{body}"' if kind < 8 else f'"{body * 30}"'

    lines = ["one,two,three"]
    for _ in range(rows):
        lines.append(",".join(cell() for _ in range(rng.choice((3, 3, 3, 3, 2, 4)))))
        if rng.random() < 0.05:
            lines.append("")
    return newline.join(lines) + rng.choice(("", newline))


@pytest.fixture
def small_blocks(spark):
    """File blocks of 200 bytes, so that even small files are read by many tasks."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for key in keys:
        spark.conf.set(key, "200")
    yield spark
    for key in keys:
        spark.conf.unset(key)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("blocks", [100_000, 0])
def test_split_csv_is_the_whole_reader_s(small_blocks, tmp_path, seed, blocks, monkeypatch):
    import random

    monkeypatch.setattr(split, "BLOCKS", blocks)
    rng = random.Random(seed)
    newline = "\n" if seed % 2 else "\r\n"
    (tmp_path / "a.csv").write_bytes((b"\xef\xbb\xbf" if seed == 2 else b"") + quoted_csv(rng, 80, newline).encode())
    (tmp_path / "b.csv").write_bytes(quoted_csv(rng, 20, newline).encode())
    want = ingest.read_csv(small_blocks, str(tmp_path), whole=True)
    got = ingest.read_csv(small_blocks, str(tmp_path))
    assert got.columns == want.columns == ["one", "two", "three"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert split._pieces(small_blocks, str(tmp_path), "\n").rdd.getNumPartitions() > 10


def test_lines_follow_the_states():
    for line, outside, inside in (("a,b", False, True), ('"a', True, False), ('a"b', False, False), ('x,"y', True, False), ('x,"y""z",w', False, False), ('",', True, False), ('","', False, True), ('""', False, True), ('a"",b', False, True), ('","x,', False, True)):
        assert (split.after_line(line, False, ","), split.after_line(line, True, ",")) == (outside, inside), line


@pytest.mark.parametrize("seed", range(4))
def test_split_json_is_the_whole_reader_s(small_blocks, tmp_path, seed):
    import random

    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(('"', "\\", "{", "}", "[", "]", ",", "é", "\n", "a", "\\\"}")) for _ in range(rng.randrange(n)))
    rows = [{"id": i, "t": text(30), "deep": {"k": [{"x": text(8)}, {"x": i}] if i % 3 else [], "e": {}}, **({"big": text(600)} if i % 17 == 0 else {}), **({"n": i / 4} if i % 2 else {})} for i in range(90)]
    (tmp_path / "a.json").write_text(json.dumps(rows[:60], indent=seed % 3 or None, ensure_ascii=bool(seed % 2)), encoding="utf-8")
    (tmp_path / "b.json").write_text("﻿" * (seed == 1) + json.dumps(rows[60:]) + "\n", encoding="utf-8")
    (tmp_path / "c.json").write_text("[]")
    want = ingest.read_json(small_blocks, str(tmp_path), whole=True)
    got = ingest.read_json(small_blocks, str(tmp_path))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 90
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    assert split.json_records(small_blocks, str(tmp_path / "lines.json")).count() == 90
    objects = [json.loads(r["text"]) for r in split.json_records(small_blocks, str(tmp_path / "a.json")).collect()]
    assert sorted(objects, key=lambda x: x["id"]) == rows[:60]


@pytest.mark.parametrize("text", ['"text"', "[1, 2", '[{"a": 1}', '[{"a": "}', "x", '{"a": [1}'])
def test_what_is_no_array_of_objects_is_refused(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="array of objects|FAILFAST|[Mm]alformed"):
        ingest.read_json(spark, str(tmp_path / "a.json")).count()
