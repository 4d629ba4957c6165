"""Fill-in-middle, WARC archives, filter audit: brute force, exact round trips, odd tables."""

import hashlib
import random
import re
import time
from itertools import permutations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilframe.llm import audit, fim, warc
from veilframe.llm.common import as_uri, new_path

# -- fill in middle ------------------------------------------------------------------------------------

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_cut(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by a list of tokens."""
    t, units = text or "", TOKEN.findall(text or "")
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    form = "spm" if h4 % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(("a", "é", "日", "😀", " ", "\t", "\n", "\x0b", "\x85", " ", "<", "P>", "<S>" if rng.random() < 0.02 else "x")) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_cuts_by_bits_are_those_of_the_pattern(spark):
    rows = [(i, t) for i, t in enumerate(texts(1, 1500))] + [(None, "some text here"), (-7, " "), (7, None), (7, None), (8, "<P"), (9, "a<M>b")]
    got = fim.transform(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got), key=key) == sorted(((i, *plain_cut(i, t), t or "") for i, t in rows), key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_select_finds_every_mark():
    rng = random.Random(3)
    for width in (1, 2, 3, 64, 65, 1000):
        marks = [i for i in range(width) if rng.random() < 0.3] or [width - 1]
        bits = sum(1 << i for i in marks)
        assert [fim.select(bits, r + 1, width) for r in range(len(marks))] == marks


@pytest.mark.parametrize("text", ["word " * 4_000_000, " " * 20_000_000, "x" * 20_000_000])
def test_long_texts_take_time_in_proportion(text):
    began = time.process_time()
    c = fim.cut(5, text.encode(), rate=100)
    assert fim.laid_out(c) and c.prefix + c.middle + c.suffix == text.encode()
    assert time.process_time() - began < 10


def test_odd_and_empty_tables_transform(odd_docs, no_docs):
    got = fim.digest(fim.transform(odd_docs)).collect()
    want = {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in odd_docs.collect()}
    assert len(got) == odd_docs.count() and {(r["doc_id"], r["restored_sha256"]) for r in got} == want
    assert fim.digest(fim.transform(no_docs)).count() == 0


# -- archives ------------------------------------------------------------------------------------------


def page_table(spark):
    rng = random.Random(2)
    body = lambda n: "".join(rng.choice("abc <>/é\r\n0") for _ in range(n))
    twice, much, cold = body(5000), body(70_000), body(1000)
    rows = [(i, f"https://host/{i}", body(rng.choice((0, 1, 300, 5000, 16_300, 40_000)))) for i in range(120)]
    rows += [(200 + i, "u", twice) for i in range(5)] + [(300, "u", much), (310, None, much), (320, "u\r\nWARC-Type: x y", cold), (-4, "", cold)]
    rows += [(400, "u", None), (401, "u", ""), (402, "u", "short"), (403, "u", "short"), (None, "u", twice), (None, None, None), (500, "u", body(2000))]
    rows += [rows[-1], (510, "u", "z" * 3000), (510, "other", "z" * 3000), (509, "u", "z" * 3000), (None, "u", "n" * 1500), (None, "u", "n" * 1500)]
    return rows, spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, digest string, n string").repartition(5)


def wanted(rows):
    top = {}
    for i, _, html in rows:
        top.setdefault(html or "", []).append(i)
    out = []
    for i, _, html in rows:
        raw, ids = (html or "").encode(), [x for x in top[html or ""] if x is not None]
        most = max(ids, default=None)
        again = len(raw) >= 1000 and i != most
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", most if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("groups", [0, 100])
def test_pages_come_back_from_archives(spark, groups, monkeypatch):
    """Joined and broadcast, in small files and segments: records span files."""
    monkeypatch.setattr(warc, "GROUPS", groups)
    rows, pages = page_table(spark)
    path = as_uri(new_path(spark, "warc"))
    files = warc.write_warc(pages, path, segment=3000, shard=20_000)
    assert files.count() > 10
    read = warc.read_warc(files, path)
    found = warc.resolved(read)
    assert found.filter("problem IS NOT NULL").count() == 0
    assert sorted(map(tuple, warc.page_rows(found, "long").collect()), key=repr) == wanted(rows)


def test_payloads_are_the_pages(spark):
    rows, pages = page_table(spark)
    kept = {(None if i is None else str(i), h or "") for i, _, h in rows}
    got = {(r["page"], bytes(r["payload"]).decode()) for r in warc.round_trip(pages).filter("type = 'response'").collect()}
    assert got <= kept and {h for _, h in got} == {h for _, h in kept}


def test_what_is_wrong_with_segments_is_named(spark):
    head, body = warc._HTTP, warc.chunked(b"payload" * 900, 1000)
    block = head + body
    fields = lambda i, **more: {"WARC-Record-ID": f"<urn:x-page:{i}:d>", "WARC-Date": "x", "X-Page-ID": str(i), **more}
    records = {i: list(warc.segments(fields(i), block, 2000, f"urn:x-page:{i}:d")) for i in range(4)}
    records[1].pop(1)  # a gap
    records[2].pop()  # the last, with the total
    records[3] = list(reversed(records[3]))  # order in the file is no matter
    records[4] = [warc.record("response", fields(4), head + b"5\r\nabc\r\n0\r\n\r\n")]
    records[5] = [warc.record("response", fields(5, **{"WARC-Payload-Digest": "sha1:" + "0" * 40}), head + b"0\r\n\r\n")]
    records[6] = [warc.record("revisit", fields(6, **{"WARC-Refers-To": "<urn:x-page:99:d>", "WARC-Payload-Digest": "sha1:AB"}), b"")]
    records[7] = [warc.record("response", fields(7), b"HTTP/1.0 200 OK\r\nContent-Length: 3\r\n\r\nabc"), b""]
    folder = Path(new_path(spark, "odd").removeprefix("file:"))
    folder.mkdir(parents=True)
    flat = [x for r in records.values() for x in r]
    (folder / "a.warc.gz").write_bytes(b"".join(flat[::2]))
    import gzip

    (folder / "b.warc").write_bytes(b"".join(gzip.decompress(x) for x in flat[1::2] if x) + b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 8\r\nContent-Length: 50\r\n\r\nHTTP/1.1 200\r\n\r\ncut")
    files = spark.createDataFrame([(str(folder / n),) for n in ("a.warc.gz", "b.warc")], "path string")
    got = {r["page"]: r for r in warc.resolved(warc.read_warc(files, as_uri(str(folder)))).collect()}
    assert {k: r["problem"] for k, r in got.items()} == {"0": None, "1": "segment numbers", "2": "total length", "3": None, "4": "chunk length", "5": "payload digest", "6": "no response", "7": None, "8": "record length"}
    assert got["0"]["payload_bytes"] == got["3"]["payload_bytes"] == 6300 and got["7"]["payload_bytes"] == 3 and got["6"]["payload_digest"] == "ab"


def test_no_pages_no_records(spark):
    _, pages = page_table(spark)
    assert warc.resolved(warc.round_trip(pages.limit(0))).count() == 0


# -- audit ---------------------------------------------------------------------------------------------


def walked(docs, labels):
    """{(part, order, step): counts} by walking every document through every order."""
    good, bad = ({i for i, *marks in labels if marks[j] == 1} for j in (0, 1))
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        rows.append((source or "", {k for k, v in fails.items() if v}, i in good, i in bad))
    out, share = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for s, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in own)
                out[part, order, s + 1] = [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                share[part, f] = share.get((part, f), 0) + len(gone)
    return {(p, o, s): (*v, share[p, o[s - 1]]) for (p, o, s), v in out.items()}


def held(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


@pytest.mark.parametrize("hub", [256, 3])
def test_audit_walks_every_order(spark, hub, monkeypatch):
    monkeypatch.setattr(audit, "HUB", hub)
    rng = random.Random(4)
    word = lambda: rng.choice(("alpha", "BETA", "gamma#", "d", "delta", "xé", "Zeta"))
    docs = [(i, (" " if i % 3 else "") + rng.choice((" ", "\n\t", "  ")).join(word() if rng.random() < 0.3 else f"w{rng.randrange(90)}" for _ in range(rng.choice((0, 1, 49, 50, 51, 80)))) + " " * (i % 2), rng.choice(("a", "b", None, ""))) for i in range(150)]
    docs += [(200 + i, docs[5][1], "a") for i in range(20)] + [(3, docs[5][1], "c"), (3, docs[5][1], "c"), (None, docs[5][1], "a"), (None, None, None), (300, None, "b"), (301, "", "b"), (302, " \n", "b"), (303, "A" * 60, "b"), (303, "A" * 60, "b")]
    docs += [(i, "one text of a crowd " * 12, f"s{i % 3}") for i in range(400, 460)]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(0, 460, 3)] + [(6, 1, 0), (6, 0, 1), (None, 1, 1)]
    table = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, source string, A string").repartition(3)
    marks = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = held(audit.audit(table, marks))
    assert got == walked(docs, [x for x in labels if x[0] is not None])
    assert held(audit.audit(table.limit(0), marks)) == {}
    none = held(audit.audit(table, marks.limit(0)))
    assert {k: v[:4] + v[6:] for k, v in none.items()} == {k: v[:4] + v[6:] for k, v in got.items()} and not any(v[4] or v[5] for v in none.values())


def test_audit_of_odd_texts(odd_docs, spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()]
    assert held(audit.audit(odd_docs, marks)) == walked(docs, [])
