import io
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tests.llm import brute
from veilframe.llm import packing, tokenbin
from veilframe.llm.queries import op2_best_fit_packing, op7_elias_fano_tokens
from veilframe.llm.tokens import encoder

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.mark.parametrize(("path", "spaced"), [(WORD, False), (BYTE, True)])
def test_encoder_is_the_tokenizer(path, spaced):
    rng = random.Random(2)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'Tis", "1", "23", "!", "~", "\r", "\xa0", "́", "<|endoftext|>", "Σ", "İ", "ſ", "don't", "日本", "_", "\\", "٣"]
    texts = [None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 15))) for _ in range(3000)]
    coder, plain = encoder(path, spaced), Tokenizer.from_file(path)
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, coder.dtype).tobytes() for t in texts]
    assert coder.encode_all(texts) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_plan(lengths):
    """Every piece has a place, nothing overlaps or overflows, and bins stay near the bound."""
    capacity, histogram = 64, {}
    for n in lengths:
        histogram[n] = histogram.get(n, 0) + 1
    find = packing._places(packing.plan(histogram, capacity))
    filled = {}
    for n, c in histogram.items():
        for seq, off in zip(*find(np.full(c, n), np.arange(c)), strict=True):
            filled.setdefault(int(seq), []).append((int(off), n))
    assert sorted(filled) == list(range(len(filled)))
    for pieces in filled.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= capacity
    best = sorted(lengths, reverse=True)
    bins = []
    for n in best:  # best-fit decreasing, one piece at a time
        fit = [i for i, b in enumerate(bins) if b + n <= capacity]
        if fit:
            bins[max(fit, key=lambda i: bins[i])] += n
        else:
            bins.append(n)
    assert len(filled) <= len(bins) + 1


def pieces_of(rows, plain):
    out = []
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        out += [(i, k, a, len(ids[a : a + 2048]), brute.crc(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048))]
    return out


def check_packed(got, rows, plain):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = pieces_of(rows, plain)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in by.values():
        at = 0
        for off, n in sorted(p):
            assert off == at
            at += n
        assert at <= 2048
    assert len(by) <= -(-sum(w[3] for w in want) // 2048) * 1.02 + 1


def test_op2(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check_packed(op2_best_fit_packing(spark, SMALL).collect(), rows, Tokenizer.from_file(WORD))


def test_pack_edges(odd_docs, no_docs):
    from pyspark.sql import functions as F

    got = packing.pack(odd_docs, WORD).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packed(got, [(r["doc_id"], r["text"]) for r in odd_docs.collect()], Tokenizer.from_file(WORD))
    assert packing.pack(no_docs, WORD).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=400), st.integers(-(2**40), 2**40))
def test_elias_fano(steps, base):
    values = np.cumsum(np.array(steps, np.int64)) + base
    ef = tokenbin.EliasFano.from_bytes(tokenbin.EliasFano.encode(values).to_bytes())
    assert [ef.select(i) for i in range(ef.n)] == values.tolist()
    for lo, hi in ((0, ef.n), (ef.n // 3, ef.n), (0, ef.n // 2), (min(63, ef.n), min(130, ef.n))):
        assert ef.span(lo, hi).tolist() == values[lo:hi].tolist()
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 1000, 10_000))
    assert len(tokenbin.EliasFano.encode(values).to_bytes()) * 8 < 10_000 * (2 + np.log2(values[-1] / 10_000) + 1)


def test_token_file():
    ids = [np.array(x, "<u2").tobytes() for x in ([1, 2, 0], [0], [5] * 700 + [0])]
    f = tokenbin.TokenFile(io.BytesIO(tokenbin.encode_file([None, 7, 7], ids, 2)))
    assert [f.doc_id(i) for i in range(3)] == [None, 7, 7] == f.doc_ids(0, 3) and f.doc_ids(1, 2) == [7] and f.doc_ids(0, 1) == [None]
    assert [f.ids(i).tobytes() for i in (2, 0, 1)] == [ids[2], ids[0], ids[1]]
    with pytest.raises(ValueError):
        tokenbin.TokenFile(io.BytesIO(b"x" * 100))


def test_op7(spark):
    plain, at, want = Tokenizer.from_file(BYTE), 0, []
    for i, t in sorted(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), brute.crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, op7_elias_fano_tokens(spark, SMALL).collect())) == want


def test_one_id_for_all(spark, tmp_path):
    """Rows of one id spread over tasks and files, and starts still run through."""
    docs = spark.createDataFrame([(5, f"text {i % 50}") for i in range(400)], "doc_id long, text string").repartition(4)
    path = f"file://{tmp_path}/one"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = tokenbin.write_tokens(docs, path, BYTE, shard=64)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["path"].rsplit("/", 1)[1].split("-")[0] for r in manifest.collect()}) > 2
    got = tokenbin.with_digest(tokenbin.read_tokens(manifest, path)).orderBy("start").collect()
    assert len(got) == 400 and all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:], strict=False)) and got[0]["start"] == 0


def test_token_edges(odd_docs, no_docs, tmp_path):
    docs = odd_docs.collect()
    path = f"file://{tmp_path}/t"
    manifest = tokenbin.write_tokens(odd_docs, path, BYTE, shard=500)
    assert manifest.count() > 3
    got = tokenbin.with_digest(tokenbin.read_tokens(manifest, path)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, *sorted(d["doc_id"] for d in docs if d["doc_id"] is not None)]
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:], strict=False))
    assert {r["doc_id"]: r["n_tokens"] for r in got}[0] == 1
    assert tokenbin.round_trip(no_docs, BYTE).count() == 0
