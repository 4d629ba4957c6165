import random

import numpy as np
import pytest

from tests.conftest import SMALL
from corpus_pipeline import near_duplicate_filter
from tests.llm import brute
from veilframe.llm import common, near_dedup
from veilframe.llm import components as components_module
from veilframe.llm import shingles as sh
from veilframe.llm.components import components
from veilframe.llm.near_dedup import keep_one, near_duplicates
from veilframe.llm.queries import op1_minhash_near_dedup


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = op1_minhash_near_dedup(spark, SMALL)
    assert found(got) == brute.near_duplicates(rows, 2)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


@pytest.mark.parametrize("k", [2, 5])
def test_families(spark, k):
    """A family of near copies with members at every similarity, chains, and strangers."""
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    chain = list(base[::-1])
    for i in range(30):
        chain[(5 * i) % 150 : (5 * i) % 150 + 5] = [f"c{i}_{j}" for j in range(5)]
        rows.append((200 + i, " ".join(chain)))
    rows += [(300 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))) for i in range(50)]
    rng.shuffle(rows)
    assert found(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k)) == brute.near_duplicates(rows, k)


def test_edges(odd_docs, no_docs):
    got = near_duplicates(odd_docs, 2).collect()
    assert len(got) == 16
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by[i]["n_shingles"] for i in range(5)] == [0, 0, 0, 1, 1]
    assert all(by[i]["component_id"] == i for i in (0, 1, 2, 3))
    assert by[4]["component_id"] == 3
    assert {by[i]["component_id"] for i in (5, 6, 7, 8)} == {5}
    assert by[9]["n_shingles"] > 100_000 and by[12]["n_shingles"] == 1
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    kept = keep_one(odd_docs, near_duplicates(odd_docs, 2))
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 1, 2, 3, 5, 9, 10, 11, 12]
    assert near_duplicates(no_docs, 2).count() == 0 and keep_one(no_docs, near_duplicates(no_docs, 2)).count() == 0


def test_an_id_with_several_texts_is_one_node(spark):
    """It links as any of its texts does, and all its rows share its component."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(3, b), (7, a), (7, b), (9, a), (9, a), (11, c), (12, c + " end"), (11, d), (15, d), (20, " "), (20, a), (30, None)]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "n_shingles", "component_id").collect()))
    want = {3: 3, 7: 3, 9: 3, 11: 11, 12: 11, 15: 11}
    assert got == sorted((i, len(brute.shingles(t, 5)), want.get(i, 3) if brute.shingles(t, 5) else i) for i, t in rows)


def test_rows_that_repeat_an_id_and_text_are_compared_once(spark, monkeypatch):
    """2000 rows of each of two near ids, in many tasks: three sets are written, and one comparison is made."""
    a = " ".join(f"a{i}" for i in range(60))
    rows = [(3, a)] * 2000 + [(7, a + " end")] * 2000 + [(9, a + " tail")]
    sizes, plain = {}, near_dedup.materialise

    def counted(df, name):
        out = plain(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "materialise", counted)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(16)).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, got)) == [(3, 3, 2000), (7, 3, 2000), (9, 3, 1)]
    assert sizes["sets"] == 3 and sizes["every_set"] <= 33 and sizes["links"] == 2


@pytest.mark.parametrize("by", [None, "x"])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_spread_join_is_a_join(spark, by, how, monkeypatch):
    monkeypatch.setattr(common, "HUB", 4)
    rows = spark.createDataFrame([(i % 3 if i < 40 else i, i % 7) for i in range(60)] + [(None, 1)] * 9 + [(99, 1)] * 9, "k int, x int")
    table = spark.createDataFrame([(i, f"v{i}") for i in (0, 2, 45, 50, 1000)], "k int, v string")
    hot = common.hubs(rows, "k", rows.count())
    assert {r["k"] for r in hot.collect()} == {0, 1, 2, 99, None}
    key = lambda df: sorted(map(str, df.select("k", "x", *(c for c in df.columns if c == "v")).collect()))
    if by is None or how != "left_semi":
        assert key(common.spread_join(rows, table, "k", hot, how, by)) == key(rows.join(table, "k", how)) == key(common.spread_join(rows, table, "k", None, how, by))
    assert common.hubs(rows, "k", 10**9) is None


def test_hot_buckets_change_nothing(spark, monkeypatch):
    """A family large enough to be found hot by the sample, beside pairs and strangers."""
    monkeypatch.setattr(near_dedup, "SAMPLE", 1)
    monkeypatch.setattr(common, "HUB", 8)
    monkeypatch.setattr(components_module, "HUB", 8)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"{i // 2}v{j}" for j in range(40)) + " end" * (i % 2)) for i in range(20)] + [(200 + i, rows[0][1]) for i in range(30)]
    assert found(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 5)) == brute.near_duplicates(rows, 5)


def test_texts_that_share_an_id(spark, odd_docs, no_docs):
    """Another text under the same id is no duplicate of it; copies go, whatever their id."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(3, a), (7, a + " end"), (7, b), (7, b), (7, b.upper()), (7, c), (8, c + " end"), (9, d), (5, None), (5, " "), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, version string").repartition(3)
    got = near_duplicate_filter(spark, docs, SMALL)
    assert got.columns == docs.columns
    found = [(r["doc_id"], r["text"] and r["text"].lower().split()[:1]) for r in got.collect()]
    texts = sorted(t[0] for i, t in found if i is not None and t)
    assert texts == ["a0", "b0", "c0", "d0"] and len(found) == 7
    assert (3, ["a0"]) in found and (7, ["b0"]) in found and [i for i, _ in found].count(5) == 1
    assert got.filter("doc_id IS NULL").count() == 2 and near_duplicate_filter(spark, no_docs, SMALL).count() == 0
    assert sorted(r["doc_id"] for r in near_duplicate_filter(spark, odd_docs, SMALL).filter("doc_id IS NOT NULL").collect()) == sorted(r["doc_id"] for r in keep_one(odd_docs, near_duplicates(odd_docs)).filter("doc_id IS NOT NULL").collect())


def test_shingle_hashes():
    texts = ["a b c a b", "A  B\tc", "", "b a", "é ü é ü"]
    values, sizes = sh.shingle_sets([t.encode() for t in texts], 2)
    assert sizes.tolist() == [len(brute.shingles(t, 2)) for t in texts]
    b = np.concatenate(([0], np.cumsum(sizes)))
    sets = [set(values[b[i] : b[i + 1]].tolist()) for i in range(len(texts))]
    assert len(sets[0] & sets[1]) == 2 and not sets[3] & sets[1]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
