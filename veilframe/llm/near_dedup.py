"""MinHash near-duplicate classes by a multi-index Hamming join.

Each distinct shingle set gets a signature of ``HASHES`` b-bit MinHash symbols. The signature is cut
into ``HASHES / CHUNK`` chunks; a chunk is indexed once per allowed error, with that symbol masked
out, so two signatures meet whenever some chunk differs in at most one symbol. By pigeonhole every
pair of signatures with at most ``2 * chunks - 1`` differing symbols meets (31 of 128 here; a pair of
similarity 0.8 differs in 25.6 on average), and pairs beyond that radius are still met unless every
chunk holds two errors or more: at similarity 0.8 a pair is lost with probability 1.4e-5, at 0.85
with 4e-8. Whatever meets is confirmed on full sets.

No bucket is expanded into pairs. A bucket is sorted and streamed once to drop lone members; then its
most popular members (those that meet most others over all buckets, so the core of a family of copies)
lead it. Because the result is the components, only sets not yet in one component need confirming:
(1) every set against the leader it shares most buckets with, (2) sets of buckets that still span
components against all leaders of those buckets, (3) where components still meet in a bucket, the members
outside the largest against all sets of the largest and against each other, both packed in blocks. A family of
n near copies so costs about n confirmations and never emits its pairs, and no qualifying pair that
meets is left out. Hot buckets, leaders, components and copies are found by counting, and joins deal their rows
over many tasks (``spread_join``); hot buckets skip the shuffle that drops lone members.

Defined results: null or blank text has the empty set, links with nothing and is its own component, whatever
other rows have its id. Rows with null ids carry a null component and are kept. Exact copies of a set fold into one
representative (128-bit fingerprint of the sorted set) before anything is indexed. An id with several texts is
one node that links as any of them does: its rows share a component, and its different sets are compared each. Rows that
repeat an id and set are compared once. Ties between leaders go to the smaller id.
Very long texts are hashed whole, a text at a time, with memory of about 40 bytes a byte. Repeated rows come
out each, an empty table gives no rows. Extra columns are ignored by ``near_duplicates`` and kept by the filters; of
rows that repeat an id, these keep the one whose content hashes lowest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from veilframe.llm import shingles as sh
from veilframe.llm.common import HUB, HUBS, discard, hubs, map_arrow, materialise, spread_join, text_chunks
from veilframe.llm.components import components

HASHES, BITS, CHUNK, LEADERS, PART, SAMPLE = 128, 16, 8, 4, 128, 64


def features(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, f1, f2, sig) for every row: set size, set fingerprint, signature."""

    def make():
        def each(b: pa.RecordBatch):
            for lo, hi in text_chunks(b, "text", 1 << 20):
                part = b.slice(lo, hi - lo)
                values, sizes = sh.shingle_sets(part.column("text").cast(pa.large_binary()).to_pylist(), k)
                sig = sh.minhash(values, sizes, HASHES, BITS)
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                f1, f2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
                full = np.flatnonzero(sizes)
                if len(full):
                    f1[full] = np.add.reduceat(sh.mix(values + np.uint64(0x1234567)), bounds[full])
                    f2[full] = np.add.reduceat(sh.mix(values ^ np.uint64(0x9E3779B97F4A7C15)), bounds[full])
                yield pa.record_batch(
                    [part.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary())],
                    ["doc_id", "n", "f1", "f2", "sig"],
                )

        return each

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id long, n long, f1 long, f2 long, sig binary")


def _keys(reps: DataFrame) -> DataFrame:
    """(key, node): one key for each chunk and each masked symbol."""

    def make():
        def each(b: pa.RecordBatch):
            node = b.column("node").to_numpy(zero_copy_only=False)
            for lo in range(0, len(node), 2048):
                ids = node[lo : lo + 2048]
                sig = np.frombuffer(b"".join(b.column("sig").slice(lo, len(ids)).to_pylist()), np.uint16)
                sig = sig.reshape(len(ids), HASHES // CHUNK, CHUNK).astype(np.uint64)
                place = np.arange(HASHES, dtype=np.uint64).reshape(HASHES // CHUNK, CHUNK)
                each_symbol = sh.mix((sig << np.uint64(16)) + place + np.uint64(1))
                masked = each_symbol.sum(axis=2, dtype=np.uint64)[:, :, None] - each_symbol
                key = sh.mix(masked + place * np.uint64(0x9E3779B97F4A7C15))
                yield pa.record_batch([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, HASHES))], ["key", "node"])

        return each

    return map_arrow(reps.select("node", "sig"), make, "key long, node long")


def _hot_keys(reps: DataFrame, n: int) -> DataFrame:
    """Keys of large buckets, from one node in ``SAMPLE``: at most ``HUBS`` of them. Which are found decides only
    how buckets are dealt, not what they hold."""
    some = _keys(reps.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0))
    return some.groupBy("key").agg(F.count("*").alias("k")).filter(F.col("k") > max(16, n * HASHES // SAMPLE // HUBS)).select("key")


def _members(keys: DataFrame, hot: DataFrame) -> DataFrame:
    """(key, node) of buckets with two members or more.

    Buckets known to be hot have many members and stay where they are. The rows of others arrive sorted
    by key; a bucket streams through with only its first member held back.
    """

    def run(batches):
        last = held = None  # the last key and its only member so far, if it has but one
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("key").to_numpy(zero_copy_only=False)
            node = b.column("node").to_numpy(zero_copy_only=False)
            if held is not None:
                key, node = np.append(last, key), np.append(held, node)
            same = key[1:] == key[:-1]
            take = np.append(False, same) | np.append(same, False)
            if held is None and last is not None and key[0] == last:
                take[0] = True
            last, held = key[-1], None if take[-1] else node[-1]
            if take.any():
                yield pa.record_batch([pa.array(key[take]), pa.array(node[take])], ["key", "node"])

    hot = materialise(hot, "hot")
    if hot.isEmpty():
        return keys.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, node long")
    named = F.broadcast(hot)
    laid = keys.join(named, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    return laid.mapInArrow(run, "key long, node long").unionByName(keys.join(named, "key", "left_semi").select("key", "node"))


def _mixed(members: DataFrame, labels: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(key, node, c) of the buckets that span components."""
    named = _with_component(members, labels)
    spans = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key")
    return spread_join(named, spans, "key", hot, "left_semi").select("key", "node", "c")


def _sets(docs: DataFrame, ids: DataFrame, repeated: DataFrame, k: int) -> DataFrame:
    """(node, set) of the wanted documents, sets as arrays of shingle hashes. A set that several rows of an id
    have comes once: a task emits it once, and the rows of ``repeated`` ids then meet."""

    def make():
        seen = set()

        def each(b: pa.RecordBatch):
            for lo, hi in text_chunks(b, "text", 1 << 20):
                part = b.slice(lo, hi - lo)
                values, sizes = sh.shingle_sets(part.column("text").cast(pa.large_binary()).to_pylist(), k)
                ends = np.cumsum(sizes)
                prints = [hashlib.blake2b(values[e - n : e].tobytes(), digest_size=16).digest() for e, n in zip(ends, sizes, strict=True)]
                new = []
                for key in zip(part.column("doc_id").to_pylist(), prints, strict=True):
                    new.append(key not in seen)
                    seen.add(key)
                offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                made = [part.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64))), pa.array(prints, pa.binary()), part.column("again")]
                yield pa.record_batch(made, ["node", "set", "print", "again"]).filter(pa.array(new))

        return each

    once_each = repeated.isEmpty()
    if once_each:
        marked = ids.withColumn("again", F.lit(None).cast("boolean"))
    else:  # a table of its own, whose size is known when the join is planned
        marked = materialise(ids.join(repeated.select(F.col("doc_id").alias("node"), F.lit(True).alias("again")), "node", "left"), "marked")
    wanted = docs.select("doc_id", "text").join(marked.withColumnRenamed("node", "doc_id"), "doc_id")
    sets = map_arrow(wanted, make, "node long, set array<long>, print binary, again boolean")
    if once_each:
        return sets.select("node", "set")
    sets = materialise(sets, "every_set")
    discard(marked)
    once = sets.filter("again").groupBy("node", "print").agg(F.first("set").alias("set"))
    return sets.filter("again IS NULL").select("node", "set").unionByName(once.select("node", "set"))


def _confirm(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` (a written table) that reach ``percent`` of Jaccard similarity on full sets. Many
    pairs may share an ``a``."""
    hot = hubs(pairs, "a", pairs.count())
    na, nb = (sizes.select(F.col("node").alias(x), F.col("lo").alias(f"l{x}"), F.col("hi").alias(f"h{x}")) for x in "ab")
    # An id with several texts has sets of several sizes.
    near = spread_join(pairs, na, "a", hot).join(nb, "b").filter((100 * F.col("ha") >= percent * F.col("lb")) & (100 * F.col("hb") >= percent * F.col("la"))).select("a", "b")
    left, right = (sets.select(F.col("node").alias(x), F.col("set").alias(f"s{x}")) for x in "ab")
    both = spread_join(near, left, "a", hot, by="b").join(right, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.filter(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def _with_component(nodes: DataFrame, labels: DataFrame, node: str = "node", component: str = "c") -> DataFrame:
    found = labels.select(F.col("node").alias(node), F.col("component").alias(component))
    return nodes.join(found, node, "left").withColumn(component, F.coalesce(component, node))


def _blocks(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, ids, sizes, values): the sets of every component packed into blocks of about 256 kB.

    ``nodes``: (node, c, w), w the component's number of sets: large components are dealt out in parts
    of about ``PART`` sets. Rows arrive sorted by component and part and stream through.
    """

    def run(batches):
        comp, ids, packs, held = None, [], [], 0

        def flush():
            sizes = np.array([len(p) for p in packs], np.int64)
            return pa.record_batch([pa.array([comp], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([sizes.tobytes()], pa.binary()), pa.array([np.concatenate(packs).tobytes()], pa.binary())], ["c", "ids", "sizes", "values"])

        for b in batches:
            for c, node, values in zip(b.column("c").to_pylist(), b.column("node").to_pylist(), b.column("set"), strict=True):
                if ids and (c != comp or held > 1 << 18):
                    yield flush()
                    ids, packs, held = [], [], 0
                comp = c
                ids.append(node)
                packs.append(values.values.to_numpy(zero_copy_only=False))
                held += 8 * len(packs[-1])
        if ids:
            yield flush()

    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("w") / PART)).alias("part")
    laid = nodes.select("node", "c", part).join(sets, "node").repartition("c", "part").sortWithinPartitions("c", "part")
    return laid.select("c", "node", "set").mapInArrow(run, "c long, ids binary, sizes binary, values binary")


def _confirm_blocks(meets: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, hot: DataFrame | None) -> DataFrame:
    """(a, b) links between the ``meets`` (node, c, w) and the ``nodes`` (node, c, w) of the same c: the
    sets of both sides are packed, and blocks meet blocks."""

    def make():
        def unpack(row: tuple):
            ids, sizes, values = (np.frombuffer(x, np.int64) for x in row)
            return ids, sizes, np.cumsum(sizes) - sizes, values

        def each(b: pa.RecordBatch):
            left, right = [], []
            cols = [b.column(c).to_pylist() for c in ("ids", "sizes", "values", "ids2", "sizes2", "values2")]
            for row in zip(*cols, strict=True):
                (ids, sizes, starts, values), (ids2, sizes2, starts2, values2) = unpack(row[:3]), unpack(row[3:])
                for node, n, at in zip(ids.tolist(), sizes.tolist(), starts.tolist(), strict=True):
                    own = np.sort(values[at : at + n])
                    found = np.minimum(np.searchsorted(own, values2), n - 1)
                    shared = np.add.reduceat((own[found] == values2).astype(np.int64), starts2)
                    linked = ids2[(100 * shared >= percent * (n + sizes2 - shared)) & (ids2 != node)]
                    left += [node] * len(linked)
                    right += linked.tolist()
            if left:
                yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

        return each

    wanted = spread_join(nodes, meets.select("c").distinct(), "c", hot, "left_semi")
    other = _blocks(wanted, sets).select("c", *(F.col(c).alias(f"{c}2") for c in ("ids", "sizes", "values")))
    both = spread_join(_blocks(meets, sets), other, "c", hot, by="ids").select("ids", "sizes", "values", "ids2", "sizes2", "values2")
    return map_arrow(both, make, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    feats = materialise(features(docs, k), "features")
    # Empty sets link with nothing: they never enter the index.
    full = feats.filter("n > 0 AND doc_id IS NOT NULL")
    reps = full.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "n", "sig")).alias("r"), F.count("*").alias("copies")).select("f1", "f2", F.col("r.doc_id").alias("node"), F.col("r.n").alias("n"), F.col("r.sig").alias("sig"), "copies")
    reps = materialise(reps, "reps")
    n = reps.count()
    members = materialise(_members(_keys(reps), _hot_keys(reps, n)), "members")
    met = materialise(members.select("node").distinct(), "met")
    ids = full.groupBy("doc_id").agg(F.min(F.struct("f1", "f2")).alias("lo"), F.max(F.struct("f1", "f2")).alias("hi"), F.count("*").alias("rows"))
    repeated = materialise(ids.filter("rows > 1").select("doc_id", (F.col("lo") != F.col("hi")).alias("several")), "repeated")
    sets = materialise(_sets(docs, met, repeated, k), "sets")
    sizes = materialise(reps.groupBy("node").agg(F.min("n").alias("lo"), F.max("n").alias("hi")), "sizes")

    hot = hubs(members, "key", members.count())
    big = members.groupBy("key").agg(F.count("*").alias("size"))
    popular = spread_join(members, big, "key", hot).groupBy("node").agg(F.sum("size").alias("meets"))
    ranked = members.join(popular, "node").withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("meets"), "node"))).filter(F.col("rank") <= LEADERS)
    leaders = materialise(ranked.select("key", F.col("node").alias("a"), "rank"), "leaders")

    stars = spread_join(members.withColumnRenamed("node", "b"), leaders.filter("rank = 1").drop("rank"), "key", hot).filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("met"))
    best = materialise(stars.groupBy("b").agg(F.max(F.struct("met", "a")).alias("x")).select("b", F.col("x.a").alias("a")), "best")
    links = materialise(_confirm(best, sets, sizes, percent).unionByName(_same_id(full, reps, repeated.filter("several"))), "links")
    labels = materialise(components(links), "labels")

    spread = materialise(_mixed(members, labels, hot), "spread")
    # A member meets the leaders of other components only; at most LEADERS a key.
    led = _with_component(leaders, labels, "a", "ca").groupBy("key").agg(F.collect_list(F.struct("a", "ca")).alias("all"))
    others = F.explode(F.filter("all", lambda x: x["ca"] != F.col("c"))).alias("x")
    across = spread_join(spread.withColumnRenamed("node", "b"), led, "key", hot).select("b", others).select(F.col("x.a").alias("a"), "b").distinct()
    across = materialise(across, "across")
    first, links = links, materialise(links.unionByName(_confirm(across, sets, sizes, percent)), "links")
    old, labels = labels, materialise(components(links), "labels")
    discard(first, old)

    mixed, spread = spread, materialise(_mixed(spread.select("key", "node"), labels, hot), "spread")
    if not spread.isEmpty():
        named = materialise(_with_component(met, labels), "named")
        wide = hubs(named, "c", named.count())
        weight = named.groupBy("c").agg(F.count("*").alias("w"))
        nodes = materialise(spread_join(named, weight, "c", wide).select("node", "c", "w"), "nodes")
        # Of a mixed bucket, everything outside its largest component is a satellite of that component. Two
        # members from different components are then a satellite and a member, or two satellites, of one.
        largest = spread_join(spread, weight, "c", wide).groupBy("key").agg(F.max(F.struct("w", "c")).alias("x")).select("key", F.col("x.c").alias("core"))
        meets = materialise(spread_join(spread, largest, "key", hot).filter("c <> core").select("node", F.col("core").alias("c")).distinct(), "meets")
        meets = materialise(spread_join(meets, meets.groupBy("c").agg(F.count("*").alias("w")), "c", hubs(meets, "c", meets.count())).select("node", "c", "w"), "meets")
        old, labels = labels, materialise(components(links.unionByName(_confirm_blocks(meets, nodes.unionByName(meets), sets, percent, wide))), "labels")
        discard(named, nodes, meets, old)
    discard(members, leaders, sets, sizes, mixed, spread, met, best, across, links, repeated)

    named = reps.join(labels, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("component_id"), "copies")
    copied = reps.filter(F.col("copies") > max(HUB, feats.count() // HUBS)).select("f1", "f2")  # at most HUBS sets
    linked = spread_join(full.select("doc_id", "n", "f1", "f2"), named.drop("copies"), ["f1", "f2"], copied)
    alone = feats.filter("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = linked.select("doc_id", "n", "component_id").unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _same_id(full: DataFrame, reps: DataFrame, several: DataFrame) -> DataFrame:
    """(a, b) links between the representatives of an id's several sets."""
    if several.isEmpty():
        return several.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    sets = full.select("doc_id", "f1", "f2").distinct().join(several, "doc_id", "left_semi").join(reps.select("f1", "f2", "node"), ["f1", "f2"])
    return sets.select(F.col("node").alias("a"), F.col("doc_id").alias("b")).filter("a <> b").distinct()


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that their component keeps; of rows repeating an id one stays."""
    kept = found.filter(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL")
    if not named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        row = F.struct(*docs.columns)
        named = named.groupBy("doc_id").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")).select("row.*")
    return named.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def distinct_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one of every group of near duplicates does.

    Texts that share an id are told apart: the further ones are looked at under ids of their own above
    all others, so a text of its own stays whatever its id's other rows duplicate.
    """
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    version = F.when(blank, F.lit(0).cast("long")).otherwise(F.xxhash64("text"))
    versions = docs.filter("doc_id IS NOT NULL").select("doc_id", version.alias("version"))
    several = materialise(versions.groupBy("doc_id").agg(F.min("version").alias("first"), F.max("version").alias("last")).filter("first <> last"), "several")
    if several.isEmpty():
        return keep_one(docs, near_duplicates(docs, k, percent))
    top = docs.agg(F.max("doc_id")).first()[0]
    further = versions.distinct().join(several, "doc_id").filter("version <> first").select("doc_id", "version")
    further = materialise(further.withColumn("own_id", F.monotonically_increasing_id() + F.lit(top + 1)), "further")
    left = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", version.alias("version"))
    hot = hubs(versions, ["doc_id", "version"], docs.count())
    named = spread_join(left, further, ["doc_id", "version"], hot, "left").select("row", "text", F.coalesce("own_id", F.col("doc_id").cast("long")).alias("doc_id"))
    return keep_one(named, near_duplicates(named, k, percent)).select("row.*")
