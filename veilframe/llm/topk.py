"""Exact top-k inner-product search by MaxScore.

Every dimension is a query term with a posting list: a shard keeps the values of each dimension as one
contiguous list with its smallest and largest value. For a query, a term's score bound in a shard is the
largest product it can contribute there, its floor the smallest. Terms are taken by falling spread
between the two; as many are essential as it takes for a candidate at their floor to stay below the
threshold (the k-th best score so far) whatever the rest adds. Essential postings are traversed for all candidates; the others are probed, a few terms
at a time, only for candidates whose score so far plus the remaining bounds still reaches the threshold.
Ties at the threshold are kept, so the result is exact. Each (query group, shard) pair gives k rows a query at most and a ranked merge follows.

Vectors become integers, ``floor(scale * x)`` with x as double, kept in the narrowest of 2, 4 and 8 bytes. Shards
hold about ``SHARD`` vectors and ``BYTES`` at most, as groups of queries do, dealt by hash; a shard's vectors and its queries meet in one task, which reads every
vector once for each ``GROUP`` queries. Queries go to every shard, so what is shuffled is the table for each
group of queries and the queries for each shard.

Defined results: vectors that are null or empty or hold null or non-finite components take no part. Vectors are
compared with those of the same length only, whatever their length. A repeated row (same id and vector) counts
once; rows with a query's id are never its candidates. A component that no 64-bit integer holds after scaling counts as
non-finite. Where products could leave 64 bits they are summed as unbounded integers: ranks are exact, and a score
beyond the range of a long is given as its nearest value. Ties go to the smaller id. Rows with null ids take no part.
Fewer than k candidates: all of them; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import map_arrow, materialise

SHARD, GROUP, BYTES, STEP = 16_384, 65_536, 1 << 26, 8
TOP = (1 << 63) - 1
_KINDS = (np.int16, np.int32, np.int64)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, dim, v) of the vectors that take part, each once; v are little-endian integers."""

    def make():
        def each(b: pa.RecordBatch):
            ids, lists = b.column("vec_id"), b.column("v")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ints = np.floor(flat * scale).astype(np.int64)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            out = []
            for lo, hi in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
                own = ints[lo:hi]
                most = int(max(own.max(), -own.min() - 1))
                out.append(own.astype(next(k for k in _KINDS if most <= np.iinfo(k).max)).tobytes())
            yield pa.record_batch([ids, pa.array(np.diff(ends, prepend=0).astype(np.int32)), pa.array(out, pa.binary())], ["vec_id", "dim", "v"])

        return each

    v = F.col("embedding")
    held = lambda x: (x.cast("double") * scale >= -(2.0**63)) & (x.cast("double") * scale < 2.0**63)  # noqa: E731  not so for nan
    fit = v.isNotNull() & (F.size(v) > 0) & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & held(x))
    rows = vectors.filter(fit).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    return map_arrow(rows, make, "vec_id long, dim int, v binary").distinct()


def _matrix(v: pa.ChunkedArray, dim: int) -> np.ndarray:
    """(vectors, dim) of vectors of any width."""
    blobs = v.to_pylist()
    out = np.empty((len(blobs), dim), np.int64)
    width = np.array([len(x) for x in blobs], np.int64) // dim
    for kind in _KINDS:
        at = np.flatnonzero(width == np.dtype(kind).itemsize)
        if len(at):
            out[at] = np.frombuffer(b"".join([blobs[i] for i in at]), kind).reshape(len(at), dim)
    return out


class Shard:
    """Posting lists of one shard."""

    def __init__(self, ids: np.ndarray, postings: np.ndarray):
        self.ids = ids
        self.low, self.high = postings.min(axis=1), postings.max(axis=1)
        # Sums of products are exact in float32 below 2**24, in float64 below 2**53, in int64 below 2**63.
        self.peak = max(int(self.high.max(initial=0)), -int(self.low.min(initial=0)))
        self.postings = {np.int64: postings}

    def kind(self, query: np.ndarray):
        most = len(query) * self.peak * max(int(query.max(initial=0)), -int(query.min(initial=0)))
        return next((kind for kind, bits in ((np.float32, 24), (np.float64, 53), (np.int64, 62)) if most < 1 << bits), object)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and scores of the k best, by falling score, then id."""
        kind, exact = self.kind(query), np.int64
        if kind is object:
            query, exact = query.astype(object), object
        if kind not in self.postings:
            self.postings[kind] = self.postings[np.int64].astype(kind)
        posts, q = self.postings[kind], query.astype(kind)
        bound = np.maximum(query * self.low, query * self.high)
        floor = np.minimum(query * self.low, query * self.high)
        terms = np.argsort(-(bound - floor), kind="stable")
        rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # what terms from i on can still add
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, exact)
        for lo in range(0, len(self.ids), 4096):
            ids = self.ids[lo : lo + 4096]
            block = posts[:, lo : lo + 4096]
            threshold = best[k - 1] if len(best) >= k else None
            live, done = np.arange(len(ids)), 0
            if threshold is None:
                score = q @ block
            else:
                if rest[0] < threshold:
                    continue
                # A candidate at the floor of the essential terms can't reach the threshold any more.
                spread = np.cumsum((bound - floor)[terms])
                essential = int(np.searchsorted(spread, rest[0] - threshold, "right")) + 1
                done = min(essential, len(terms))
                score = q[terms[:done]] @ block[terms[:done]]
                while True:
                    keep = score + rest[done] >= threshold
                    live, score = live[keep], score[keep]
                    if done == len(terms) or not len(live):
                        break
                    more = terms[done : done + STEP]
                    score = score + q[more] @ block[more][:, live]
                    done += len(more)
            other = ids[live] != own
            found_ids, found = np.append(best_ids, ids[live][other]), np.append(best, score[other].astype(exact))
            order = np.argsort(found_ids, kind="stable")
            order = order[np.argsort(-found[order], kind="stable")][:k]
            best_ids, best = found_ids[order], found[order]
        return best_ids, best


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row where ``is_query`` (of vec_id) holds."""
    rows = materialise(quantised(vectors, scale), "vectors")
    queries = rows.filter(is_query)
    # Hashing deals unevenly: parts are made for half as many rows as they may hold.
    parts = lambda size: F.ceil(2 * F.col("count") / F.greatest(F.lit(2), F.least(F.lit(size), F.floor(F.lit(BYTES) / (8 * F.col("dim"))))))
    shards, groups = (df.groupBy("dim").count().agg(F.max(parts(size))).first()[0] or 1 for df, size in ((rows, SHARD), (queries, GROUP)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    held = rows.withColumn("shard", dealt(shards)).withColumn("part", every(groups))
    asked = queries.withColumn("part", dealt(groups)).withColumn("shard", every(shards))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.binary()))})
        dim = left.column("dim")[0].as_py()
        shard = Shard(left.column("vec_id").to_numpy(), np.ascontiguousarray(_matrix(left.column("v"), dim).T))
        q_ids, asks = right.column("vec_id").to_numpy(), _matrix(right.column("v"), dim)
        found = [shard.search(q, int(i), k) for i, q in zip(q_ids, asks, strict=True)]
        sizes = [len(f[0]) for f in found]
        scores = [int(x) for f in found for x in f[1]]
        # A score that a long does not hold goes along in 64 bytes that sort as it does.
        beyond = [None if -TOP <= x <= TOP else (x + (1 << 511)).to_bytes(64, "big") for x in scores]
        return pa.table({"query_id": np.repeat(q_ids, sizes), "vec_id": np.concatenate([f[0] for f in found]), "score": pa.array([max(-TOP - 1, min(TOP, x)) for x in scores], pa.int64()), "beyond": pa.array(beyond, pa.binary())})

    keys = ("dim", "shard", "part")
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long, beyond binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
