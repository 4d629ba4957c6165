"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; unlabelled documents of the corpus stand for everything
else, toxic ones included. A linear classifier over the presence of hashed words and word beginnings
is trained in numpy on the class-prior-corrected risk

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

with the sigmoid loss; where the bracket turns negative its gradient is reversed (non-negative
correction), so the model can't earn risk by memorising the positives. The class prior is the share of
toxic rows among the labels that may be learned from, unless given.

Bounds: at most ``POSITIVES`` toxic and ``UNLABELLED`` unlabelled documents, in hash order of the id,
and the ``VOCABULARY`` hashed features that separate them most are used to fit. Of these documents, one that
shares 7 of 32 minhashes of its features (a similarity of about 0.22) with an earlier one of its side is left
out of the fit: more than half of them on larger tables (README). Whole texts of all documents are scored.

Defined results: null text is empty; a text without words scores the bias alone. Several labels of one
id count as the highest; rows that repeat an id are scored each, and one of them is learned from, that whose text hashes
lowest. Rows with a null id are scored and not learned from. Without positives every score is the prior (0 if there
are no labels). An empty table gives no rows. A very long text is read whole, with memory of about 60 bytes a byte. Extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm import shingles as sh
from veilframe.llm.common import map_arrow, text_chunks
from veilframe.llm.labelled import first_by_hash, texts_of

POSITIVES, UNLABELLED, VOCABULARY, EVIDENCE, CUT = 2000, 6000, 1000, 12.0, 0.3
HASH_BITS, BEGINNINGS = 32, (4, 5, 6)

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


def feature_ids(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text (concatenated, ascending) and their counts."""
    buf = sh._LOWER[np.frombuffer(b"\n".join(t or b"" for t in texts), np.uint8)]
    lengths = np.array([0 if t is None else len(t) for t in texts], np.int64)
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    edge = np.diff(_LETTER[buf].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = sh._powers(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(sh._BYTE[buf] * up, out=sums[1:])
    firsts = np.concatenate(([0], np.cumsum(lengths[:-1] + 1)))
    row = np.searchsorted(firsts, start, "right") - 1
    ids, rows = [], []
    for j, size in enumerate((0, *BEGINNINGS)):
        take = slice(None) if not size else end - start >= size
        s = start[take]
        e = end[take] if not size else s + size
        h = sh.mix((sums[e] - sums[s]) * down[s] + np.uint64(j + 1))
        ids.append((h >> np.uint64(64 - HASH_BITS)).astype(np.int64))
        rows.append(row[take])
    key = np.unique((np.concatenate(rows) << HASH_BITS) | np.concatenate(ids))
    return key & ((1 << HASH_BITS) - 1), np.bincount(key >> HASH_BITS, minlength=len(texts))


@dataclass
class PUModel:
    features: np.ndarray  # ascending feature ids
    weights: np.ndarray
    bias: float

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        x = _matrix(*feature_ids(texts), self.features)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def _matrix(ids: np.ndarray, counts: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Presence of ``features`` (columns) in each text."""
    x = np.zeros((len(counts), len(features)), np.float32)
    if len(features) and len(ids):
        at = np.minimum(np.searchsorted(features, ids), len(features) - 1)
        hit = features[at] == ids
        x[np.repeat(np.arange(len(counts)), counts)[hit], at[hit]] = 1
    return x


def _telling(positive: tuple, unlabelled: tuple, prior: float, vocabulary: int) -> np.ndarray:
    """The features that speak for toxicity at the class prior, P(toxic | feature) = prior * p / u >=
    CUT, and whose count among the positives is beyond chance by the Poisson large-deviation bound
    exp(-EVIDENCE), which leaves about three by chance in half a million features."""
    n_p, n_u = len(positive[1]), len(unlabelled[1])
    ids, count = np.unique(positive[0], return_counts=True)
    ids, count = ids[count > 1], count[count > 1]
    if not len(ids):
        return ids
    at = np.searchsorted(ids, unlabelled[0])
    hit = ids[np.minimum(at, len(ids) - 1)] == unlabelled[0]
    u = (np.bincount(at[hit], minlength=len(ids)) + 1) / n_u
    by_chance = n_p * u
    evidence = np.where(prior * count < CUT * by_chance, 0, count * np.log(count / by_chance) - (count - by_chance))
    top = np.argsort(-evidence, kind="stable")[:vocabulary]
    return np.sort(ids[top[evidence[top] > EVIDENCE]])


def _spread_out(ids: np.ndarray, counts: np.ndarray, hashes: int = 32, shared: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Without documents that look like copies of an earlier one: what copies repeat is no evidence."""
    full = np.flatnonzero(counts)
    ends = np.cumsum(counts)
    rng = np.random.default_rng(1)
    mins = np.stack([np.minimum.reduceat(sh.mix(ids.astype(np.uint64) ^ salt), (ends - counts)[full]) for salt in rng.integers(0, 2**63, hashes, dtype=np.uint64)], axis=1) if len(full) else np.zeros((0, hashes))
    seen: dict[tuple[int, int], set[int]] = {}
    kept = []
    for row, sig in zip(full, mins.tolist(), strict=True):
        met: dict[int, int] = {}
        for at in enumerate(sig):
            for other in seen.get(at, ()):
                met[other] = met.get(other, 0) + 1
        if max(met.values(), default=0) < shared:
            kept.append(int(row))
            for at in enumerate(sig):
                seen.setdefault(at, set()).add(int(row))
    take = np.zeros(len(counts), bool)
    take[kept] = True
    return ids[np.repeat(take, counts)], counts[take]


def fit(positive: tuple, unlabelled: tuple, prior: float, vocabulary: int = VOCABULARY, steps: int = 300, decay: float = 1e-4, rate: float = 0.05) -> PUModel:
    """``positive`` and ``unlabelled``: (feature ids, counts) as ``feature_ids`` returns them."""
    positive, unlabelled = _spread_out(*positive), _spread_out(*unlabelled)
    n_p, n_u = len(positive[1]), len(unlabelled[1])
    prior = min(max(prior, 0.0), 0.9)
    b = float(np.log(max(prior, 1e-12) / (1 - prior)))
    if not n_p or not n_u or not prior:
        return PUModel(np.zeros(0, np.int64), np.zeros(0, np.float32), b)
    features = _telling(positive, unlabelled, prior, vocabulary)
    xp, xu = _matrix(*positive, features), _matrix(*unlabelled, features)
    w, m, v = np.zeros(len(features)), np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    sig = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
    for step in range(1, steps + 1):
        sp, su = xp @ w + b, xu @ w + b
        # loss(+) = sig(-s) and loss(-) = sig(s), whose derivatives are -slope and slope
        fp, fu = sig(sp), sig(su)
        slope_p, slope_u = prior * fp * (1 - fp) / n_p, fu * (1 - fu) / n_u
        bracket = fu.mean() - prior * fp.mean()
        cp, cu = (-2 * slope_p, slope_u) if bracket >= 0 else (slope_p, -slope_u)
        grad = np.append(xp.T @ cp + xu.T @ cu + decay * w, cp.sum() + cu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return PUModel(features, w.astype(np.float32), float(b))


def train(docs: DataFrame, labels: DataFrame, allowed: DataFrame, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> PUModel:
    """``labels``: (doc_id, label) that may be learned from; ``allowed``: doc_id of unlabelled texts."""
    best = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    if prior is None:
        prior = best.agg(F.avg("label")).first()[0] or 0.0
    chosen = first_by_hash(best.filter("label = 1").select("doc_id"), positives).withColumn("p", F.lit(1)).unionByName(first_by_hash(allowed.filter("doc_id IS NOT NULL").select("doc_id").distinct(), unlabelled).withColumn("p", F.lit(0)))

    def make():
        def each(b: pa.RecordBatch):
            for lo, hi in text_chunks(b, "text", 1 << 20):
                part = b.slice(lo, hi - lo)
                ids, counts = feature_ids(part.column("text").cast(pa.large_binary()).to_pylist())
                ends = np.cumsum(counts)
                blobs = [ids[e - c : e].astype(np.uint32).tobytes() for e, c in zip(ends, counts, strict=True)]
                yield pa.record_batch([part.column("p").cast(pa.int32()), pa.array(blobs, pa.binary())], ["p", "ids"])

        return each

    got = map_arrow(texts_of(docs, chosen).select("p", "text"), make, "p int, ids binary").toArrow()
    kind, blobs = got.column("p").to_numpy(), got.column("ids").to_pylist()
    sides = []
    for side in (1, 0):
        mine = [np.frombuffer(x, np.uint32) for x, k in zip(blobs, kind, strict=True) if k == side]
        sides.append((np.concatenate(mine).astype(np.int64) if mine else np.zeros(0, np.int64), np.array([len(x) for x in mine], np.int64)))
    return fit(*sides, prior)


def score(docs: DataFrame, model: PUModel, cut: float = CUT) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY weights

    def make():
        own: PUModel = shared.value

        def each(b: pa.RecordBatch):
            for lo, hi in text_chunks(b, "text", 1 << 20):
                part = b.slice(lo, hi - lo)
                p = own.score(part.column("text").cast(pa.large_binary()).to_pylist())
                yield pa.record_batch([part.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, score double, predicted int")
