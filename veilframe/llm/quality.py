"""Quality scores by Bradley-Terry pairwise ranking.

A document's features are the frequencies of pairs of adjacent character classes over its whole text,
word repetition ratios and word lengths. Weights are learned from preference pairs (a document
labelled good over one labelled bad) by the logistic loss on feature differences. The threshold is the
quantile of the training scores at the share of bad documents; a score is mapped to (0, 1) so that the
threshold falls on ``CUT``.

Bounds: at most ``SAMPLE`` labelled documents, in hash order of the id, and ``PAIRS`` preference pairs are
used to fit. All documents are scored.

Defined results: null text is empty; an empty text has the all-zero features and a score like any
other, an empty table gives no rows. Several labels of one id count as the highest; of rows that repeat an id
each is scored, and one is learned from, that whose text hashes lowest. Rows with a null id are scored and not learned from. Equal scores at the threshold are kept. With labels of one class or none
there are no preferences: every score is the share of good labels, or 0.5. A very long text is read whole, with memory
of about 30 bytes a byte. Extra columns are kept by ``keep_good`` and ignored otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm import shingles as sh
from veilframe.llm.common import fold, map_arrow, return_memory, text_chunks
from veilframe.llm.labelled import first_by_hash, texts_of

SAMPLE, PAIRS, CUT = 6000, 40_000, 0.3

_PUNCT = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""
_CLASS = np.full(256, 5, np.uint8)
_CLASS[:128] = 6
_CLASS[[0x20, 0x09]] = 0
_CLASS[[0x0A, 0x0D]] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = 3
_CLASS[ord("0") : ord("9") + 1] = 4
_CLASS[list(_PUNCT)] = 7 + np.arange(len(_PUNCT))
CLASSES = int(_CLASS.max()) + 1
WIDTH = CLASSES * CLASSES + 5


def features(texts: list[bytes | None]) -> np.ndarray:
    """(texts, WIDTH) float32."""
    lengths = np.array([0 if t is None else len(t) for t in texts], np.int64)
    codes = _CLASS[np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)]
    row = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    out = np.zeros((len(texts), WIDTH), np.float32)
    if len(codes):
        same = row[1:] == row[:-1]
        pair = (row[:-1] * np.int32(CLASSES * CLASSES) + codes[:-1] * np.int32(CLASSES) + codes[1:])[same]
        counts = np.bincount(pair, minlength=len(texts) * CLASSES * CLASSES).reshape(len(texts), -1)
        out[:, : CLASSES * CLASSES] = np.sqrt(counts / np.maximum(1, lengths - 1)[:, None])
        words, n = hashed = sh.word_hashes(texts)
        of = np.repeat(np.arange(len(texts)), n)
        repeated = np.bincount(of[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])], minlength=len(texts)) if len(words) > 1 else np.zeros(len(texts))
        some = np.maximum(1, n)
        for j, k in enumerate((1, 3)):
            out[:, CLASSES * CLASSES + j] = sh.shingle_sets(texts, k, hashed)[1] / np.maximum(1, n - k + 1)
        out[:, CLASSES * CLASSES + 2] = repeated / some
        out[:, CLASSES * CLASSES + 3] = np.minimum(lengths / some, 50) / 10
        out[:, CLASSES * CLASSES + 4] = np.log1p(n) / 10
    return out


@dataclass
class Ranker:
    mean: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float
    cut: float
    flat: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        z = ((x - self.mean) @ self.weights - self.threshold) / self.scale + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, cut: float = CUT, steps: int = 400, decay: float = 1e-3, seed: int = 0) -> Ranker:
    """Bradley-Terry: P(i over j) = sigmoid(w (x_i - x_j)), fitted by Adam on random preference pairs."""
    yes, no = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(yes) or not len(no):
        return Ranker(np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 1.0, cut, float(np.mean(good)) if len(good) else 0.5)
    rng = np.random.default_rng(seed)
    i, j = rng.choice(yes, pairs), rng.choice(no, pairs)
    mean = x.mean(axis=0)
    z = x - mean  # the only copy of the features
    spread = np.sqrt(sum((z[lo : lo + 512] ** 2).sum(axis=0) for lo in range(0, len(z), 512)) / len(z))
    gain = np.where(spread > 1e-6, 1 / np.maximum(spread, 0.02), 0).astype(np.float32)
    z *= gain
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for step in range(1, steps + 1):
        s = slice((step * 2048) % pairs, (step * 2048) % pairs + 2048)
        d = z[i[s]] - z[j[s]]
        push = (1 / (1 + np.exp(np.clip(d @ w.astype(np.float32), -30, 30)))).astype(np.float32)
        grad = decay * w - push @ d / len(d)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    ranked = z @ w.astype(np.float32)
    scores, k = np.sort(ranked), len(no)
    threshold = float(scores[k - 1] + scores[k]) / 2
    scale = max(1e-6, float(np.median(ranked[yes]) - np.median(ranked[no])) / 8)
    return Ranker(mean, w * gain, threshold, scale, cut)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranker:
    """``labels``: (doc_id, label) rows that may be learned from."""
    best = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = texts_of(docs, first_by_hash(best, sample))

    def make():
        def each(b: pa.RecordBatch):
            for lo, hi in text_chunks(b, "text", 1 << 20):
                part = b.slice(lo, hi - lo)
                x = features(part.column("text").cast(pa.large_binary()).to_pylist())
                yield pa.record_batch([part.column("label").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])

        return each

    got = map_arrow(rows.select("label", "text"), make, "label int, x binary").toArrow()
    labels, held = got.column("label").to_numpy(), got.column("x").combine_chunks()
    del got
    # The features as Arrow holds them, one row after the other.
    x = np.frombuffer(held.buffers()[2] or b"", np.float32, len(held) * WIDTH, 4 * WIDTH * held.offset).reshape(-1, WIDTH) if len(held) else np.zeros((0, WIDTH), np.float32)
    ranker = fit(x, labels)
    del x, held
    return_memory()
    return ranker


def _each(ranker: Ranker, then):
    def make():
        def each(b: pa.RecordBatch):
            for lo, hi in text_chunks(b, "text", 1 << 20):
                part = b.slice(lo, hi - lo)
                yield then(part, ranker.score(features(part.column("text").cast(pa.large_binary()).to_pylist())))

        return each

    return make


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``."""
    then = lambda part, p: pa.record_batch([part.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= ranker.cut).astype(np.int32))], ["doc_id", "score", "predicted"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), _each(ranker, then), f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows of ``docs``, all columns, that reach the cut."""
    return map_arrow(docs, _each(ranker, lambda part, p: part.filter(pa.array(p >= ranker.cut))), docs.schema)


def learnable(labels: DataFrame, column: str, modulus: int, held: int) -> DataFrame:
    return labels.filter(fold("doc_id", modulus) != held).select("doc_id", F.col(column).alias("label"))
