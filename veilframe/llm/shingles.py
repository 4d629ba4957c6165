"""Vectorised word shingles: 64-bit hashes of k-word windows over whole texts.

Words are maximal runs of bytes other than space and 0x09-0x0D after A-Z are lower-cased. A word's
hash is a polynomial over a random byte table modulo 2**64, taken from prefix sums, so a whole chunk
of documents is hashed without a Python loop over words.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 2**64)
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_KEEP = 1 << 22  # powers that are kept for later texts


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = n if n > _KEEP else 1 << (n - 1).bit_length()
        made = []
        for base in (_P, _PINV):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        if n > _KEEP:
            return made[0], made[1]
        _pow[:] = made
    return _pow[0][:n], _pow[1][:n]


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, in order, and the number of words of each text."""
    lengths = np.array([0 if t is None else len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"\n".join(t or b"" for t in texts), np.uint8)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    buf = _LOWER[buf]
    word = ~_SPACE[buf]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up, out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    firsts = np.concatenate(([0], np.cumsum(lengths[:-1] + 1)))
    bounds = np.searchsorted(start, np.append(firsts, len(buf) + 1))
    return hashes, np.diff(bounds)


def shingle_sets(texts: list[bytes | None], k: int, hashed: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each text, concatenated and ascending, and the set sizes.

    Fewer than ``k`` words: the whole sequence is the one shingle. No words: the empty set. ``hashed`` are the
    texts' ``word_hashes`` if known.
    """
    words, counts = hashed or word_hashes(texts)
    n = len(words)
    acc = words.copy()
    for j in range(1, k):
        if n > j:
            acc[: n - j] = mix(acc[: n - j] * U64(0xD6E8FEB86659FD93) + words[j:])
    ends = np.cumsum(counts)
    starts = ends - counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    for i in short:
        h = words[starts[i] : starts[i] + 1].copy()
        for j in range(1, counts[i]):
            h = mix(h * U64(0xD6E8FEB86659FD93) + words[starts[i] + j])
        acc[starts[i]] = (mix(h + U64(int(counts[i]))))[0]
    out, sizes = [], np.zeros(len(texts), np.int64)
    for i in range(len(texts)):
        c = int(counts[i])
        if c:
            seg = np.sort(acc[starts[i] : starts[i] + max(1, c - k + 1)])
            if len(seg) > 1:
                seg = seg[np.concatenate(([True], seg[1:] != seg[:-1]))]
            out.append(seg)
            sizes[i] = len(seg)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def minhash(values: np.ndarray, sizes: np.ndarray, hashes: int, bits: int) -> np.ndarray:
    """``bits``-bit MinHash symbols, (texts, hashes); rows of empty sets are zero."""
    rng = np.random.default_rng(0xB17)
    mult = rng.integers(1, 2**63, hashes, dtype=np.uint64) * U64(2) + U64(1)
    salt = rng.integers(0, 2**63, hashes, dtype=np.uint64)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), hashes), np.uint16 if bits <= 16 else np.uint32)
    if len(full):
        starts = np.cumsum(sizes[full]) - sizes[full]
        for j in range(hashes):
            low = np.minimum.reduceat((values ^ salt[j]) * mult[j], starts)
            out[full, j] = mix(low) >> U64(64 - bits)
    return out
