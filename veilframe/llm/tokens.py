"""Whole-text tokenisation with a public tokenizer, through a table of its pre-tokens.

A byte-pair tokenizer first cuts a text by a fixed pattern and then encodes each cut on its own. Here
the cuts of a batch of texts are found and hashed with array operations, by the same pattern written out
for a safe alphabet (ASCII without the apostrophe, Latin letters with marks, space and line feed), and
their ids are looked up in a table keyed by a 96-bit hash. Cuts not yet in the table are encoded together
in one call, divided by a mark that no cut holds. Texts with any other character are encoded whole by the
tokenizer. Results are the tokenizer's own either way.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

from veilframe.llm.shingles import U64, mix

PIECE = 1 << 18
SLOTS = 1 << 21  # of the table, which is emptied when half full: 24 MB
_UNSAFE = re.compile("[^A-Za-zÀ-ÖØ-öø-įı-ſ0-9\\n -&(-~]")
_GAP = re.compile(r"(?<=\S) (?=\S)")
_TOP = 0x180
_SEPARATOR, _LETTER, _DIGIT, _SIGN, _WHITE = range(5)
_CLASS = np.full(_TOP, _SIGN, np.int8)
_CLASS[0] = _SEPARATOR
_CLASS[[0x0A, 0x20]] = _WHITE
for _lo, _hi, _kind in ((0x30, 0x39, _DIGIT), (0x41, 0x5A, _LETTER), (0x61, 0x7A, _LETTER), (0xC0, 0xD6, _LETTER), (0xD8, 0xF6, _LETTER), (0xF8, _TOP - 1, _LETTER)):
    _CLASS[_lo : _hi + 1] = _kind

_rng = np.random.default_rng(0x70C)
_VALUES = _rng.integers(1, 2**63, (2, _TOP), dtype=np.uint64) | U64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power_tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    if not _powers or len(_powers[0][0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers.clear()
        for base in _BASES:
            both = []
            for b in (base, pow(base, -1, 2**64)):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                both.append(np.multiply.accumulate(a))
            _powers.append((both[0], both[1]))
    return _powers


def cuts(x: np.ndarray, keeps_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all cuts of texts given as code points, each text followed by a zero."""
    c = _CLASS[x]
    change = np.append(True, c[1:] != c[:-1])
    bounds = np.flatnonzero(change)
    kind, after = c[bounds], np.append(bounds[1:], len(x))
    solid = (kind != _WHITE) & (kind != _SEPARATOR)
    start, end = bounds[solid], after[solid]
    if not keeps_space:
        digits = np.flatnonzero((c == _DIGIT) & ~change)  # every digit is a cut of its own
        if len(digits):
            inner = kind[solid] == _DIGIT
            end = np.where(inner, start + 1, end)
            start, end = np.append(start, digits), np.append(end, digits + 1)
            order = np.argsort(start, kind="stable")
            start, end = start[order], end[order]
        return start, end
    start = start - (x[np.maximum(start, 1) - 1] == 0x20) * (start > 0)
    lo, hi = bounds[kind == _WHITE], after[kind == _WHITE]
    ends_text = c[np.minimum(hi, len(x) - 1)] == _SEPARATOR
    spaced = x[hi - 1] == 0x20
    # At the end of a text a run is one cut; else its last character is apart, and if a space, the next cut's.
    body = np.where(ends_text, hi, hi - 1)
    alone = ~ends_text & ~spaced
    more_start = np.concatenate((lo[body > lo], hi[alone] - 1))
    more_end = np.concatenate((body[body > lo], hi[alone]))
    if len(more_start):
        start, end = np.concatenate((start, more_start)), np.concatenate((end, more_end))
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
    return start, end


class CutEncoder:
    """``encode_all(texts)`` gives each text's ids as little-endian unsigned integers of ``dtype``.

    ``keeps_space``: the tokenizer makes a leading space part of a token (byte-level); otherwise it
    drops white space and case.
    """

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keeps_space = Tokenizer.from_file(path), keeps_space
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.sign, self.mark = ("\r", "\r") if keeps_space else ("~", " ~ ")
        (self.mark_id,) = self._ids(self.mark)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self._clear()

    def _clear(self) -> None:
        self.keys, self.entry = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.used = self.filled = 0
        self.check, self.first = np.zeros(1024, np.uint32), np.zeros(1025, np.int64)
        self.pool = np.zeros(4096, self.dtype)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    # -- the table: open addressing, probed for whole arrays at a time --------------------------------

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        out, todo = np.full(len(key), -1, np.int64), np.arange(len(key))
        at = (key >> U64(20)).astype(np.int64) & (SLOTS - 1)
        while len(todo):
            held = self.keys[at]
            hit = held == key[todo]
            out[todo[hit]] = self.entry[at[hit]]
            on = ~hit & (held != 0)
            todo, at = todo[on], (at[on] + 1) & (SLOTS - 1)
        return out

    def _insert(self, key: np.ndarray, entry: np.ndarray) -> None:
        """``key``: distinct and not in the table."""
        at = (key >> U64(20)).astype(np.int64) & (SLOTS - 1)
        while len(key):
            free = self.keys[at] == 0
            self.keys[at[free]] = key[free]
            won = free & (self.keys[at] == key)
            self.entry[at[won]] = entry[won]
            key, entry, at = key[~won], entry[~won], (at[~won] + 1) & (SLOTS - 1)

    def _encode_cuts(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(texts)
        together = []
        for i, t in enumerate(texts):
            if t.isspace() or self.sign in t:
                out[i] = self._ids(t)
            else:
                together.append(i)
        for lo in range(0, len(together), 8192):
            some = together[lo : lo + 8192]
            ids = self._ids(self.mark + self.mark.join([texts[i] for i in some]) + self.mark)
            at = np.flatnonzero(ids == self.mark_id)
            if len(at) != len(some) + 1:
                raise ValueError("the tokenizer does not cut texts as expected")
            for i, a, b in zip(some, (at[:-1] + 1).tolist(), at[1:].tolist(), strict=True):
                out[i] = ids[a:b]
        return out

    def _learn(self, key: np.ndarray, check: np.ndarray, texts: list[str]) -> None:
        ids = self._encode_cuts(texts)
        n, sizes = len(ids), np.array([len(x) for x in ids], np.int64)
        while self.used + n > len(self.check):
            self.check = np.append(self.check, np.zeros_like(self.check))
            self.first = np.append(self.first, np.zeros(len(self.first) - 1, np.int64))
        while self.filled + int(sizes.sum()) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.check[self.used : self.used + n] = check
        self.first[self.used + 1 : self.used + n + 1] = self.filled + np.cumsum(sizes)
        self.pool[self.filled : self.filled + int(sizes.sum())] = np.concatenate(ids)
        self._insert(key, np.arange(self.used, self.used + n, dtype=np.int32))
        self.used, self.filled = self.used + n, self.filled + int(sizes.sum())

    # -- texts ---------------------------------------------------------------------------------------

    def _safe(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The ids of texts of the safe alphabet; and which of them met a colliding hash."""
        joined = "\0".join([*texts, ""])
        if not self.keeps_space:
            joined = joined.lower()
        x = np.frombuffer(joined.encode("utf-16-le"), "<u2")
        start, end = cuts(x, self.keeps_space)
        hashes = []
        for values, (up, down) in zip(_VALUES, _power_tables(len(x)), strict=True):
            sums = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(values[x] * up[: len(x)], out=sums[1:])
            hashes.append(mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)))
        key, check = hashes[0] | U64(1), (hashes[1] >> U64(32)).astype(np.uint32)
        entry = self._find(key)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, at = np.unique(key[missing], return_index=True)
            if self.used + len(new) > SLOTS // 2:
                self._clear()
                new, at = np.unique(key, return_index=True)
                missing = np.arange(len(key))
            at = missing[at]
            self._learn(new, check[at], [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            entry[missing] = self._find(key[missing])
        first, size = self.first[entry], self.first[entry + 1] - self.first[entry]
        upto = np.cumsum(size)
        ids = self.pool[np.repeat(first - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)]
        # Cuts and ids of each text: a text ends at its separator.
        last = np.searchsorted(start, np.flatnonzero(x == 0))
        bounds = np.append(0, np.append(0, upto)[last]).tolist()
        wrong = np.flatnonzero(self.check[entry] != check)
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], np.unique(np.searchsorted(last, wrong, "right"))

    def _long(self, text: str) -> bytes:
        """A long safe text, a piece at a time: a single space between other characters starts a cut."""
        out, at = [], 0
        while at < len(text):
            gap = _GAP.search(text, at + PIECE)
            to = gap.start() if gap else len(text)
            (ids,), wrong = self._safe([text[at:to]])
            out.append(self._ids(text[at:to]).tobytes() if len(wrong) else ids)
            at = to
        return b"".join(out)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        out = [b""] * len(texts)
        safe = []
        for i, t in enumerate(texts):
            if t:
                if _UNSAFE.search(t) or "<|" in t and self.special.search(t):
                    out[i] = self._ids(t).tobytes()
                elif len(t) > 2 * PIECE:
                    out[i] = self._long(t)
                else:
                    safe.append(i)
        if safe:
            got, wrong = self._safe([texts[i] for i in safe])
            for i, ids in zip(safe, got, strict=True):
                out[i] = ids
            for j in wrong.tolist():
                out[safe[j]] = self._ids(texts[safe[j]]).tobytes()
        return out


@functools.cache
def encoder(path: str, keeps_space: bool) -> CutEncoder:
    """The process's encoder: worker processes are reused, so later tasks find its table filled."""
    return CutEncoder(path, keeps_space)
