"""Fill-in-middle transformation of texts by big-integer bit-parallelism.

A text is cut into n tokens: a run of white space (0x20, 0x09-0x0D) with the run of other characters after it,
or white space that nothing follows. The UTF-8 bytes are translated to one class bit each and read as one integer,
whose bit i stands for byte i. A shift and two boolean operations then mark the last byte of every token at once,
``bit_count`` gives n, and the place of the u-th mark is found by recursive halving: count the marks of the lower
half, go on in the half that holds it. All classes are ASCII, so cuts between bytes fall between code
points; code points are the bytes that are no continuation bytes.

Where a document is cut, and whether it is transformed, follow from the SHA-256 of a seed and its id: any engine,
partitioning or retry gives the same. The prefix ends after the smaller of two hashes modulo n + 1 tokens, the middle
after the larger; ``rate`` percent of the documents are transformed, of these ``spm`` percent in the order suffix,
prefix, middle and the others in the order prefix, suffix, middle. Texts that hold one of the marks ``<P>``,
``<S>``, ``<M>`` and empty texts stay plain: so the output of every other is taken apart again without doubt.

Defined results: null text is empty; n is 0 and the form plain. A null id is hashed as an empty one. Texts of white
space alone have one token. Whole texts are read whatever their length, a text at a time, in time that
grows with it and memory of about 8 bytes a byte. Repeated rows come out each, an empty table gives no rows.
Extra columns are ignored by ``transform``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import map_arrow, text_chunks

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
# Class bits as digits, for int(..., 2).
_INK = bytes(ord("0") if i in _SPACES else ord("1") for i in range(256))
_LEADS = bytes(ord("0") if i & 0xC0 == 0x80 else ord("1") for i in range(256))


def class_mask(text: bytes, digits: bytes) -> int:
    """Bit i is the class digit of byte i."""
    return int(text.translate(digits)[::-1] or b"0", 2)


def token_ends(text: bytes) -> int:
    """Bit i is set where byte i is the last of a token."""
    ink = class_mask(text, _INK)
    ends = ink & ~(ink >> 1)
    return ends | 1 << len(text) - 1 if text and text[-1] in _SPACES else ends


def select(bits: int, rank: int, width: int) -> int:
    """The place of the ``rank``-th set bit (from 1) of ``bits``, which lies below ``width``."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & (1 << half) - 1
        held = low.bit_count()
        if rank <= held:
            bits, width = low, half
        else:
            bits, width, rank, at = bits >> half, width - half, rank - held, at + half
    return at


@dataclass(frozen=True)
class Cut:
    n: int
    form: str
    prefix: bytes
    middle: bytes
    suffix: bytes
    prefix_chars: int | None
    middle_chars: int | None


def cut(doc_id: int | None, text: bytes, seed: int = 42, rate: int = 50, spm: int = 80) -> Cut:
    ends = token_ends(text)
    n = ends.bit_count()
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return Cut(n, "plain", b"", b"", text, None, None)
    first, last = (select(ends, u, len(text)) + 1 if u else 0 for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    leads = class_mask(text, _LEADS)
    prefix_chars = (leads & (1 << first) - 1).bit_count()
    middle_chars = (leads & (1 << last) - 1).bit_count() - prefix_chars
    return Cut(n, "spm" if h4 % 100 < spm else "psm", text[:first], text[first:last], text[last:], prefix_chars, middle_chars)


def laid_out(c: Cut) -> bytes:
    """The training text of a cut."""
    if c.form == "plain":
        return c.suffix
    head = (SUFFIX, c.suffix, PREFIX, c.prefix) if c.form == "spm" else (PREFIX, c.prefix, SUFFIX, c.suffix)
    return b"".join((*head, MIDDLE, c.middle))


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``."""

    def make():
        def each(b: pa.RecordBatch):
            for lo, hi in text_chunks(b, "text", 4 << 20):
                part = b.slice(lo, hi - lo)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                cuts = [cut(i, t or b"", seed, rate, spm) for i, t in zip(part.column("doc_id").to_pylist(), texts, strict=True)]
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array([c.n for c in cuts], pa.int64()),
                        pa.array([c.form for c in cuts], pa.string()),
                        pa.array([c.prefix_chars for c in cuts], pa.int64()),
                        pa.array([c.middle_chars for c in cuts], pa.int64()),
                        pa.array([laid_out(c) for c in cuts], pa.binary()).view(pa.string()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    part = F.split(output, "<[PSM]>")
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def digest(transformed: DataFrame) -> DataFrame:
    """``transform``'s rows with digests of the output and of the text rebuilt from it in place of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
