"""Token-id files with Elias-Fano document boundaries.

A file holds the ids of consecutive documents, concatenated as little-endian unsigned integers of 2 or
4 bytes, and the documents' end offsets as an Elias-Fano sequence: the low bits of every offset packed,
the high bits in unary, and the place of every 64th one-bit, so that ``select`` finds an offset without
a table of 64-bit values (2 + log2(ids / documents) bits a document and 0.5 for the samples). Document
ids are kept the same way.

    magic "VFTOKEN1" | width u32 | null ids u32 | documents u64 | ids u64 | bytes of both sequences u64 u64
    | boundary sequence | document sequence | ids

Writing lays documents out in ascending id, range partitioned, and each task writes its files under a
temporary name before renaming them, so a retried or speculative task leaves the same files. The table
of files (one row each) is the manifest.

Reading takes offsets and ids from the sequences' select structure, a block of ``SAMPLE`` values at a time, so no
64-bit table of a file's documents is ever made.

Defined results: null text is empty: the end id alone. Rows with null ids come first; rows that repeat an id are kept,
in the order of a hash of their texts. A text of any length is one document; it stands alone in its file if longer
than ``SHARD`` ids. An empty table gives no files. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import as_uri, map_arrow, materialise, new_path, small_batches, text_chunks
from veilframe.llm.tokens import encoder

END, SHARD, SAMPLE = 0, 4 << 20, 64
_MAGIC = b"VFTOKEN1"
_HEAD = struct.Struct("<8sIIQQQQ")
_SEQ = struct.Struct("<QQIQ")


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.low_bits, self.low, self.high, self.samples = n, base, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n, base = len(values), int(values[0]) if len(values) else 0
        rel = np.asarray(values, np.int64) - base
        top = int(rel[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (rel >> low_bits) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        low = ((rel[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
        return cls(n, base, low_bits, np.packbits(low.reshape(-1), bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value: from the sampled one-bit before it, count ones byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, mask = at >> 3, 0xFF << (at & 7) & 0xFF
        while True:
            word = int(self.high[byte]) & mask
            ones = word.bit_count()
            if left < ones:
                break
            left, byte, mask = left - ones, byte + 1, 0xFF
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        low = 0
        if self.low_bits:
            first = i * self.low_bits
            chunk = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3].tobytes(), "little")
            low = chunk >> (first & 7) & ((1 << self.low_bits) - 1)
        return self.base + (high << self.low_bits | low)

    def block(self, i: int) -> np.ndarray:
        """The values from the i-th sample to the next: ``select`` for all of them, from the one-bit that the
        sample names on."""
        lo, hi = i * SAMPLE, min((i + 1) * SAMPLE, self.n)
        first = int(self.samples[i]) >> 3
        last = int(self.samples[i + 1]) // 8 + 1 if i + 1 < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[first:last], bitorder="little")) + 8 * first
        ones = ones[np.searchsorted(ones, int(self.samples[i])) :][: hi - lo]
        at = lo * self.low_bits >> 3  # whole bytes, as SAMPLE is a multiple of 8
        bits = np.unpackbits(self.low[at : (hi * self.low_bits + 7) >> 3], count=(hi - lo) * self.low_bits, bitorder="little").reshape(hi - lo, self.low_bits)
        return self.base + (ones - np.arange(lo, hi) << self.low_bits) + (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def span(self, lo: int, hi: int) -> np.ndarray:
        """The values lo to hi - 1."""
        if not 0 <= lo < hi <= self.n:
            return np.zeros(0, np.int64)
        first = lo // SAMPLE
        return np.concatenate([self.block(i) for i in range(first, -(-hi // SAMPLE))])[lo - first * SAMPLE : hi - first * SAMPLE]

    def to_bytes(self) -> bytes:
        return _SEQ.pack(self.n, self.base & (1 << 64) - 1, self.low_bits, len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, base, low_bits, high = _SEQ.unpack_from(raw)
        base -= (base >> 63) << 64
        body = np.frombuffer(raw, np.uint8, offset=_SEQ.size)
        low = (n * low_bits + 7) // 8
        return cls(n, base, low_bits, body[:low], body[low : low + high], np.frombuffer(body[low + high :].tobytes(), "<u4"))


def encode_file(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """``doc_ids`` ascending with nulls first; ``ids`` of each document in ``width`` bytes each."""
    nulls = sum(d is None for d in doc_ids)
    ends = EliasFano.encode(np.cumsum([len(x) // width for x in ids])).to_bytes()
    docs = EliasFano.encode(np.array(doc_ids[nulls:], np.int64)).to_bytes()
    return b"".join((_HEAD.pack(_MAGIC, width, nulls, len(ids), sum(map(len, ids)) // width, len(ends), len(docs)), ends, docs, *ids))


class TokenFile:
    """Random access to a file's documents; ``source`` needs seek and read."""

    def __init__(self, source):
        self.source = source
        magic, self.width, self.nulls, self.documents, self.tokens, ends, docs = _HEAD.unpack(source.read(_HEAD.size))
        if magic != _MAGIC:
            raise ValueError("not a token file")
        self.ends, self.docs = EliasFano.from_bytes(source.read(ends)), EliasFano.from_bytes(source.read(docs))
        self.body = _HEAD.size + ends + docs

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.docs.select(i - self.nulls)

    def doc_ids(self, lo: int, hi: int) -> list[int | None]:
        known = self.docs.span(max(0, lo - self.nulls), hi - self.nulls).tolist()
        return [None] * (hi - lo - len(known)) + known

    def bounds(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        start, end = self.bounds(i)
        self.source.seek(self.body + start * self.width)
        return np.frombuffer(self.source.read((end - start) * self.width), f"<u{self.width}")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, keeps_space: bool = True, shard: int = SHARD) -> DataFrame:
    """Write the files under ``path``; returns the manifest (path, base, documents, tokens), where base
    is the number of ids in earlier files."""

    def make():
        coder, task = encoder(tokenizer, keeps_space), TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(path)
        end = coder.dtype.type(END).tobytes()
        state = {"file": 0, "docs": [], "ids": [], "size": 0}

        def flush():
            name = f"{root}/{task:08d}-{state['file']:06d}.tokens"
            temporary = f"{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as f:
                f.write(encode_file(state["docs"], state["ids"], coder.dtype.itemsize))
            store.move(temporary, name)
            row = pa.record_batch([pa.array([x]) for x in (task, state["file"], name, len(state["ids"]), state["size"] // coder.dtype.itemsize)], ["task", "file", "path", "documents", "tokens"])
            state.update(file=state["file"] + 1, docs=[], ids=[], size=0)
            return row

        def each(b: pa.RecordBatch | None):
            if b is None:
                if state["ids"]:
                    yield flush()
                return
            for lo, hi in text_chunks(b, "text", 1 << 18):
                part = b.slice(lo, hi - lo)
                for doc, raw in zip(part.column("doc_id").to_pylist(), coder.encode_all(part.column("text").to_pylist()), strict=True):
                    state["docs"].append(doc)
                    state["ids"].append(raw + end)
                    state["size"] += len(raw) + len(end)
                    if state["size"] >= shard * coder.dtype.itemsize:
                        yield flush()

        return each

    def run(batches):
        each = None
        for b in batches:
            if b.num_rows:
                each = each or make()
                yield from each(b)
        if each:
            yield from each(None)

    spark = docs.sparkSession
    small_batches(spark)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jvm_path)
    # Rows of one id are told apart by their text, equal rows by their place, so none fill a range alone.
    order = ("doc_id", "h", "row")
    laid = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row")).repartitionByRange(*order).sortWithinPartitions(*order)
    files = materialise(laid.select("doc_id", "text").mapInArrow(run, "task long, file long, path string, documents long, tokens long"), "manifest")
    # Ids before a file: those of earlier tasks, one row each, and of earlier files of its task.
    tasks = files.groupBy("task").agg(F.sum("tokens").alias("own"))
    tasks = tasks.select("task", (F.sum("own").over(Window.orderBy("task")) - F.col("own")).alias("before"))
    within = F.sum("tokens").over(Window.partitionBy("task").orderBy("file")) - F.col("tokens")
    return files.withColumn("within", within).join(tasks, "task").select("path", (F.col("before") + F.col("within")).alias("base"), "documents", "tokens")


def read_tokens(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document, from the files; ``ids`` are little-endian unsigned 32-bit."""

    def make():
        store, _ = fs.FileSystem.from_uri(path)

        def each(b: pa.RecordBatch):
            for name, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                with store.open_input_file(name) as source:
                    f = TokenFile(source)
                    source.seek(f.body)
                    end = 0
                    for lo in range(0, f.documents, 4 * SAMPLE):
                        hi = min(lo + 4 * SAMPLE, f.documents)
                        at = np.append(end, f.ends.span(lo, hi))
                        ids = np.frombuffer(source.read(int(at[-1] - at[0]) * f.width), f"<u{f.width}").astype("<u4")
                        cut = pa.array((4 * (at - at[0])).astype(np.int64))
                        blobs = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, cut.buffers()[1], pa.py_buffer(ids)])
                        yield pa.record_batch([pa.array(f.doc_ids(lo, hi), pa.int64()), pa.array(base + at[:-1]), blobs.cast(pa.binary())], ["doc_id", "start", "ids"])
                        end = int(at[-1])

        return each

    return map_arrow(manifest.select("path", "base").repartition("path"), make, "doc_id long, start long, ids binary")


def with_digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of ``read_tokens``."""
    return tokens.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str, keeps_space: bool = True) -> DataFrame:
    """``docs`` written to a new folder among the shared ones, and read back."""
    path = as_uri(new_path(docs.sparkSession, "tokens"))
    return read_tokens(write_tokens(docs, path, tokenizer, keeps_space), path)
