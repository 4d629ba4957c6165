"""Best-fit packing of token sequences with large-item matching.

Documents are tokenised once; only documents longer than a sequence are cut. How sequences are filled
is planned on the histogram of piece lengths, which has at most ``capacity`` entries however large the
corpus is: sequences that are filled alike form one run of (first sequence, count), so the plan places
whole runs at a time and is exact for every piece.

Plan: (1) large items, above a third of the capacity, go at most two to a sequence: taken from the
longest down, each is matched with the longest large item that still fits beside it; (2) smaller items,
from the longest down, go where they leave the smallest gap, new sequences opening only where no gap
fits. Pieces find their place by their rank among the pieces of their length: a piece's rank is its
place in its task's files plus the count of that length in earlier tasks, so no length is ever gathered
in one task. These counts lie in a small file for each task, which whoever places that task's pieces
reads: token ids are written once and never shuffled, nor are counts broadcast.

Defined results: null text is empty, which is the end id alone; an empty table has no pieces. Rows that
repeat an id are packed each; among pieces of one length the order of tasks and of rows in them decides, so equal
rows may change places between runs. A very long text is tokenised whole, a quarter of a megabyte at a time. Extra
columns are ignored. Sequence numbers are dense from 0.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import as_uri, map_arrow, materialise, new_path, text_chunks
from veilframe.llm.tokens import encoder

END = 0


def tokenise(docs: DataFrame, tokenizer: str, capacity: int, keeps_space: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids, width, task, place): pieces of at most ``capacity`` ids; ``ids``
    are little-endian unsigned of ``width`` bytes, ``place`` is the rank among the task's pieces of the
    same length."""

    def make():
        coder, task, seen = encoder(tokenizer, keeps_space), TaskContext.get().partitionId(), {}

        def each(b: pa.RecordBatch):
            for lo, hi in text_chunks(b, "text", 1 << 18):
                part = b.slice(lo, hi - lo)
                rows = []
                for doc, raw in zip(part.column("doc_id").to_pylist(), coder.encode_all(part.column("text").to_pylist()), strict=True):
                    ids = np.append(np.frombuffer(raw, coder.dtype), coder.dtype.type(END))
                    for i, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        place = seen.get(len(own), 0)
                        seen[len(own)] = place + 1
                        rows.append((doc, i, start, len(own), own.tobytes(), coder.dtype.itemsize, task, place))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids", "width", "task", "place"])

        return each

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id long, piece int, start long, length long, ids binary, width int, task int, place long", encodes=True)


def plan(histogram: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, runs (first rank, first sequence, offset, count): the pieces of these ranks go
    to that many consecutive sequences, at that offset."""
    out: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in histogram}
    used = dict.fromkeys(histogram, 0)
    gaps: dict[int, list[list[int]]] = {}  # gap -> runs of sequences [first, count] with that gap
    order: list[int] = []  # the gaps in use, ascending
    opened = 0

    def free(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append([first, count])

    def put(length: int, first: int, offset: int, count: int) -> None:
        out[length].append((used[length], first, offset, count))
        used[length] += count

    large = sorted((n for n in histogram if 3 * n > capacity), reverse=True)
    left = {n: histogram[n] for n in large}
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= capacity - n and left[m] > (m == n)), None)
            if mate is None:
                count = left[n]
                put(n, opened, 0, count)
                left[n] = 0
                free(capacity - n, opened, count)
            else:
                count = left[n] // 2 if mate == n else min(left[n], left[mate])
                put(n, opened, 0, count)
                put(mate, opened, n, count)
                left[n] -= count
                left[mate] -= count
                free(capacity - n - mate, opened, count)
            opened += count
    for n in sorted((n for n in histogram if 3 * n <= capacity), reverse=True):
        todo = histogram[n]
        while todo:
            at = bisect_left(order, n)
            if at == len(order):
                each = capacity // n
                count = max(1, todo // each)
                free(capacity, opened, count)
                opened += count
                continue
            gap = order[at]
            first, count = gaps[gap].pop()
            take = min(count, todo)
            if take < count:
                gaps[gap].append([first + take, count - take])
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            put(n, first, capacity - gap, take)
            free(gap - n, first, take)
            todo -= take
    return out


def _places(runs: dict[int, list[tuple[int, int, int, int]]]):
    """(length, rank) arrays -> (sequence, offset) arrays."""
    keys, firsts, seqs, offsets = [], [], [], []
    for n in sorted(runs):
        for rank, seq, offset, _ in runs[n]:
            keys.append(n)
            firsts.append(rank)
            seqs.append(seq)
            offsets.append(offset)
    keys, firsts, seqs, offsets = (np.array(x, np.int64) for x in (keys, firsts, seqs, offsets))
    bounds = {int(n): (int(np.searchsorted(keys, n)), int(np.searchsorted(keys, n, "right"))) for n in np.unique(keys)}

    def find(length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            mine = length == n
            lo, hi = bounds[int(n)]
            run = lo + np.searchsorted(firsts[lo:hi], rank[mine], "right") - 1
            seq[mine], offset[mine] = seqs[run] + rank[mine] - firsts[run], offsets[run]
        return seq, offset

    return find


def _write_bases(counts: DataFrame) -> str:
    """A file for each task: lengths, and how many pieces of each the tasks before it have."""
    path = as_uri(new_path(counts.sparkSession, "bases"))

    def run(table: pa.Table) -> pa.Table:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        task = table.column("task")[0].as_py()
        temporary = f"{root}/{task}.{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as f:
            f.write(np.stack([table.column(c).to_numpy() for c in ("length", "base")]).astype(np.int64).tobytes())
        store.move(temporary, f"{root}/{task}.bases")
        return pa.table({"task": pa.array([task], pa.int32())})

    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    # At most ``capacity`` rows a task.
    counts.select("task", "length", before.alias("base")).groupBy("task").applyInArrow(run, "task int").write.format("noop").mode("overwrite").save()
    return path


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, keeps_space: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) for every piece; ``ids`` are little-endian
    unsigned 32-bit."""
    spark = docs.sparkSession
    pieces = materialise(tokenise(docs, tokenizer, capacity, keeps_space), "pieces")
    counts = materialise(pieces.groupBy("length", "task").agg((F.max("place") + 1).alias("n")), "counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    shared = spark.sparkContext.broadcast(plan(histogram, capacity))
    path = _write_bases(counts)

    def make():
        find, store, root = _places(shared.value), *fs.FileSystem.from_uri(path)
        bases: dict[int, np.ndarray] = {}

        def base_of(task: int) -> np.ndarray:
            """The pieces of each length in earlier tasks."""
            if task not in bases:
                bases.clear()
                with store.open_input_file(f"{root}/{task}.bases") as f:
                    length, n = np.frombuffer(f.read(), np.int64).reshape(2, -1)
                bases[task] = np.zeros(capacity + 1, np.int64)
                bases[task][length] = n
            return bases[task]

        def each(b: pa.RecordBatch):
            length, task, place = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "task", "place"))
            base = np.zeros(len(length), np.int64)
            for t in np.unique(task):
                base[task == t] = base_of(int(t))[length[task == t]]
            seq, offset = find(length, base + place)
            ids = [np.frombuffer(x, f"<u{w}").astype("<u4").tobytes() for x, w in zip(b.column("ids").to_pylist(), b.column("width").to_pylist(), strict=True)]
            keep = ("doc_id", "piece", "start", "length")
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(ids, pa.binary()), pa.array(seq), pa.array(offset)], [*keep, "ids", "sequence_id", "offset"])

        return each

    return map_arrow(pieces, make, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")
