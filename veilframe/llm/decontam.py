"""Benchmark decontamination: size-partitioned MinHash containment search, confirmed exactly.

An item with n distinct shingles is contained in a document when at least ``percent`` of them occur
there. Whatever the document's length, such a document must then hold at least one of the item's
``n - ceil(n * percent / 100) + 1`` minimum hashes (pigeonhole), so that bottom sketch is all that is
indexed of an item and no qualifying pair can be missed: long documents do not dilute the search the
way a Jaccard estimate would. Items are partitioned by set size into powers of two; a partition is
probed only by documents with enough shingles to contain its smallest item. Candidates are confirmed
in the same task on the full sets.

Items are indexed in blocks of at most ``BLOCK`` shingles, the proven bound of what is broadcast;
more items mean more blocks, each scanned against all documents.

Defined results: null or blank documents and items match nothing. An item of fewer than ``k`` words
is one shingle, the whole sequence, and matches only documents that are that sequence. Items repeated
with the same id and text count once. Rows repeating a document id are reported once each; a null
document id is reported as null. Exactly ``percent`` is contained. Without documents or items there are no
rows, or all documents stay. A very long document is read whole, alone, with memory of about 40 bytes a byte. Extra
columns of the input are ignored by ``contained_items`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm import shingles as sh
from veilframe.llm.common import map_arrow, text_chunks

BLOCK = 2_000_000


class ItemIndex:
    """Sketches and full sets of a block of items; pickled into a broadcast."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], k: int, percent: int):
        values, sizes = sh.shingle_sets([t for _, t in items], k)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        self.k, self.percent = k, percent
        self.ids = [i for i, _ in items]
        self.sets = [values[bounds[i] : bounds[i + 1]] for i in range(len(items))]
        self.need = -(-sizes * percent // 100)
        self.parts = []
        for c in sorted({int(n).bit_length() for n in sizes if n}):
            mine = [i for i in range(len(items)) if int(sizes[i]).bit_length() == c]
            # The k-minimum-values sketch: sets are ascending in a uniform hash, so the first are the minima.
            keys = np.concatenate([self.sets[i][: sizes[i] - self.need[i] + 1] for i in mine])
            owner = np.concatenate([np.full(sizes[i] - self.need[i] + 1, i) for i in mine])
            order = np.argsort(keys, kind="stable")
            self.parts.append((int(self.need[mine].min()), keys[order], owner[order]))

    def search(self, texts: list[bytes | None]) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) of every containment."""
        values, sizes = sh.shingle_sets(texts, self.k)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        row_of = np.repeat(np.arange(len(sizes)), sizes)
        found = set()
        for least, keys, owner in self.parts:
            lo = np.searchsorted(keys, values)
            hit = np.flatnonzero((keys[np.minimum(lo, len(keys) - 1)] == values) & (sizes[row_of] >= least)) if len(values) else []
            for h in hit:
                p = int(lo[h])
                while p < len(keys) and keys[p] == values[h]:
                    found.add((int(row_of[h]), int(owner[p])))
                    p += 1
        out = []
        for row, item in sorted(found):
            own, doc = self.sets[item], values[bounds[row] : bounds[row + 1]]
            at = np.minimum(np.searchsorted(doc, own), len(doc) - 1)
            shared = int((doc[at] == own).sum())
            if shared >= self.need[item]:
                out.append((row, item, shared))
        return out


def _indexes(items: DataFrame, k: int, percent: int):
    """One broadcast index for each block of items."""
    items = items.select("item_id", "text").filter("text IS NOT NULL").distinct()
    words = items.agg(F.sum(F.length("text") - F.length(F.translate("text", " \t\n\r\f\x0b", "")) + 1)).first()[0] or 0
    blocks = max(1, -(-int(words) // (BLOCK // 2)))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").toLocalIterator()
        yield items.sparkSession.sparkContext.broadcast(ItemIndex([(r[0], r[1].encode("utf-8", "surrogatepass")) for r in rows], k, percent))


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): every benchmark item inside every document."""

    def scan(shared) -> DataFrame:
        def make():
            index: ItemIndex = shared.value

            def each(b: pa.RecordBatch):
                for lo, hi in text_chunks(b, "text", 2 << 20):
                    part = b.slice(lo, hi - lo)
                    ids = part.column("doc_id").to_pylist()
                    hits = index.search(part.column("text").cast(pa.large_binary()).to_pylist())
                    if hits:
                        n = [len(index.sets[i]) for _, i, _ in hits]
                        cols = [pa.array([ids[r] for r, _, _ in hits], pa.int64()), pa.array([index.ids[i] for _, i, _ in hits], pa.int64()), pa.array(n, pa.int64()), pa.array([s for _, _, s in hits], pa.int64())]
                        yield pa.record_batch([*cols, pa.array([s / m for (_, _, s), m in zip(hits, n, strict=True)], pa.float64())], ["doc_id", "item_id", "n_item", "n_shared", "containment"])

            return each

        return map_arrow(docs.select("doc_id", "text"), make, "doc_id long, item_id long, n_item long, n_shared long, containment double")

    out = None
    for shared in _indexes(items, k, percent):
        out = scan(shared) if out is None else out.unionByName(scan(shared))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is contained."""
    schema = docs.schema
    for shared in _indexes(items, k, percent):

        def make(shared=shared):
            index: ItemIndex = shared.value

            def each(b: pa.RecordBatch):
                for lo, hi in text_chunks(b, "text", 2 << 20):
                    part = b.slice(lo, hi - lo)
                    hits = {r for r, _, _ in index.search(part.column("text").cast(pa.large_binary()).to_pylist())}
                    yield part.filter(pa.array([i not in hits for i in range(hi - lo)], pa.bool_())) if hits else part

            return each

        docs = map_arrow(docs, make, schema)
    return docs
