"""Language identification by compression.

Every language has a zstandard raw-content dictionary made of its own text. A text is compressed once
with each, in pieces so that the dictionary keeps its weight in long texts, and the language with the
smallest total wins. Case and everything but letters (``str.isalpha``) and single spaces are removed first, from
dictionaries and texts alike, so that markup says nothing. Where the two best sizes are closer than
``margin`` of the best, ``rejected`` is true; the best language is still named.

Bounds of what is learned from: a dictionary holds at most ``DICTIONARY`` bytes, and all together ``TOTAL`` (with more
than 256 languages each so gets less), from at most ``DOCUMENTS`` documents of the language in hash order of the id. Of
one document at most ``SHARE`` bytes of letters are learned, in pieces evenly spaced over its whole text, so that
a few long documents don't fill a dictionary. Whole texts of all documents are classified, in pieces of
``PIECE`` bytes whatever their length.

Defined results: null text or text without a letter is ``und`` with score 0 and rejected. Equal sizes
go to the language with more learned documents, then the first by name. Without any learned language
all is ``und``, an empty table gives no rows. Rows with null lang, id or text are not learned, nor are languages with less
than ``LEAST`` bytes of letters. Repeated rows come out each; of rows that repeat an id and language one is learned, that
whose text hashes lowest. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from veilframe.llm.common import map_arrow, text_chunks

DICTIONARY, TOTAL, DOCUMENTS, SHARE, PIECE, LEVEL, LEAST = 1 << 18, 1 << 26, 400, 1 << 15, 1 << 12, 3, 8
UNKNOWN = "und"

# Word characters that are no letters, such as fractions and circled digits, lie below 0x20000. Those above 0xFFFF have
# a pattern of their own, tried on texts with such characters alone: in one class with the others they slow every text.
_SIGNS, _HIGH_SIGNS = ("".join(c for c in map(chr, span) if c.isalnum() and not c.isalpha()) for span in (range(0x80, 0x10000), range(0x10000, 0x20000)))
_OTHER, _HIGH_OTHER = re.compile(rf"[\W\d_{_SIGNS}]+"), re.compile(f"[{_HIGH_SIGNS}]")


def letters(text: str | None) -> bytes:
    text = text or ""
    if not text.isascii() and len(text.encode("utf-16-le", "replace")) > 2 * len(text):
        text = _HIGH_OTHER.sub(" ", text)
    return _OTHER.sub(" ", text).strip().lower().encode("utf-8", "replace")


def spread(t: bytes, limit: int) -> bytes:
    """All of ``t``, or ``limit`` bytes of it in pieces that are evenly spaced."""
    n = limit // PIECE
    if len(t) <= limit or not n:
        return t[:limit]
    starts = [i * (len(t) - PIECE) // max(1, n - 1) for i in range(n)]
    return b" ".join(t[i : i + PIECE] for i in starts)[:limit]


@dataclass
class Dictionaries:
    names: list[str]  # most learned documents first
    contents: list[bytes]


class Classifier:
    """Compressors of one task."""

    def __init__(self, d: Dictionaries, margin: float):
        self.names, self.margin, self.zs = d.names, margin, []
        for c in d.contents:
            z = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            z.precompute_compress(level=LEVEL)
            self.zs.append(zstandard.ZstdCompressor(dict_data=z, write_content_size=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        t = letters(text)
        if not t or not self.zs:
            return UNKNOWN, 0.0, True
        pieces = [t[i : i + PIECE] for i in range(0, len(t), PIECE)]
        sizes = np.array([sum(len(z.compress(p)) for p in pieces) for z in self.zs], float)
        best = int(np.argmin(sizes))
        odds = np.exp(-(sizes - sizes[best]) / 4)
        second = float(np.partition(sizes, 1)[1]) if len(sizes) > 1 else float("inf")
        return self.names[best], float(1 / odds.sum()), second - sizes[best] < self.margin * sizes[best]


def train(docs: DataFrame, documents: int = DOCUMENTS, size: int = DICTIONARY, share: int = SHARE) -> Dictionaries:
    """``docs``: (doc_id, text, lang) that may be learned from."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    # One row a language.
    counts = {r["lang"]: r for r in known.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("doc_id").alias("ids")).collect()}
    size = min(size, TOTAL // max(1, len(counts)))
    share = min(share, size)
    order = F.struct(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("h"), F.col("doc_id"))
    # A bound on the hash, set for each language to leave about eight times the wanted documents, keeps
    # the ranking small whatever the table's size.
    bound = {k: min(1.0, 8 * documents / r["ids"]) for k, r in counts.items()}
    pick = known.select("doc_id", "lang", order.alias("o"))
    if bound:
        most = F.create_map(*[F.lit(x) for kv in bound.items() for x in kv])
        pick = pick.filter(F.col("o.h") / float(1 << 20) <= most[F.col("lang")])
    pick = pick.distinct().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("o"))).filter(F.col("r") <= documents).select("doc_id", "lang", "r")
    found = known.select("doc_id", "lang", "text").join(F.broadcast(pick), ["doc_id", "lang"])
    rows = found.groupBy("lang", "r").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def make():
        def each(b: pa.RecordBatch):
            cut = [spread(letters(t), share) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("lang"), b.column("r").cast(pa.int32()), pa.array(cut, pa.binary())], ["lang", "r", "t"])

        return each

    # A language's documents as far as they fill its dictionary, which is all that the driver gets.
    learned = map_arrow(rows, make, "lang string, r int, t binary")
    before = F.sum(F.octet_length("t") + 1).over(Window.partitionBy("lang").orderBy("r")) - F.octet_length("t") - 1
    parts: dict[str, list[bytes]] = {}
    for r in learned.withColumn("before", before).filter(F.col("before") < size).orderBy("lang", "r").select("lang", "t").collect():
        parts.setdefault(r["lang"], []).append(bytes(r["t"]))
    contents = {k: b" ".join(v)[:size] for k, v in parts.items()}
    names = sorted((k for k, c in contents.items() if len(c) >= LEAST), key=lambda k: (-counts[k]["rows"], k))
    return Dictionaries(names, [contents[k] for k in names])


def classify(docs: DataFrame, learned: Dictionaries, margin: float = 0.02) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)  # languages * DICTIONARY bytes

    def make():
        own = Classifier(shared.value, margin)

        def each(b: pa.RecordBatch):
            for lo, hi in text_chunks(b, "text", 4 << 20):
                part = b.slice(lo, hi - lo)
                got = [own.predict(t) for t in part.column("text").to_pylist()]
                cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.record_batch([part.column("doc_id"), *cols], ["doc_id", "lang_pred", "score", "rejected"])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
