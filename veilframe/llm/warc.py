"""WARC archives of web pages: segmented records, revisits, and reassembly on reading.

Writing: one record a page, whose block is an HTTP response in chunked transfer coding. A block longer than a segment
is cut: the first record has segment number 1, ``continuation`` records carry the identifier of their origin and
their number, the last one also the total length. Every record is a gzip member of its own; a task goes on in a new
file after ``shard`` bytes, between segments too, so that a record may span files. Files are named once an
attempt and only those of the table that ``write_warc`` returns count, so a retried or speculative task leaves nothing
behind that is read. Pages with equal payloads of at least ``least`` bytes are stored once, by the page with the
largest id; the others are ``revisit`` records that refer to it.

Reading: files are parsed record by record, as streams. Whole records are decoded where they are read. Segments
are grouped by the identifier of their origin and ordered by number, in sorted partitions that stream through;
numbers must run from 1 without a gap and the lengths must add up to the declared total. Then chunked framing is
decoded and the payload held against its declared digest. What does not fit is named in ``problem``; the row
stays. Only segments are shuffled with their bytes.

Defined results: null html is the empty payload. Null ids are below all others and have no id field; of equal pages of
which all have none, and of rows that repeat the largest id, each is a response. Repeated rows have a record each. An
empty table has no files and no rows. A null url leaves its field out; control characters in it are percent-encoded.
A page of any length is one row when read, with memory of about four times its bytes. Extra columns are ignored.
Equal payloads are those with the same SHA-1, length and a second hash. A revisit to a response that was not read
comes out with the digest that it declares and the problem named.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import BATCH, HUB, HUBS, as_uri, discard, hubs, map_arrow, materialise, new_path, small_batches, spread_join

SEGMENT, SHARD, CHUNK, LEAST, GROUPS = 1 << 14, 1 << 25, 1 << 12, 1000, 100_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed by the format
RAW = "record_id string, type string, segment int, origin string, total long, page string, url string, refers string, declared string, block binary, problem string"
PAGES = "record_id string, type string, page string, url string, refers string, declared string, payload binary, problem string"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join((*parts, b"0\r\n\r\n"))


def dechunked(body: bytes) -> tuple[bytes, str | None]:
    """The payload of a chunked body, up to the first fault, and what is wrong."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return b"".join(parts), "chunk size"
        at, n = end + 2, int(size, 16)
        if not n:
            return b"".join(parts), None  # trailers may follow
        if body[at + n : at + n + 2] != b"\r\n":
            return b"".join(parts), "chunk length"
        parts.append(body[at : at + n])
        at += n + 2


def decoded(block: bytes) -> tuple[bytes, str | None]:
    """The payload of an HTTP response, and what is wrong with its framing."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return block, "no HTTP response"
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        return dechunked(body)
    length = fields.get(b"content-length")
    return body, None if length is None or length == b"%d" % len(body) else "content length"


def record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + z.compress(block + b"\r\n\r\n") + z.flush()


def segments(fields: dict[str, str | None], block: bytes, segment: int, name: str) -> Iterator[bytes]:
    """The records of a response: one, or an origin with its continuations."""
    if len(block) <= segment:
        yield record("response", fields, block)
        return
    own = fields["WARC-Record-ID"]
    for i, at in enumerate(range(0, len(block), segment), 1):
        last = str(len(block)) if at + segment >= len(block) else None
        more = {"WARC-Segment-Number": str(i), "WARC-Segment-Total-Length": last}
        if i == 1:
            yield record("response", fields | more, block[:segment])
        else:
            yield record("continuation", {"WARC-Record-ID": f"<{name};segment={i}>", "WARC-Date": fields["WARC-Date"], "WARC-Segment-Origin-ID": own, **more}, block[at : at + segment])


def parsed(source) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(lower-cased fields, block, problem) of every record of an archive, gzipped or not."""
    raw = io.BufferedReader(source, 1 << 20)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if raw.peek(2)[:2] == b"\x1f\x8b" else raw
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            yield {}, b"", "no WARC record"
            return
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(n) if (n := fields.get("content-length", "")).isdecimal() else 0
        block = stream.read(size)
        yield fields, block, None if n.isdecimal() and len(block) == size else "record length"


def _named(url: str | None) -> str | None:
    return url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def write_warc(pages: DataFrame, path: str, segment: int = SEGMENT, shard: int = SHARD, least: int = LEAST, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under ``path``; returns the table of files (path,
    records, bytes)."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id"), "url", html.alias("payload")).select("*", F.octet_length("payload").alias("n"), F.unhex(F.sha1("payload")).alias("digest"))
    key = F.when(F.col("n") >= least, F.concat("digest", F.unhex(F.lpad(F.hex("n"), 8, "0")), F.unhex(F.lpad(F.hex(F.xxhash64("payload")), 16, "0"))))
    rows = rows.select("page_id", "url", "payload", "digest", key.alias("same"))
    each = rows.filter("same IS NOT NULL").groupBy("same", "page_id").agg(F.count("*").alias("c"))
    equal = each.groupBy("same").agg(F.max(F.struct("page_id", "c")).alias("x"), F.sum("c").alias("rows")).filter("rows > 1").select("same", F.col("x.page_id").alias("top"), F.col("x.c").alias("tops"), "rows")
    equal = materialise(equal, "equal")
    groups = equal.count()
    if groups <= GROUPS:  # some 60 bytes each
        told = rows.join(F.broadcast(equal.drop("rows")), "same", "left")
    else:
        total = rows.filter("same IS NOT NULL").count()
        hot = materialise(equal.filter(F.col("rows") > max(HUB, total // HUBS)).select("same"), "hot")
        told = spread_join(rows, equal.drop("rows"), "same", None if hot.isEmpty() else hot, "left")
    first = F.col("page_id").eqNullSafe(F.col("top"))
    laid = told.select(F.col("page_id").cast("string").alias("page"), "url", F.hex("digest").alias("digest"), F.when(first & (F.col("tops") == 1), True).otherwise(False).alias("alone"), F.when(F.col("tops").isNotNull() & ~first, F.col("top").cast("string")).alias("refers"), F.when(F.col("refers").isNull(), F.col("payload")).alias("payload"))

    def run(batches):
        task, (store, root), attempt = TaskContext.get().partitionId(), fs.FileSystem.from_uri(path), uuid.uuid4().hex
        out, name, files, n, size, number = None, None, 0, 0, 0, 0

        def closed():
            out.close()
            return pa.record_batch([pa.array([name]), pa.array([n]), pa.array([size])], ["path", "records", "bytes"])

        for b in batches:
            for row in range(b.num_rows):
                page, url, digest, alone, refers, payload = (b.column(c)[row].as_py() for c in ("page", "url", "digest", "alone", "refers", "payload"))
                number, digest = number + 1, digest.lower()
                page, refers = (x if x is None else quote(x, safe="") for x in (page, refers))
                urn = f"urn:x-page:{page or ''}:{digest}" + ("" if alone else f"#{task}.{number}")
                fields = {"WARC-Record-ID": f"<{urn}>", "WARC-Date": date, "WARC-Target-URI": _named(url), "X-Page-ID": page, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response"}
                if refers is not None:
                    made = iter([record("revisit", fields | {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<urn:x-page:{refers}:{digest}>"}, _HTTP)])
                else:
                    made = segments(fields, _HTTP + chunked(payload), segment, urn)
                for raw in made:
                    if out is None:
                        name = f"{root}/{task:06d}-{files:04d}-{attempt}.warc.gz"
                        out, files, n, size = store.open_output_stream(name, compression=None), files + 1, 0, 0
                        head = record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                        out.write(head)
                        size += len(head)
                    out.write(raw)
                    n, size = n + 1, size + len(raw)
                    if size >= shard:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    small_batches(spark)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jvm_path)
    files = materialise(laid.mapInArrow(run, "path string, records long, bytes long"), "archives")
    discard(equal)
    return files


class _Rows:
    """Rows gathered into batches of about ``BATCH`` bytes."""

    def __init__(self, schema: list[tuple[str, pa.DataType]]):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += 200 + sum(len(x) for x in row if isinstance(x, bytes))
        if self.size >= BATCH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*self.rows, strict=True), self.schema, strict=True)], [n for n, _ in self.schema])
        self.rows, self.size = [], 0


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_SCHEMA = {ddl: [(c.split()[0], _KINDS[c.split()[1]]) for c in ddl.split(", ")] for ddl in (RAW, PAGES)}


def read_records(files: DataFrame, path: str, wanted: str) -> DataFrame:
    """The records of the archives: those in several segments if ``wanted`` is "segments", or all other
    responses and revisits if it is "whole"."""

    def make():
        store, _ = fs.FileSystem.from_uri(path)

        def each(b: pa.RecordBatch):
            rows = _Rows(_SCHEMA[RAW])
            for name in b.column("path").to_pylist():
                with store.open_input_file(name) as source:
                    for f, block, problem in parsed(source):
                        kind, number = f.get("warc-type"), f.get("warc-segment-number", "")
                        if kind in ("response", "continuation", "revisit") and (wanted == "segments") == number.isdecimal() or not f and wanted == "whole":
                            total = f.get("warc-segment-total-length", "")
                            yield from rows.add(
                                f.get("warc-record-id"), kind, int(number) if number.isdecimal() else None, f.get("warc-segment-origin-id"), int(total) if total.isdecimal() else None,
                                unquote(f["x-page-id"]) if "x-page-id" in f else None, f.get("warc-target-uri"), f.get("warc-refers-to"), f.get("warc-payload-digest"), block, problem,
                            )
            yield from rows.flush()

        return each

    return map_arrow(files.select("path").repartition("path"), make, RAW)


def _checked(payload: bytes, declared: str | None, problem: str | None) -> str | None:
    if problem is None and declared and declared.startswith("sha1:") and hashlib.sha1(payload).hexdigest() != declared[5:].lower():
        return "payload digest"
    return problem


def _whole(records: DataFrame) -> DataFrame:
    def make():
        def each(b: pa.RecordBatch):
            rows = _Rows(_SCHEMA[PAGES])
            for r in b.to_pylist():
                if r["type"] == "revisit":
                    payload, problem = None, r["problem"]
                else:
                    payload, found = decoded(r["block"])
                    problem = _checked(payload, r["declared"], r["problem"] or found)
                yield from rows.add(r["record_id"], r["type"], r["page"], r["url"], r["refers"], r["declared"], payload, problem)
            yield from rows.flush()

        return each

    return map_arrow(records, make, PAGES)


def joined(rows: list[dict]) -> tuple[bytes, str | None]:
    """The block of the segments of one record, ordered by number, and what is wrong with them."""
    problem = next((r["problem"] for r in rows if r["problem"]), None)
    block, total = b"".join(r["block"] for r in rows), next((r["total"] for r in reversed(rows) if r["total"] is not None), None)
    if [r["segment"] for r in rows] != list(range(1, len(rows) + 1)):
        problem = problem or "segment numbers"
    if total != len(block):
        problem = problem or "total length"
    return block, problem


def _reassembled(records: DataFrame) -> DataFrame:
    """One row for each origin. Rows arrive sorted by origin and number; a record's segments are held, no more."""

    def run(batches):
        rows, held = _Rows(_SCHEMA[PAGES]), []

        def finished():
            block, problem = joined(held)
            payload, found = decoded(block)
            first = held[0]
            yield from rows.add(first["key"], "response", first["page"], first["url"], first["refers"], first["declared"], payload, _checked(payload, first["declared"], problem or found))

        for b in batches:
            for at in range(b.num_rows):
                r = {c: b.column(c)[at].as_py() for c in b.schema.names}
                if held and r["key"] != held[0]["key"]:
                    yield from finished()
                    held = []
                held.append(r)
        if held:
            yield from finished()
        yield from rows.flush()

    small_batches(records.sparkSession)
    keyed = records.select(F.coalesce("origin", "record_id").alias("key"), "segment", "total", "page", "url", "refers", "declared", "block", "problem")
    return keyed.repartition("key").sortWithinPartitions("key", "segment").mapInArrow(run, PAGES)


def read_warc(files: DataFrame, path: str) -> DataFrame:
    """The responses and revisits of the archives ``files`` (path): record_id, type, page, url, refers,
    declared, payload (null for revisits), problem."""
    return _whole(read_records(files, path, "whole")).unionByName(_reassembled(read_records(files, path, "segments")))


def resolved(read: DataFrame) -> DataFrame:
    """One row a record of ``read_warc``: page, type, refers (the page referred to), payload_bytes, payload_digest,
    problem; revisits take length and digest from the response that they refer to."""
    urn = lambda c: F.regexp_extract(c, "^<?([^#>]*)", 1)
    told = read.select(urn(F.col("record_id")).alias("own"), urn(F.col("refers")).alias("name"), "type", "page", "declared", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("digest"), "problem")
    told = materialise(told, "read")
    revisits = told.filter("type = 'revisit'")
    responses = told.filter("type = 'response'").groupBy(F.col("own").alias("name")).agg(F.min(F.struct("n", "digest")).alias("x")).select("name", F.col("x.n").alias("far_n"), F.col("x.digest").alias("far_digest"))
    found = spread_join(revisits, responses, "name", hubs(revisits, "name", told.count()), "left")
    declared = F.lower(F.regexp_replace("declared", "^sha1:", ""))
    wrong = F.when(F.col("far_digest").isNull(), "no response").when(F.col("far_digest") != declared, "payload digest")
    again = found.select("page", "type", F.url_decode(F.regexp_extract("name", "^urn:x-page:([^:]*):", 1)).alias("refers"), F.col("far_n").alias("payload_bytes"), F.coalesce("far_digest", declared).alias("payload_digest"), F.coalesce("problem", wrong).alias("problem"))
    return told.filter("type IS NULL OR type <> 'revisit'").select("page", "type", F.lit(None).cast("string").alias("refers"), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "problem").unionByName(again)


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` written to archives in a new folder among the shared ones, and read back as ``read_warc`` does."""
    path = as_uri(new_path(pages.sparkSession, "warc"))
    return read_warc(write_warc(pages, path), path)


def page_rows(found: DataFrame, kind: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of ``resolved``; ``kind`` is the type
    of ids."""
    return found.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers").cast(kind).alias("refers_to"))
