"""Secret scans with structural confirmation.

Three base patterns report on their own. Base64 and hex candidates are reported only if they decode
to something with the structure of a secret: a signed token whose header and payload are JSON objects
and whose header names an algorithm, a DER key whose nested lengths all fit, or an OpenSSH private key
whose length-prefixed fields all fit. A key in PEM armour may have header lines; one that says it is encrypted is
confirmed by its cipher, initialisation vector and block length. A DER key without armour may stand in a
path or be wrapped in lines: where its own length says it ends is where it ends. A sequence of more than ``ELEMENTS``
elements and an OpenSSH file of more than ``KEYS`` keys are no key; armour has at most 16 header lines.

Defined results: null text is empty and has no spans, an empty table gives no rows. Texts are scanned whole,
whatever their length, in time in proportion to it for hostile texts too. Repeated rows come out each. Spans are code points, end
exclusive, ordered by start, then by ``KINDS``; spans of several kinds may overlap. Extra columns are kept by
``redact`` and ignored otherwise.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import map_arrow, text_chunks

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "openssh")
BASE = KINDS[:3]

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
# Base64 of a text that starts with a brace: e, then one of the letters and signs for 110000 to 111111.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[w-z0-9_-][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
# Nothing is matched twice: a body starts at no white space and stops at the first dash, headers are few and short.
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----\s*+((?:[A-Za-z][A-Za-z-]{0,99}+:[^\n]{0,998}+\n){0,16}+)([A-Za-z0-9+/=\s]++)-----END \1-----")
_DEK = re.compile(r"^DEK-Info:\s*([A-Z0-9-]+),([0-9A-Fa-f]+)\s*$", re.M)
_RUN = re.compile(r"[A-Za-z0-9+/_-]*")
_OPENSSH = "b3BlbnNzaC1rZXktdjEA"  # the magic
_KEY_START = re.compile(rf"(?<![A-Za-z0-9])(?:M(?=[A-P])|{_OPENSSH})")
_BREAK = re.compile(r"[ \t]*+\r?\n[ \t]*+")
#: Elements of a key's sequences and keys of an OpenSSH file, at most. Real ones have no more than 11 and 1.
ELEMENTS, KEYS = 32, 64


def _b64(s: str) -> bytes | None:
    s = re.sub(r"\s", "", s).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _elements(at: Callable[[int, int], bytes], lo: int, hi: int) -> list[tuple[int, int, int]] | None:
    """The (tag, start, end) of the DER elements that fill bytes ``lo`` to ``hi`` exactly, read through
    ``at(offset, length)``; None if the lengths don't fit or there are too many. Contents are not read."""
    out = []
    while lo < hi:
        head = at(lo, min(6, hi - lo))
        if len(head) < 2 or len(out) == ELEMENTS:
            return None
        tag, n, lo = head[0], head[1], lo + 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or len(head) < 2 + size:
                return None
            n, lo = int.from_bytes(head[2 : 2 + size], "big"), lo + size
        if lo + n > hi:
            return None
        out.append((tag, lo, lo + n))
        lo += n
    return out


def _is_der_key(at: Callable[[int, int], bytes], size: int) -> bool:
    """One SEQUENCE that starts with a small version INTEGER and holds key material: PKCS#1 (all
    INTEGERs), SEC1 (an OCTET STRING next) or PKCS#8 (an algorithm SEQUENCE with an OID next)."""
    outer = _elements(at, 0, size)
    inner = _elements(at, *outer[0][1:]) if outer and len(outer) == 1 and outer[0][0] == 0x30 else None
    if not inner or len(inner) < 3 and [t for t, _, _ in inner] != [0x02, 0x04]:
        return False
    tag, lo, hi = inner[0]
    if tag != 0x02 or hi - lo != 1 or at(lo, 1)[0] > 2:
        return False
    tag, lo, hi = inner[1]
    if tag == 0x02:
        return len(inner) >= 6 and all(t == 0x02 and e > s for t, s, e in inner)
    if tag == 0x04:
        return hi - lo >= 16
    algorithm = _elements(at, lo, hi) if tag == 0x30 else None
    return bool(algorithm) and algorithm[0][0] == 0x06 and inner[2][0] == 0x04 and inner[2][2] > inner[2][1]


def is_der_key(b: bytes | None) -> bool:
    return bool(b) and _is_der_key(lambda o, n: b[o : o + n], len(b))


def _is_openssh_key(at: Callable[[int, int], bytes], size: int) -> bool:
    """The magic, then cipher, kdf and kdf options, a key count, and that many public blobs and a
    private blob, each inside its length prefix."""
    magic = b"openssh-key-v1\0"
    if at(0, len(magic)) != magic:
        return False
    place = len(magic)

    def number() -> int:
        nonlocal place
        place += 4
        return int.from_bytes(at(place - 4, 4), "big") if place <= size else size

    for _ in range(3):
        n = number()  # moves the place
        place += n
    keys = number()
    if place > size or not 1 <= keys <= KEYS:
        return False
    for _ in range(keys + 1):
        n = number()
        place += n
        if not n or place > size:
            return False
    return True


def is_openssh_key(b: bytes | None) -> bool:
    return bool(b) and _is_openssh_key(lambda o, n: b[o : o + n], len(b))


def is_encrypted_key(headers: str, b: bytes | None) -> bool:
    """A body under headers that name a cipher: whole cipher blocks, an initialisation vector of a block."""
    found = _DEK.search(headers)
    block = 8 if found and "DES" in found[1] else 16
    return bool(b and found and re.search(r"^Proc-Type:\s*4,ENCRYPTED\s*$", headers, re.M)) and len(found[2]) == 2 * block and len(b) % block == 0


def _declared(head: bytes) -> int | None:
    """Bytes that a DER key with these first bytes must have: a SEQUENCE that starts with a small INTEGER."""
    if len(head) < 8 or head[0] != 0x30:
        return None
    size = head[1] & 0x7F if head[1] & 0x80 else 0
    if head[1] & 0x80 and not 1 <= size <= 4:
        return None
    n = int.from_bytes(head[2 : 2 + size], "big") if size else head[1]
    at = 2 + size
    return at + n if head[at : at + 2] == b"\x02\x01" and head[at + 2 : at + 3] <= b"\x02" else None


class _Bare:
    """Keys in base64 without armour. Where runs, lines and breaks of a text end is found once, and of a
    candidate only the headers are decoded, so many false starts cost no more than their number."""

    def __init__(self, text: str):
        self.text = text
        self.run = (0, 0)
        self.breaks: dict[int, int | None] = {}
        self.lines: dict[int, tuple[int, int]] = {}  # of a line's start: its run of equal lines, its place there
        self.equal: list[tuple[int, list[int], tuple[int, int]]] = []  # width, starts, (start, width) of the line after

    def run_end(self, at: int) -> int:
        if not self.run[0] <= at < self.run[1]:
            self.run = (at, _RUN.match(self.text, at).end())
        return self.run[1]

    def next_line(self, end: int) -> int | None:
        if end not in self.breaks:
            found = _BREAK.match(self.text, end)
            self.breaks[end] = found and found.end()
        return self.breaks[end]

    def equal_lines(self, at: int) -> tuple[int, list[int], tuple[int, int], int]:
        """The lines as wide as the one that starts here, from it on, and its place among them."""
        if at not in self.lines:
            width, starts, line, wide = self.run_end(at) - at, [], at, 0
            while line is not None and (wide := self.run_end(line) - line) == width and width:
                self.lines[line] = (len(self.equal), len(starts))
                starts.append(line)
                line = self.next_line(line + wide)
            self.lines.setdefault(at, (len(self.equal), 0))
            self.equal.append((width, starts, (-1, 0) if line is None else (line, wide)))
        group, place = self.lines[at]
        return (*self.equal[group], place)

    def key(self, start: int) -> tuple[str, int] | None:
        """(kind, end) of a DER or OpenSSH key that starts here, in one run or in lines of one length."""
        text = self.text
        if text.startswith(_OPENSSH, start):
            end = self.run_end(start)
            size = 3 * (end - start) // 4
            if end - start < 43 or (end - start) % 4 == 1 or not _is_openssh_key(self.reader(end - start, lambda _: start, end - start), size):
                return None
            return "openssh", end + len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))
        wanted = _declared(_b64(text[start : start + 16]) or b"")
        chars = wanted and -(-4 * wanted // 3)
        if wanted is None or start + chars > len(text):
            return None
        width = self.run_end(start) - start
        if width >= chars:
            end, line = start + chars, lambda _: start
            if text[end : end + 1].isascii() and text[end : end + 1].isalnum():
                return None
            width = chars
        else:
            whole, rest = divmod(chars - 1, width)  # lines before the last, of the first one's width
            rest += 1
            second = self.next_line(start + width)
            if second is None:
                return None
            wide, starts, after, place = self.equal_lines(second)
            if whole > 1 and wide != width:
                return None
            # The line after the first and ``whole - 1`` more: one of the equal lines, or what follows them.
            at = place + whole - 1
            last, own = (starts[at], wide) if at < len(starts) else after if at == len(starts) else (-1, 0)
            if last < 0 or own != rest:
                return None
            end, line = last + rest, lambda i: start if not i else starts[place + i - 1] if place + i - 1 < len(starts) else after[0]
        if not _is_der_key(self.reader(width, line, chars), wanted):
            return None
        for _ in range(-chars % 4):
            end += text[end : end + 1] == "="
        return "der", end

    def reader(self, width: int, line: Callable[[int], int], chars: int) -> Callable[[int, int], bytes]:
        """Bytes of a body whose lines, of ``width`` characters, start at ``line(i)``."""

        def at(offset: int, n: int) -> bytes:
            lo, hi = offset // 3 * 4, min(chars, -(-(offset + n) // 3) * 4)
            parts = []
            while lo < hi:
                i, skip = divmod(lo, width)
                take = min(hi - lo, width - skip)
                parts.append(self.text[line(i) + skip : line(i) + skip + take])
                lo += take
            return (_b64("".join(parts)) or b"")[offset % 3 : offset % 3 + n]

        return at


def is_signed_token(header: str, payload: str) -> bool:
    parts = []
    for s in (header, payload):
        try:
            parts.append(json.loads(_b64(s) or b""))
        except ValueError:
            return False
    return all(isinstance(p, dict) for p in parts) and isinstance(parts[0].get("alg"), str)


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret of a text."""
    out = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in _WORDS):
            out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    out += [("jwt", *m.span()) for m in _TOKEN.finditer(text) if is_signed_token(m[1], m[2])]
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            body = _b64(m[3])
            if is_encrypted_key(m[2], body) if m[2] else is_der_key(body) or is_openssh_key(body) or "ENCRYPTED" in m[1] and body and body[0] == 0x30:
                out.append(("pem", *m.span()))
    # A DER SEQUENCE starts with the byte 0x30, so with M in base64; the OpenSSH magic with b3Bl.
    # A key in confirmed armour is not reported again.
    armoured, at = {p: e for k, s, e in out if k == "pem" for p in range(s, e)} if "PRIVATE KEY-----" in text else {}, 0
    bare = _Bare(text)
    while start := _KEY_START.search(text, at):
        if start.start() in armoured:
            at = armoured[start.start()]
            continue
        found = bare.key(start.start())
        if found:
            out.append((found[0], start.start(), found[1]))
        at = found[1] if found else start.end()
    for m in _HEX_ANY.finditer(text):
        if text.startswith("30", m.start()) and is_der_key(bytes.fromhex(m[0])):
            out.append(("der", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every row of ``docs``."""

    def make():
        def each(b: pa.RecordBatch):
            for lo, hi in text_chunks(b, "text", 4 << 20):
                part = b.slice(lo, hi - lo)
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t or "")] for t in part.column("text").to_pylist()]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.record_batch([part.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and the span list of ``scan_secrets``."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def redact_text(text: str) -> str:
    """``text`` with every maximal run of overlapping spans replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, start, end in find_secrets(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; secrets in ``text`` are replaced and ``n_chars``, if there,
    follows the new text."""
    schema, chars = docs.schema, "n_chars" in docs.columns

    def make():
        def each(b: pa.RecordBatch):
            for lo, hi in text_chunks(b, "text", 4 << 20):
                part = b.slice(lo, hi - lo)
                old = part.column("text").to_pylist()
                new = [t and redact_text(t) for t in old]
                if new != old:
                    at = part.schema.get_field_index("text")
                    part = part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
                    if chars:
                        at = part.schema.get_field_index("n_chars")
                        was = part.column(at).to_pylist()
                        part = part.set_column(at, part.schema.field(at), pa.array([w if n == o else len(n) for w, n, o in zip(was, new, old, strict=True)], part.schema.field(at).type))
                yield part

        return each

    return map_arrow(docs, make, schema)
