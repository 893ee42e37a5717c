"""Secret scan with structural confirmation.

Three base patterns are reported as they match. Beyond them, what looks like base64 or hex is decoded and
reported only if its structure holds: nested lengths of an encoded private key that fill the data exactly,
length-prefixed fields of a private-key blob, packets of an armoured key, or a signed token's header that is an
object with an algorithm. Public keys, certificates, requests and signatures have other parts and are told
from private keys by them. Keys may be wrapped, with line ends as they are or written as a backslash and a
letter. Cheap substring tests and the length of the longest word decide which patterns run at all, and every
text is gone over in time that is linear in its length: lengths inside a key are followed from header to
header before anything is decoded, and no candidate longer than ``LONGEST`` is a key.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in the order of reports, then the confirmed ones.
KINDS = ("assign", "access", "hex", "pem", "key64", "keyhex", "jwt")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# A maximal run of hex digits or of an access key's characters is the leftmost match, long enough or not.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,60}+)-----")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}")
# A line end, real or escaped any number of times; such ends with the blanks around them; base64 up to one.
_END = r"(?:\\++[nr]|\\?\r?\n|\r(?!\n))"
_GAP = re.compile(r"(?:[ \t]*+" + _END + r")++(?:[ \t]|\\++t)*+")
_LEAD = re.compile(r"(?:(?<![A-Za-z0-9+/_\\-])|(?<=\\[nrt]))[A-Za-z0-9+/_-]{40,}+={0,2}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]++={0,2}")
_HEXKEY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
# An object's first byte makes the first two characters e and w to z.
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])(e[w-z][A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]{2,}+)\.[A-Za-z0-9_-]*+")
#: Kinds of length-prefixed blobs and the fields of their private form (its name included); public ones have fewer.
_BLOBS = {b"ssh-rsa": 7, b"ssh-ed25519": 3, b"ssh-dss": 6, b"ecdsa-sha2-": 4}
#: Bytes of the longest private key in any encoding (those of 16,384 bits have some 10,000), and of an object's parts.
LONGEST, PARTS = 1 << 16, 16


def unbase64(text: str) -> bytes | None:
    text = re.sub(r"\\+[nrt]|[\s\\]", "", text).replace("-", "+").replace("_", "/").rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _fields(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """Tags and values that fill the data exactly, sequences checked inside; None if lengths don't fit."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data) or not size and tag != 5:
            return None
        value, at = data[at : at + size], at + size
        if tag in (0x30, 0x31) and (depth > 8 or _fields(value, depth + 1) is None):
            return None
        out.append((tag, value))
    return out


def encoded_key(data: bytes | None) -> bool:
    """A key in one of the common encodings, by its structure."""
    if not data or len(data) < 24:
        return False
    if data.startswith(b"openssh-key-v1\0"):
        return True
    size = int.from_bytes(data[:4], "big")
    if data[4 : 4 + size].startswith(tuple(_BLOBS)) and 7 <= size <= 64:
        at = 0
        while at + 4 <= len(data):
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at == len(data)
    outer = _fields(data) if data[0] == 0x30 else None
    if not outer or len(outer) != 1:
        return False
    inner = _fields(outer[0][1]) or []
    tags = [t for t, _ in inner]
    if tags == [0x30, 4]:  # encrypted: an algorithm with its parameters (a digest has none)
        return [t for t, _ in _fields(inner[0][1]) or []] == [6, 0x30]
    # Version and numbers (private), or an algorithm's sequence with key bits.
    return len(tags) >= 2 and set(tags) <= {2, 3, 4, 5, 6, 0x30, 0x31, 0xA0, 0xA1} and (
        tags[0] == 2 and (4 in tags or tags.count(2) >= 2) or tags[0] == 0x30 and 3 in tags)


def private_parts(tags: list[int]) -> bool:
    """Whether an object's parts are those of a private key: a version and an algorithm with key bits, a version
    and all numbers (of two-number objects, some are public keys and some signatures), or an algorithm with what
    it has encrypted."""
    return tags[:3] == [2, 0x30, 4] or tags[:2] == [2, 4] or tags in ([2] * 6, [2] * 9, [2] * 9 + [0x30], [0x30, 4])


def _blob_fields(data: bytes) -> int:
    at = n = 0
    while at + 4 <= len(data):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        n += 1
    return n


def private_key(data: bytes | None) -> bool:
    """A private key in one of the common encodings, by its structure."""
    if not encoded_key(data) or len(data) > LONGEST:
        return False
    if data.startswith(b"openssh-key-v1\0"):
        return True
    if data[0] == 0x30:
        return private_parts([t for t, _ in _fields(_fields(data)[0][1])])
    return _blob_fields(data) >= next(n for name, n in _BLOBS.items() if data[4:].startswith(name))


def armoured_key(data: bytes | None) -> bool:
    """Packets of an armoured private key: the first is a secret key, and all of them fill the data."""
    at, first = 0, True
    while data and at + 2 < len(data):
        head, at = data[at], at + 1
        if not head & 0x80:
            return False
        tag = head & 63 if head & 0x40 else head >> 2 & 15
        partial = True
        while partial:
            partial = False
            if head & 0x40:
                a = data[at] if at < len(data) else 255
                wide = 1 if a < 192 or 224 <= a < 255 else 2 if a < 224 else 5
                more = data[at + 1 : at + wide]
                partial = 224 <= a < 255
                size = (1 << (a & 31) if partial else a if a < 192 else (a - 192 << 8) + (more or b"\0")[0] + 192 if a < 224
                        else int.from_bytes(more, "big"))
            else:
                wide = (1, 2, 4, 0)[head & 3]
                size = int.from_bytes(data[at : at + wide], "big") if wide else len(data) - at
            at += wide
            if first and (tag != 5 or at >= len(data) or data[at] not in (3, 4, 5, 6)):
                return False
            first = False
            at += size
    return not first and at == len(data)


def _armoured(text: str) -> Iterator[tuple[int, int]]:
    """Blocks between marks of one name that hold a private key."""
    begun = None
    for mark in _MARK.finditer(text):
        if mark[1] == "END" and begun and begun[2] == mark[2] and mark[2].endswith(("KEY", "KEY BLOCK")):
            lines = [x.strip(" \t") for x in re.split(_END, re.sub(r"\\++t", " ", text[begun.end() : mark.start()]))]
            heads = [x for x in lines if ":" in x]
            body = [x for x in lines if ":" not in x and x[:1] != "="]
            data = unbase64("".join(body))
            said = " ".join(heads)
            if mark[2].endswith("BLOCK"):
                found = armoured_key(data)
            elif "ENCRYPTED" in said and re.search(r"DEK-Info: *[A-Z0-9-]+,[0-9A-Fa-f]{16,}", said):
                found = bool(data) and len(data) >= 24 and len(data) % 8 == 0  # whole blocks of the cipher
            else:
                found = private_key(data)
            if found:
                yield begun.start(), mark.end()
        begun = mark if mark[1] == "BEGIN" else None


class _Lines:
    """Base64 over several lines; bytes are read from any line on without decoding what is between."""

    def __init__(self, parts: list[str]):
        self.parts = parts
        self.edges = [0, *accumulate(len(p.rstrip("=")) for p in parts)]
        self.text = "".join(p.rstrip("=") for p in parts).replace("-", "+").replace("_", "/")

    def read(self, line: int, at: int, n: int) -> bytes:
        first = self.edges[line] + at // 3 * 4
        text = self.text[first : self.edges[line] + -(-(at + n) // 3) * 4]
        return binascii.a2b_base64(text[: len(text) // 4 * 4])[at % 3 : at % 3 + n] if len(text) >= 4 else b""

    def object(self, line: int, at: int) -> tuple[int, int, int] | None:
        """Tag, and first and last byte of the object at a byte."""
        head = self.read(line, at, 6)
        if len(head) < 2:
            return None
        n = head[1] & 0x7F if head[1] & 0x80 else 0
        if n > 4 or len(head) < 2 + n or head[1] == 0x80:
            return None
        first = at + 2 + n
        return head[0], first, first + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])

    def fields(self, line: int, at: int, n: int) -> int | None:
        """Where ``n`` length-prefixed fields end."""
        for _ in range(n):
            size = self.read(line, at, 4)
            if len(size) < 4 or at > LONGEST:
                return None
            at += 4 + int.from_bytes(size, "big")
        return at

    def claimed(self, line: int) -> int | None:
        """Bytes of the private key that starts with a line, by its own lengths and parts."""
        head = self.read(line, 0, 30)
        if head.startswith(b"openssh-key-v1\0"):
            at = self.fields(line, 15, 3)  # cipher and key derivation, then a count of public keys, and all private ones
            count = self.read(line, at, 4) if at else b""
            n = int.from_bytes(count, "big") if len(count) == 4 else PARTS
            return self.fields(line, at + 4, n + 1) if n < PARTS else None
        for name, n in _BLOBS.items():
            if head[4:].startswith(name):
                return self.fields(line, 0, n)
        outer = self.object(line, 0) if head[:1] == b"0" else None
        if not outer or outer[2] > LONGEST:
            return None
        tags, at = [], outer[1]
        while at < outer[2] and len(tags) < PARTS:
            part = self.object(line, at)
            if part is None:
                return None
            tags.append(part[0])
            at = part[2]
        return outer[2] if at == outer[2] and private_parts(tags) else None


def _wrapped(text: str) -> Iterator[tuple[int, int]]:
    """Keys in base64 over two lines or more, from the start of a line's run to the end of another's."""
    done = 0
    for lead in _LEAD.finditer(text):
        if lead.start() < done:
            continue
        runs = [lead.span()]
        while (gap := _GAP.match(text, runs[-1][1])) and (run := _RUN.match(text, gap.end())):
            runs.append(run.span())
        done = runs[-1][1]
        if len(runs) == 1:
            continue
        lines = _Lines([text[a:b] for a, b in runs])
        edges, i = lines.edges, 0
        while i < len(runs) - 1:
            size = lines.claimed(i) if len(lines.parts[i]) >= 40 else None
            whole = edges[i] + -(-size * 4 // 3) if size and size <= LONGEST else -1
            j = bisect_left(edges, whole)
            if i + 1 < j < len(edges) and edges[j] == whole and private_key(unbase64("".join(lines.parts[i:j]))):
                yield runs[i][0], runs[j - 1][1]
                i = j
            else:
                i += 1


def signed_token(header: str) -> bool:
    data = unbase64(header)
    try:
        found = json.loads(data) if data else None
    except ValueError:
        return False
    return isinstance(found, dict) and isinstance(found.get("alg"), str)


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start and then by kind."""
    found: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    longest = max(map(len, text.split()), default=0)
    if longest >= 24:
        found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    if "-----BEGIN " in text:
        found += [("pem", *s) for s in _armoured(text)]
    if longest >= 40:
        whole = list(_wrapped(text))  # in order; a line of such a key is not reported by itself
        lines = [m.span() for m in _BASE64.finditer(text) if private_key(unbase64(m[0]))]
        found += [("key64", *s) for s in whole]
        found += [("key64", a, b) for a, b in lines if not (k := bisect_left(whole, (a + 1,))) or whole[k - 1][1] < b]
    if longest >= 64:
        found += [("keyhex", m.start(), m.end()) for m in _HEXKEY.finditer(text) if private_key(bytes.fromhex(m[0]))]
    if longest >= 24:
        found += [("jwt", m.start(), m.end()) for m in _JWT.finditer(text) if signed_token(m[1])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPAN = "struct<kind:string,start:bigint,end:bigint>"


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of every text: an array of (kind, start, end), ordered by start and kind.

    Null and empty texts have no spans, an empty table gives an empty one. Rows that repeat are scanned each,
    spans may overlap, other columns are not read; texts are scanned whole whatever their length.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(spans, pa.list_(pa.struct([
                    ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<{_SPAN}>")


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every secret in ``text`` replaced by its kind in brackets.

    Overlapping spans are replaced together, named by the first. Other columns stay as they are; a null
    text stays null and an empty one empty; rows that repeat stay, each with its secrets replaced; an empty
    table stays empty.
    """
    def clean(text: str) -> str:
        out, at = [], 0
        for kind, start, end in find(text):
            if start >= at:
                out += [text[at:start], f"[{kind}]"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t and clean(t) for t in batch.column("text").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counts_and_digests(scanned: DataFrame) -> DataFrame:
    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return scanned.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(of(*KINDS[:3])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
