"""Web archives (WARC 1.1) in Zstandard files: one frame a record, a dictionary in the leading skippable frame.

Writing: pages with equal payloads are found by digest; one of them is a ``response``, the others ``revisit``
it. A task packs its records into archives of about ``ARCHIVE`` bytes, trains a dictionary on records of each
and emits every archive as one row. Spark's own text writer commits them, one row a file, with an empty
skippable frame as its line separator; so archives reach any file system that Spark reaches, and a lost task
leaves none.

Reading: files come as binary rows. The dictionary is taken from the leading frame, frames are found by their
block headers (nothing is searched for), each is decoded alone, and versions, mandatory fields, lengths and
digests are checked.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathclear.functions.settling import settle, shared_folder

#: Bytes of records in an archive; of a dictionary, and of the records it is trained on.
ARCHIVE, DICTIONARY, TRAINED_ON = 32 << 20, 16 << 10, 1 << 20
#: Records of a batch that is read hold so many bytes of payload, or are one.
BATCH = 16 << 20

# Fixed values of the formats: frame magics, the dictionary's among the skippable ones, base32 digits.
FRAME, SKIPPABLE, DICTIONARY_FRAME = 0xFD2FB528, range(0x184D2A50, 0x184D2A60), 0x184D2A5D
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: An empty skippable frame; all its bytes are ASCII.
SEPARATOR = struct.pack("<II", SKIPPABLE[0], 0).decode("ascii")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")


def base32(hex_digest: Column) -> Column:
    """Base32 digits of a hexadecimal SHA-1 (40 digits, so no padding): 5 digits make 4."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record_id(page_id: str | None, mark: int) -> str:
    """Name of a page's record; the id can be read back from it."""
    return f"<urn:page:{'' if page_id is None else 'id-' + quote(page_id, safe='')}:{mark}>"


def page_of(name: str | None) -> str | None:
    found = (name or "").strip("<>").split(":")
    return unquote(found[2][3:]) if found[:2] == ["urn", "page"] and found[2].startswith("id-") else None


def _plain(value: str) -> str:
    """Control characters would end a header line."""
    return "".join(c if c >= " " and c != "\x7f" else quote(c) for c in value)


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    fields = [*fields, ("WARC-Block-Digest", f"sha1:{digest}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def page_record(row: dict, date: str) -> bytes:
    """The record of one page: a response with its payload, or a revisit with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    revisit = row["first_mark"] is not None
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(row["page_id"], row["mark"])),
              ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", f"sha1:{row['digest']}")]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", _plain(row["url"])))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(row["first_id"], row["first_mark"]))]
        return _record(fields, http)
    return _record(fields, http + row["html"].encode())


def archive(records: list[bytes]) -> bytes:
    """One archive: its dictionary in a skippable frame, then a frame for each record."""
    import zstandard

    step = max(1, sum(map(len, records)) // TRAINED_ON)
    dictionary = None
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY, [r[: TRAINED_ON // 8] for r in records[::step]])
    except zstandard.ZstdError:  # too few records to learn from; the dictionary is optional
        pass
    frames = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
    head = b""
    if dictionary:
        data = dictionary.as_bytes()
        head = struct.pack("<II", DICTIONARY_FRAME, len(data)) + data
    return head + b"".join(frames.compress(r) for r in records)


def _archived(date: str, size: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:info>"), ("WARC-Date", date),
                        ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        held, total = [info], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                for row in batch.slice(at, 1000).to_pylist():
                    held.append(page_record(row, date))
                    total += len(held[-1])
                    if total >= size:
                        yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], names=["archive"])
                        held, total = [info], 0
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], names=["archive"])

    return kernel


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE,
                   date: str | None = None) -> None:
    """Writes a record for every row of ``pages`` (page_id, url, html) into archives in ``folder``.

    The payload is the html in UTF-8, a null one is empty. Of rows with equal payloads of ``least_bytes`` or
    more, that with the smallest page_id is a response (rows without an id come last; of rows that repeat, one)
    and the others revisit it; smaller payloads are all responses. A null url is left out of the record, and
    control characters in one are percent-encoded. Other columns are not read; an empty table gives no records.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce("html", F.lit(""))
    # Written once, so that a row's mark stays the same and digests are taken once.
    own = settle(pages.select(
        "page_id", F.col("url").cast("string").alias("url"), html.alias("html"), base32(F.sha1(html)).alias("digest"),
        F.octet_length(html).cast("long").alias("size"), F.monotonically_increasing_id().alias("mark")))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "mark")
    # Only payloads that occur again. Their real size is known, so few are broadcast and many are joined by shuffle.
    firsts = settle(
        own.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.min(order).alias("one"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("digest", F.col("one.page_id").cast("string").alias("first_id"), F.col("one.mark").alias("first_mark")))
    again = F.col("first_mark").isNotNull() & (F.col("first_mark") != F.col("mark"))
    rows = own.join(firsts, "digest", "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "digest", "size", "mark",
        F.when(~again, F.col("html")).alias("html"), F.when(again, F.col("first_id")).alias("first_id"),
        F.when(again, F.col("first_mark")).alias("first_mark"))
    archives = rows.mapInArrow(_archived(date, archive_bytes), "archive binary")
    archives.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option(
        "lineSep", SEPARATOR).text(folder)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, by its header and the headers of its blocks."""
    if at + 5 > len(data):
        raise ValueError("truncated frame header")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError("truncated frame")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind = bool(block & 1), block >> 1 & 3
        if kind == 3:
            raise ValueError("reserved block type")
        at += 3 + (1 if kind == 1 else block >> 3)
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise ValueError("truncated frame")
    return at


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in " \t" and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
        else:
            raise ValueError("a header line without a name")
    return out


def read_record(data: bytes) -> dict:
    """Fields of one decoded record; raises ValueError for what is not a whole and true one."""
    cut = data.find(b"\r\n\r\n")
    version, _, head = data[: max(cut, 0)].partition(b"\r\n")
    if cut < 0 or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC header")
    fields = _fields(head)
    missing = [k for k in MANDATORY if k not in fields]
    if missing:
        raise ValueError(f"no {', '.join(missing)}")
    if not fields["content-length"].isdecimal():
        raise ValueError("Content-Length is no number")
    block = data[cut + 4 : cut + 4 + int(fields["content-length"])]
    if data[cut + 4 + len(block) :] != b"\r\n\r\n" or len(block) != int(fields["content-length"]):
        raise ValueError("Content-Length differs from the record's length")
    payload, length = block, len(block)
    http = fields.get("content-type", "").startswith("application/http")
    if http:
        line, _, payload = block.partition(b"\r\n\r\n")
        if not line.startswith(b"HTTP/"):
            raise ValueError("no HTTP header")
        told = _fields(line.partition(b"\r\n")[2]).get("content-length")
        revisit = fields["warc-type"] == "revisit"
        length = int(told) if told and told.isdecimal() and revisit else len(payload)
        if told and not revisit and told != str(length):
            raise ValueError("HTTP Content-Length differs from the payload's")
    for name, part in (("warc-block-digest", block), ("warc-payload-digest", payload)):
        kind, _, digest = fields.get(name, "").partition(":")
        if name == "warc-payload-digest" and fields["warc-type"] == "revisit":
            continue  # it is the other record's payload
        if kind == "sha1" and digest != base64.b32encode(hashlib.sha1(part).digest()).decode():
            raise ValueError(f"{name} differs")
    return {"fields": fields, "payload": payload, "payload_bytes": length,
            "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None}


def records(content: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(offset, frame length, record or what is wrong) of every frame of an archive."""
    import zstandard

    data, at, decoder = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        try:
            magic = int.from_bytes(data[at : at + 4], "little")
            if magic in SKIPPABLE:
                if at + 8 > len(data):
                    raise ValueError("truncated frame header")
                end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
                if end > len(data):
                    raise ValueError("truncated skippable frame")
            elif magic == FRAME:
                end = frame_end(data, at)
            else:
                raise ValueError("no frame")
        except ValueError as wrong:
            yield at, len(data) - at, str(wrong)  # what follows cannot be found
            return
        if magic == DICTIONARY_FRAME and at == 0:
            try:
                held = bytes(data[8:end])
                if held[:4] == struct.pack("<I", FRAME):  # the dictionary itself may be compressed
                    held = decoder.decompressobj().decompress(held)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            except zstandard.ZstdError as wrong:
                yield at, end - at, f"dictionary: {wrong}"
        elif magic == FRAME:
            try:
                yield at, end - at, read_record(decoder.decompressobj().decompress(data[at:end]))
            except (ValueError, zstandard.ZstdError) as wrong:
                yield at, end - at, str(wrong)
        at = end


_READ = ("archive string, offset long, frame_bytes long, record_type string, record_id string, target_uri string, "
         "refers_to string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary, problem string")
_NAMES = [f.split()[0] for f in _READ.replace("map<string,string>", "map").split(", ")]
_MAP = pa.map_(pa.string(), pa.string())
_TYPES = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), _MAP, pa.binary(), pa.string()]


def _read(strict: bool, payloads: bool):
    def rows(path: str, content: bytes) -> Iterator[list]:
        for at, length, found in records(content):
            if isinstance(found, str):
                if strict:
                    raise ValueError(f"{path} at {at}: {found}")
                yield [path, at, length, *[None] * 8, found]
                continue
            f = found["fields"]
            yield [path, at, length, f["warc-type"], f["warc-record-id"], f.get("warc-target-uri"), f.get("warc-refers-to"),
                   found["payload_bytes"], found["payload_digest"], list(f.items()), found["payload"] if payloads else None, None]

    def batch(held: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names=_NAMES)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for given in batches:
            for i in range(given.num_rows):
                for row in rows(given.column("path")[i].as_py(), given.column("content")[i].as_py()):
                    held.append(row)
                    size += len(row[-2] or b"")
                    if size >= BATCH or len(held) >= 5000:
                        yield batch(held)
                        held, size = [], 0
        if held:
            yield batch(held)

    return kernel


def read_archives(spark: SparkSession, folder: str, strict: bool = True, payloads: bool = True) -> DataFrame:
    """Records of all archives in ``folder``: place, type, ids, payload, its length and digest, all fields.

    A revisit's length and digest are those of the payload it stands for; ``payloads=False`` leaves payloads
    out. A frame that cannot be decoded, or whose header, lengths or digests are wrong, ends the job; with
    ``strict=False`` it is a row with a ``problem``, and so is what follows a frame whose end cannot be found.
    Empty files hold no records. An archive is read as one row, so it can have 2 GB at most.
    """
    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(_read(strict, payloads), _READ)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives of all ``pages`` written and read back: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to`` of every page's record (see :func:`write_archives`). The archives go when the application ends."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/archives_{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    write_archives(pages, folder, least_bytes)
    kind = pages.schema["page_id"].dataType

    def page(name: str) -> Column:
        text = F.regexp_extract(name, "^<urn:page:id-([^:]*):", 1)
        # The form the ids were written in by quote().
        return F.when(F.col(name).startswith("<urn:page:id-"), F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))).cast(kind))

    back = read_archives(spark, folder, payloads=False).filter(F.col("record_type").isin("response", "revisit"))
    return back.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


#: The same figures in SQL.
SQL = """
WITH given AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), cut AS (
  SELECT page_id, html, hex, list_transform(range(8), lambda i: ('0x' || substr(hex, CAST(1 + 5 * i AS BIGINT), 5))::BIGINT) AS parts FROM given
), named AS (
  SELECT page_id, html, hex, array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((v >> s) & 31) AS BIGINT), 1)), '')), '') AS payload_digest FROM cut
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY hex ORDER BY page_id NULLS LAST) AS nth,
    first_value(page_id) OVER (PARTITION BY hex ORDER BY page_id NULLS LAST) AS least FROM named
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN least END AS refers_to
FROM ranked
"""
