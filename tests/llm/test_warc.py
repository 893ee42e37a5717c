import base64
import hashlib
import struct

import pytest
import zstandard

from pathclear.llm import warc

SCHEMA = "page_id long, url string, html string, size string, digest string, mark string, first_id string, path string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "s", "d", "m", "f", "p") for r in rows], SCHEMA)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows, least):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first, out = {}, []
    for i in order:
        page, _, html = rows[i]
        html = html or ""
        n = len(html.encode())
        of = first.setdefault(html, (page,)) if n >= least else (None,)
        fresh = n < least or (html, "seen") not in first
        first[(html, "seen")] = True
        out.append((page, n, digest(html), "response" if fresh else "revisit", None if fresh else of[0]))
    return sorted(out, key=str)


ROWS = [
    (9, "http://a/", "<p>one</p>"), (3, "http://b/\r\nWARC-Type: x", "<p>one</p>"), (4, None, "<p>one</p>"), (None, "u", "<p>one</p>"),
    (5, "http://é/", None), (6, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n"), (-8, "u", "日本語 😀"), (11, "u", "x" * 3_000_000),
    (12, "u", "tie"), (12, "u", "tie"), (12, "u", "tie"), (None, None, None), (13, "u", "<p>two</p>"),
] + [(100 + i, f"http://c/{i}", f"<html><body>{'text of a page ' * 9}{i % 40}</body></html>") for i in range(400)]


@pytest.mark.parametrize("least", [0, 5, 11])
def test_pages_come_back_as_responses_and_revisits(spark, least):
    got = [tuple(r) for r in warc.round_trip(pages(spark, ROWS), least).collect()]
    assert sorted(got, key=str) == expected(ROWS, least)


def test_empty_table_and_other_id_types(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []
    named = spark.createDataFrame([("a:b %+é", "u", "x"), ("c", "u", "x")], "page_id string, url string, html string")
    assert {(r.page_id, r.refers_to) for r in warc.round_trip(named).collect()} == {("a:b %+é", None), ("c", "a:b %+é")}


def test_archives_are_cut_by_size_and_hold_a_dictionary(spark, tmp_path):
    folder = str(tmp_path / "archives")
    warc.write_archives(pages(spark, ROWS).coalesce(1), folder, archive_bytes=40_000)
    back = warc.read_archives(spark, folder).collect()
    assert len({r.archive for r in back}) > 3
    texts = sorted(r.payload.decode() for r in back if r.record_type == "response")
    assert texts == sorted({h or "" for _, _, h in ROWS})
    assert all(r.fields["warc-target-uri"] == r.target_uri for r in back if r.target_uri)
    heads = {bytes(r.content[:4]) for r in spark.read.format("binaryFile").load(folder).collect() if r.length}
    assert struct.pack("<I", warc.DICTIONARY_FRAME) in heads
    assert sum(r.record_type == "warcinfo" for r in back) == len({r.archive for r in back})


def record(**change):
    row = {"page_id": "1", "mark": 0, "url": "u", "digest": digest("hello"), "size": 5, "html": "hello", "first_id": None, "first_mark": None}
    return warc.page_record(row | change, "2020-01-01T00:00:00Z")


def test_dictionary_may_be_compressed_and_frames_may_lack_sizes():
    held = zstandard.train_dictionary(2000, [record(html=f"text number {i} of many words"[:5] + "", size=5) + b"x" * (i % 50) for i in range(400)])
    plain = zstandard.ZstdCompressor(dict_data=held, write_content_size=False)
    packed = zstandard.ZstdCompressor().compress(held.as_bytes())
    data = struct.pack("<II", warc.DICTIONARY_FRAME, len(packed)) + packed
    data += plain.compress(record()) + warc.SEPARATOR.encode() + plain.compress(record(page_id="2"))
    found = [r for _, _, r in warc.records(data)]
    assert [warc.page_of(r["fields"]["warc-record-id"]) for r in found] == ["1", "2"]
    # Without the dictionary no frame can be decoded, and each says so.
    skip = data[8 + len(packed):]
    assert all(isinstance(r, str) for _, _, r in warc.records(skip))


@pytest.mark.parametrize(("change", "says"), [
    (lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), "no WARC header"),
    (lambda r: r.replace(b"WARC-Date", b"WARC-Data"), "no warc-date"),
    (lambda r: r.replace(b"Content-Length: 8", b"Content-Length: 7"), "differs from the record's length"),
    (lambda r: r.replace(b"Content-Length: 5", b"Content-Length: 6"), "HTTP Content-Length differs"),
    (lambda r: r[:-2], "differs from the record's length"),
    (lambda r: r.replace(b"hello", b"jello"), "digest differs"),
    (lambda r: r + b"more", "differs from the record's length"),
    (lambda r: b"", "no WARC header"),
])
def test_wrong_records_are_told_and_the_rest_is_read(change, says):
    frames = zstandard.ZstdCompressor()
    good = record()
    assert warc.read_record(good)["payload"] == b"hello"
    found = [r for _, _, r in warc.records(frames.compress(change(good)) + frames.compress(good))]
    assert says in found[0]
    assert found[1]["payload_bytes"] == 5


def test_broken_frames_end_an_archive(spark, tmp_path):
    frame = zstandard.ZstdCompressor(write_checksum=True).compress(record())
    for cut in range(1, len(frame)):
        *_, last = warc.records(frame + frame[:cut])
        assert isinstance(last[2], str)
    flipped = bytearray(frame)
    flipped[-6] ^= 1
    (tmp_path / "a").write_bytes(frame + bytes(flipped) + frame)
    (tmp_path / "b").write_bytes(b"")
    (tmp_path / "c").write_bytes(frame + b"junk")
    rows = warc.read_archives(spark, str(tmp_path), strict=False).collect()
    assert len(rows) == 5
    assert sum(r.problem is None for r in rows) == 3
    with pytest.raises(Exception, match="no frame|checksum|rror"):
        warc.read_archives(spark, str(tmp_path)).collect()
