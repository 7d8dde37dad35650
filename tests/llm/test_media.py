"""WARC archives and TIFF columns: round trips, foreign encodings, damaged input."""

import base64
import gzip
import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scenequality.llm import tiff, warc

PAGES = [(1, "http://a/\r\nx", "same", 0), (2, None, "same", 0), (3, "u", None, 0), (4, "u", "", 0), (5, "u", "é" * 300_000, 0),
         (2, None, "same", 0), (None, "u", "same", 0), (9, "u", "other", 0)]


def plain_pages(rows):
    first = {}
    for i, _, html, _ in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        to = first.get(html or "") if i is not None and first[html or ""] != i else None
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [97, 5000, 1 << 22])
def test_archives_come_back_whole_from_any_split(spark, split):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest int")
    found = warc.read_warc(warc.write_warc(pages), split).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == plain_pages(PAGES)
    assert {bytes(r.payload).decode() for r in found if r.payload is not None} == {h or "" for _, _, h, _ in PAGES}
    assert "http://a/%0D%0Ax" in {r.url for r in found}


def test_empty_archive(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(pages)).count() == 0


def test_false_magic_and_foreign_members_are_passed_over():
    good = warc.record(7, "u", b"payload", None)
    data = b"junk" + warc.MAGIC + b"junk" + gzip.compress(b"no archive") + good + warc.MAGIC + gzip.compress(b"WARC") + good
    for cut in range(0, len(data), 13):
        file = pa.BufferReader(data)
        rows = [r["page_id"] for a, b in ((0, cut), (cut, len(data))) if b > a for r in warc.records_in(file, a, b)]
        assert rows == [7, 7]


def test_cut_off_record_stops():
    data = warc.record(7, "u", b"payload" * 1000, None)
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records_in(pa.BufferReader(data[:-12]), 0, len(data) - 12))


# ---------------------------------------------------------------- TIFF


@settings(max_examples=60, deadline=None)
@given(data=st.binary(max_size=3000), predictor=st.sampled_from([1, 2]), rows=st.integers(1, 7))
def test_written_pages_come_back(data, predictor, rows):
    payload = tiff.padded(data)
    made = tiff.write_tiff(payload, page_rows=rows, strip_rows=2, predictor=predictor)
    pages = [tiff.decode_page(made, order, tags) for order, tags in tiff.directories(made)]
    assert b"".join(p.tobytes() for p in pages) == payload
    assert len(pages) == -(-len(payload) // (rows * 192))


def pack_bits(data):
    out = bytearray()
    i = 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[i]])
            i += run
        else:
            out += bytes([0, data[i]])
            i += 1
    return bytes(out)


def pack_lzw(data):
    """A plain encoder: codes of growing width, widened one code early, cleared when full."""
    bits, table, width = [], {}, 9

    def put(code):
        bits.append(format(code, f"0{width}b"))

    def fresh():
        return {bytes([k]): k for k in range(256)}

    put(256)
    table, n, text = fresh(), 258, b""
    for b in data:
        longer = text + bytes([b])
        if longer in table:
            text = longer
            continue
        put(table[text])
        table[longer] = n
        n += 1
        width = max(9, n.bit_length()) if n < 4095 else 12
        if n == 4094:
            put(256)
            table, n, width = fresh(), 258, 9
        text = bytes([b])
    if text:
        put(table[text])
        n += 1
        width = min(12, max(9, n.bit_length()))
    put(257)
    joined = "".join(bits)
    joined += "0" * (-len(joined) % 8)
    return bytes(int(joined[k : k + 8], 2) for k in range(0, len(joined), 8))


@settings(max_examples=60, deadline=None)
@given(data=st.one_of(st.binary(max_size=2000), st.text("ab", max_size=3000).map(str.encode)))
def test_packbits_and_lzw(data):
    assert tiff.unpack_bits(pack_bits(data)) == data
    assert tiff.unpack_lzw(pack_lzw(data)) == data


def test_lzw_of_long_data():
    data = np.random.default_rng(1).integers(0, 256, 30_000, dtype=np.uint8).tobytes()
    assert tiff.unpack_lzw(pack_lzw(data)) == data


def foreign(order, compression, blocks, fields):
    """A one-page file in the other byte order or layout."""
    body, offsets, sizes = b"", [], []
    for b in blocks:
        offsets.append(8 + len(body))
        sizes.append(len(b))
        body += b
    entries = sorted([*fields, (259, [compression]), (fields_key(fields)[0], offsets), (fields_key(fields)[1], sizes)])
    at = 8 + len(body)
    far = at + 2 + 12 * len(entries) + 4
    table, aside = struct.pack(order + "H", len(entries)), b""
    for tag, values in entries:
        data = struct.pack(f"{order}{len(values)}I", *values)
        value = data if len(data) == 4 else struct.pack(order + "I", far + len(aside))
        aside += b"" if len(data) == 4 else data
        table += struct.pack(order + "HHI", tag, 4, len(values)) + value
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + body + table + b"\0" * 4 + aside


def fields_key(fields):
    return (324, 325) if any(t == 322 for t, _ in fields) else (273, 279)


def test_tiles_planes_and_byte_orders():
    image = np.arange(20 * 40 * 2, dtype=np.uint16).reshape(20, 40, 2) * 31
    blocks = []
    for plane in range(2):  # 16 x 16 tiles, padded at the right and bottom edges
        wide = np.zeros((32, 48), ">u2")
        wide[:20, :40] = image[:, :, plane]
        for y in range(0, 32, 16):
            for x in range(0, 48, 16):
                blocks.append(pack_lzw(wide[y : y + 16, x : x + 16].tobytes()))
    fields = [(256, [40]), (257, [20]), (258, [16, 16]), (277, [2]), (284, [2]), (322, [16]), (323, [16])]
    data = foreign(">", tiff.LZW, blocks, fields)
    ((order, tags),) = tiff.directories(data)
    assert (tiff.decode_page(data, order, tags) == image).all()
    strip = foreign("<", tiff.PACKBITS, [pack_bits(b"abcdef")], [(256, [3]), (257, [2]), (258, [8])])
    ((order, tags),) = tiff.directories(strip)
    assert tiff.decode_page(strip, order, tags).tobytes() == b"abcdef"


def test_text_media(spark):
    texts = [(1, "x" * 400_000, 1), (2, None, 1), (3, "", 1), (4, "é", 1), (4, "é", 1), (None, "n", 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, media int")
    found = {(r.doc_id, r.n_bytes): r for r in tiff.text_media(docs).collect()}
    for i, text, _ in texts:
        raw = (text or "").encode()
        payload = tiff.padded(raw)
        r = found[i, len(raw)]
        assert (r.payload_bytes, r.payload_sha256) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_bytes < max(1000, len(payload)) and len(r.media_sha256) == 64
    assert found[2, 0].feature == found[3, 0].feature
    assert found[1, 400_000].feature.startswith("pages=2;")
    assert tiff.text_media(docs.limit(0)).count() == 0


def test_pages_and_damaged_media(spark):
    good = tiff.write_tiff(tiff.padded(b"z" * 500), page_rows=1)
    rows = [(1, 500, bytearray(good)), (2, 0, bytearray(b"no image")), (3, 0, bytearray(good[:40])), (4, 0, None)]
    media = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")
    found = tiff.read_pages(media).collect()
    assert [(r.page, r.width, r.height, r.last) for r in found if r.doc_id == 1] == [(0, 64, 1, False), (1, 64, 1, False), (2, 64, 1, True)]
    assert all(r.error and r.last for r in found if r.doc_id in (2, 3))
    assert {r.doc_id for r in found} == {1, 2, 3}
    assert {r.doc_id: r.feature[:6] for r in tiff.digest_pages(tiff.read_pages(media)).collect()} == {1: "pages=", 2: "error=", 3: "error="}


def test_gzip_members_are_standard():
    text = gzip.GzipFile(fileobj=io.BytesIO(warc.record(1, "u", b"p", 0))).read().decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: revisit\r\n") and "WARC-Refers-To: <urn:page:0>" in text
