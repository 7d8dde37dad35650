"""TIFF media columns: write bytes as multi-page images, walk image directories, decode pages, describe them."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scenequality.llm.common import slices, strings
from scenequality.session import cut_lineage

# Fixed values of the file format: tag numbers, compressions and the byte sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}

PAGE_WIDTH = 64
PAGE_SAMPLES = 3
ROW = PAGE_WIDTH * PAGE_SAMPLES
PAGE_ROWS = 2048
STRIP = 512


def padded(data: bytes, unit: int = ROW) -> bytes:
    """``data`` and as many spaces as fill a positive multiple of ``unit``."""
    return data + b" " * (max(unit, -(-len(data) // unit) * unit) - len(data))


# ---------------------------------------------------------------- writing


def write_tiff(payload: bytes, width: int = PAGE_WIDTH, samples: int = PAGE_SAMPLES, page_rows: int = PAGE_ROWS,
               strip_rows: int = STRIP, predictor: int = 2, level: int = 6) -> bytes:
    """``payload``, whole rows of 8-bit samples, as a little-endian file of deflate strips, a page per ``page_rows``."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, width, samples)
    out, size, back = [struct.pack("<2sHI", b"II", 42, 0)], 8, 4
    links = []
    for top in range(0, len(pixels), page_rows):
        page = pixels[top : top + page_rows]
        offsets, sizes = [], []
        for y in range(0, len(page), strip_rows):
            strip = page[y : y + strip_rows]
            if predictor == 2:
                strip = np.concatenate([strip[:, :1], np.diff(strip, axis=1)], axis=1)
            data = zlib.compress(strip.tobytes(), level)
            data += b"\0" * (len(data) % 2)
            offsets.append(size)
            sizes.append(len(data))
            out.append(data)
            size += len(data)
        entries = [
            (WIDTH, 4, [width]), (HEIGHT, 4, [len(page)]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [DEFLATE]),
            (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (STRIP_OFFSETS, 4, offsets), (SAMPLES, 3, [samples]),
            (STRIP_ROWS, 4, [strip_rows]), (STRIP_SIZES, 4, sizes), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor]),
        ]
        directory, body, aside = size, b"", b""
        far = directory + 2 + 12 * len(entries) + 4
        for tag, kind, values in entries:
            data = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
            if len(data) > 4:
                body += struct.pack("<HHII", tag, kind, len(values), far + len(aside))
                aside += data + b"\0" * (len(data) % 2)
            else:
                body += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        links.append((back, directory))
        back = far - 4
        block = struct.pack("<H", len(entries)) + body + b"\0" * 4 + aside
        out.append(block)
        size += len(block)
    made = bytearray(b"".join(out))
    for where, target in links:
        struct.pack_into("<I", made, where, target)
    return bytes(made)


# ---------------------------------------------------------------- reading


def unpack_bits(data: bytes) -> bytes:
    """PackBits: a count below 128 copies that many bytes and one more, one above 128 repeats the next byte."""
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
                i += 1
            i += 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, high bit first, widened one code early; 256 clears, 257 ends."""
    out, entries, last = bytearray(), [], b""
    held = bits = 0
    width = 9
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            entries, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
        elif code == 257:
            break
        else:
            if not entries or code > len(entries) or code == len(entries) and not last:
                raise ValueError("damaged LZW data")
            found = entries[code] if code < len(entries) else last + last[:1]
            out += found
            if last and len(entries) < 4096:
                entries.append(last + found[:1])
            width = min(12, max(9, (len(entries) + 1).bit_length()))
            last = found
    return bytes(out)


_UNPACK = {NONE: bytes, LZW: unpack_lzw, PACKBITS: unpack_bits, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and tags of each image directory in the chain; a chain that turns back on itself ends there."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for k in range(n):
            entry = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            if kind not in TYPES:
                continue
            layout = f"{order}{count}{TYPES[kind]}"
            inside = struct.calcsize(layout) <= 4
            where = entry + 8 if inside else struct.unpack_from(order + "I", data, entry + 8)[0]
            tags[tag] = struct.unpack_from(layout, data, where)
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def decode_page(data: bytes, order: str, tags: dict[int, tuple]) -> np.ndarray:
    """Samples of one directory as (height, width, samples), of strips or tiles, chunky or in planes."""

    def one(tag: int, default: int) -> int:
        return tags.get(tag, (default,))[0]

    width, height, samples, bits = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1), one(BITS, 1)
    if bits not in (8, 16):
        raise ValueError(f"{bits} bits a sample")
    kind, predictor, planes = one(COMPRESSION, NONE), one(PREDICTOR, 1), samples if one(PLANAR, 1) == 2 else 1
    if kind not in _UNPACK:
        raise ValueError(f"compression {kind}")
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor}")
    tiled = TILE_OFFSETS in tags
    across = tags[TILE_WIDTH][0] if tiled else width
    down = tags[TILE_HEIGHT][0] if tiled else min(one(STRIP_ROWS, height), height)
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_SIZES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_SIZES])
    inner, dtype = samples // planes, np.dtype(f"{order}u{bits // 8}")
    image = np.zeros((height, width, samples), dtype.newbyteorder("="))
    columns, lines = -(-width // across), -(-height // down)
    for k, (start, length) in enumerate(zip(offsets, sizes, strict=True)):
        plane, rest = divmod(k, columns * lines)
        y, x = (rest // columns) * down, (rest % columns) * across
        rows = down if tiled else min(down, height - y)
        raw = _UNPACK[kind](data[start : start + length])
        need = rows * across * inner * dtype.itemsize
        if len(raw) < need:
            raise ValueError("strip or tile too short")
        block = np.frombuffer(raw[:need], dtype).astype(dtype.newbyteorder("=")).reshape(rows, across, inner)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        part = block[: height - y, : width - x]
        image[y : y + part.shape[0], x : x + part.shape[1], plane * inner : (plane + 1) * inner] = part
    return image


# ---------------------------------------------------------------- Spark

_PAGE = (
    "doc_id long, n_bytes long, media_bytes long, media_sha256 string, page int, last boolean, width int, "
    "height int, samples int, data binary, error string"
)


def store_texts(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_bytes, media) of ``docs`` (doc_id, text): each whole text in UTF-8, padded with spaces to whole
    rows, as a file in the media column; null text counts as empty. ``options`` go to write_tiff."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t.encode() for t in strings(part, "text")]
                made = [write_tiff(padded(t), **options) for t in texts]
                columns = [part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(made, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")


def read_pages(media: DataFrame) -> DataFrame:
    """One row per page of ``media`` (doc_id, n_bytes, media), a file's pages in order and next to each other.

    ``data`` holds the samples, little-endian for 16 bits; ``last`` marks a file's final row. A file or page
    that can't be decoded gives a row with ``error`` and no data, and ends that file; null media gives none.
    """

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(_PAGE)
        for row in (r for b in batches for s in slices(b, "media") for r in s.to_pylist()):
            data = row["media"]
            if data is None:
                continue
            base = (row["doc_id"], row["n_bytes"], len(data), hashlib.sha256(data).hexdigest())
            held, number = None, 0
            try:
                for number, (order, tags) in enumerate(directories(data)):
                    if held:
                        yield _batch([held], schema)
                        held = None
                    image = decode_page(data, order, tags)
                    bits = image.astype(image.dtype.newbyteorder("<"), copy=False).tobytes()
                    held = (*base, number, False, image.shape[1], image.shape[0], image.shape[2], bits, None)
                final = held or (*base, 0, False, 0, 0, 0, None, "no page")
            except (ValueError, KeyError, ZeroDivisionError, struct.error, zlib.error) as problem:
                if held:
                    yield _batch([held], schema)
                final = (*base, number, False, 0, 0, 0, None, str(problem) or type(problem).__name__)
            yield _batch([(*final[:5], True, *final[6:])], schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(_gathered(pages, _PAGE), _PAGE)


_DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def digest_pages(pages: DataFrame) -> DataFrame:
    """Fold read_pages' rows into one row per file: size, digest and tail checksum of all samples, and a feature.

    The fold runs in the tasks that decoded the pages, so samples are never shuffled. The feature names pages,
    size, mean and an eight-step histogram of the samples; undecodable files say so there.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, state = _arrow(_DIGEST), None
        for row in (r for b in batches for s in slices(b, "data") for r in s.to_pylist()):
            if state is None:
                state = [hashlib.sha256(), 0, b"", np.zeros(8, np.int64), 0, 0, 0]
            data = row["data"] or b""
            sha, size, tail, steps, total, high, _ = state
            sha.update(data)
            values = np.frombuffer(data, np.uint8)
            steps += np.bincount(values >> 5, minlength=8)
            state[1:] = [size + len(data), (tail + data[-16:])[-16:], steps, total + int(values.sum(dtype=np.int64)),
                         high + row["height"], row["width"]]
            if row["last"]:
                _, size, tail, steps, total, high, wide = state
                feature = f"error={row['error']}" if row["error"] else (
                    f"pages={row['page'] + 1};size={wide}x{high};mean={total / max(1, size):.4f};steps="
                    + ",".join(map(str, steps))
                )
                yield _batch([(row["doc_id"], row["n_bytes"], size, sha.hexdigest(), zlib.crc32(tail),
                               row["media_bytes"], row["media_sha256"], feature)], schema)
                state = None

    return pages.mapInArrow(_gathered(fold, _DIGEST), _DIGEST)


def _arrow(fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def _gathered(step, fields: str, limit: int = 4 << 20):
    """``step`` with its small batches put together to about ``limit`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, schema = [], 0, _arrow(fields)
        for batch in step(batches):
            held.append(batch)
            size += batch.nbytes
            if size > limit or len(held) == 2000:
                yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()

    return run


def text_media(docs: DataFrame) -> DataFrame:
    """Store every text as a file in a written media column, read the pages back and describe them."""
    return digest_pages(read_pages(cut_lineage(store_texts(docs))))
