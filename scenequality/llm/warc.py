"""WARC archives: one gzip member per record, written by tasks and read back by byte ranges.

A reading task owns the records that start inside its range. It looks for the gzip magic, accepts a place as a
record only if the bytes there inflate to a WARC header, then inflates the whole member (past the range's end
if need be) and goes on behind it, so no index and no record-aligned splits are needed.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequality.llm.common import attempt_file, new_folder, place, slices
from scenequality.session import cut_lineage

MAGIC = b"\x1f\x8b\x08"
GZIP = 31  # zlib's window setting for gzip members
READ = 1 << 18
SPLIT_BYTES = 4 << 20
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # fixed, so that a repeated task writes the same bytes


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit keeps the HTTP header, which tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Date", DATE)]
    fields += [("WARC-Record-ID", "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>")]
    fields += [] if url is None else [("WARC-Target-URI", _header_value(url))]
    fields += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", IDENTICAL)]
    block = http + payload if refers_to is None else http
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> dict | None:
    """Fields and payload of an inflated record; None for records that hold no page (such as warcinfo)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = {k: re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(k, "")) for k in ("warc-record-id", "warc-refers-to")}
    told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    digest, size = said, int(told[1]) if told else None
    if kind == "response":
        digest, size = base32_sha1(payload), len(payload)
        if said and said != digest:
            raise ValueError(f"damaged payload in {fields.get('warc-record-id')}")
    return {
        "page_id": int(m[1]) if (m := number["warc-record-id"]) else None,
        "url": fields.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(m[1]) if (m := number["warc-refers-to"]) else None,
        "payload": payload if kind == "response" else None,
    }


class _Source:
    """A file with the range's bytes in memory; what lies behind is fetched as records need it."""

    def __init__(self, file, start: int, stop: int) -> None:
        self.file, self.start, self.size = file, start, file.size()
        self.data = file.read_at(min(stop + len(MAGIC) - 1, self.size) - start, start)

    def at(self, position: int) -> bytes:
        i = position - self.start
        if i < len(self.data):
            return self.data[i : i + READ]
        return self.file.read_at(min(READ, self.size - position), position) if position < self.size else b""


def _member(source: _Source, position: int) -> tuple[bytes, int] | None:
    """The inflated record that starts at ``position`` and where it ends; None if no record starts there."""
    inflate, parts, at, seen = zlib.decompressobj(GZIP), [], position, b""
    while not inflate.eof:
        chunk = source.at(at)
        if not chunk:
            break
        try:
            out = inflate.decompress(chunk)
        except zlib.error:
            if seen.startswith(b"WARC/1.") and b"\r\n\r\n" in seen:
                raise
            return None
        at += len(chunk)
        parts.append(out)
        if len(seen) < 1 << 16:
            seen += out[: 1 << 16]
            if not seen.startswith(b"WARC/1."[: len(seen)]):
                return None
    if not inflate.eof:
        if seen.startswith(b"WARC/1."):
            raise ValueError(f"record at {position} is cut off")
        return None
    return b"".join(parts), at - len(inflate.unused_data)


def records_in(file, start: int, stop: int) -> Iterator[dict]:
    """Page records of an open archive that start in [start, stop)."""
    source = _Source(file, start, stop)
    position = start
    while (i := source.data.find(MAGIC, position - start)) >= 0 and start + i < stop:
        position = start + i
        found = _member(source, position)
        if found is None:
            position += 1
            continue
        if (row := parse(found[0])) is not None:
            yield row
        position = found[1]


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of every page whose payload a smaller page_id also has.

    Digests are counted with partial sums, and only then joined back as narrow rows; a join on a hot digest
    is split by adaptive execution. Pages without an id refer to nothing and are referred to by nothing.
    """
    ids = pages.where("page_id IS NOT NULL").select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return ids.join(first.drop("n"), "digest").where("page_id <> refers_to").distinct()


def write_warc(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) and return the manifest (file, size, records).

    Of pages with equal html (null: empty) the smallest page_id is a response and the others revisit it;
    repeated rows of that smallest page stay responses. Control characters in a url are percent-encoded in its
    header. An empty table gives no file. Extra columns are ignored.
    """
    folder = new_folder(pages.sparkSession, "warc")
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1("html"))
    system, at = place(folder)
    system.create_dir(at, recursive=True)
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:info>\r\nWARC-Date: " + DATE.encode()
    info += b"\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, size, n = TaskContext.get().partitionId(), None, 0, 0
        name = attempt_file(folder, part, ".warc.gz")
        for batch in batches:
            for piece in slices(batch, "html"):
                for row in piece.to_pylist():
                    if out is None:
                        files, target = place(name)
                        out = files.open_output_stream(target, compression=None)
                        packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                        size = out.write(packer.compress(info) + packer.flush())
                    size += out.write(record(row["page_id"], row["url"], row["html"].encode(), row["refers_to"]))
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "size": [size], "records": [n]})

    # an id that is missing takes the page's digest instead, so that rows without one don't gather in one task
    same = F.struct("page_id", "digest")
    joined = pages.join(
        revisits(pages).select(same.alias("_key"), "refers_to"), same == F.col("_key"), "left"
    ).select("page_id", "url", "html", "refers_to")
    return cut_lineage(joined.mapInArrow(write, "file string, size long, records long"))


def read_warc(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Every page record of the files in ``manifest`` (file, size), read by ranges of ``split_bytes``.

    Columns: page_id, url, payload_bytes, payload_digest (of the full payload, checked against the header),
    record_type, refers_to and, if ``payloads``, payload (null for revisits).
    """
    cuts = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / split_bytes)))
    ranges = manifest.where("size > 0").select("file", "size", cuts.alias("k"))
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (r for b in batches for r in b.to_pylist()):
            system, at = place(task["file"])
            start = task["k"] * split_bytes
            with system.open_input_file(at) as file:
                rows, held = [], 0
                for row in records_in(file, start, min(start + split_bytes, task["size"])):
                    rows.append(row)
                    held += row["payload_bytes"] or 0
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return ranges.repartition(max(1, ranges.count())).mapInArrow(read, fields + ", payload binary" * payloads)
