"""Token ids as binary files: one zstandard frame per document under a shared dictionary, with an offset index.

File: ``IDZ1``, the dictionary's 32-byte SHA-256, one byte for the width of an id (2 or 4), the frames, then
an index (doc ids, null flags, token counts, frame ends, each a plain little-endian array, compressed as one
frame) and a 24-byte trailer: index start and length as unsigned 64-bit, documents as unsigned 32-bit, ``IDZ1``.
A single document costs three small reads: trailer, index and its frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenequality.llm.common import attempt_file, hash_sample, new_folder, place, slices, strings
from scenequality.llm.tokens import with_end, word_encoder
from scenequality.session import cut_lineage

MAGIC = b"IDZ1"
TRAILER = "<QQI4s"
LEVEL = 3


@dataclass(frozen=True)
class TokenStore:
    """Where the files are: the manifest has a row per file, in ascending document order."""

    folder: str
    dictionary: str
    manifest: DataFrame


def _pack(ids: bytes, width: int) -> bytes:
    if width == 4:
        return ids
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and wide.max() > 0xFFFF:
        raise ValueError(f"id {wide.max()} doesn't fit {width} bytes; write the store with width=4")
    return wide.astype("<u2").tobytes()


def _unpack(data: bytes, width: int) -> bytes:
    return data if width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def train_dictionary(docs: DataFrame, path: str, spaced: bool, end: int, width: int, sample: int, size: int) -> bytes:
    """A dictionary of ``size`` bytes from the whole id arrays of ``sample`` documents, those of smallest id hash.

    The sample is bounded by its parameter and trained on in one task. With too little to train on the
    dictionary is empty, which readers treat as none.
    """
    chosen = docs.where(F.col("doc_id").isin(hash_sample(docs.select("doc_id"), docs.count(), sample))).limit(sample)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path, spaced)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [_pack(x, width) for x in with_end(encoder.encode(strings(part, "text")), end)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 4096 * width
        samples = [x[i : i + step] for b in batches for x in b.column(0).to_pylist() for i in range(0, len(x), step)]
        try:
            made = zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            made = b""
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["dictionary"])

    ids = chosen.select("text").mapInArrow(arrays, "ids binary")
    made = ids.repartition(1).sortWithinPartitions("ids").mapInArrow(train, "dictionary binary").collect()
    return bytes(made[0][0]) if made else b""


def _compressors(dictionary: bytes):
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return (
        zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_dict_id=False),
        zstandard.ZstdDecompressor(dict_data=shared),
    )


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    end: int,
    spaced: bool = True,
    width: int = 2,
    sample: int = 1024,
    dictionary_size: int = 1 << 16,
) -> TokenStore:
    """Encode ``docs`` (doc_id, text), append ``end``, and write the ids in ascending doc_id order.

    Null text counts as empty; null doc_ids come first; repeated ids keep one frame each, ordered by text.
    Documents are dealt out by ranges of doc_id, so each task writes one file and no file depends on another.
    ``width`` is the bytes of an id (2 where the vocabulary has at most 65,536). ``sample`` and
    ``dictionary_size`` bound the dictionary's training. An empty table gives no file. Extra columns are ignored.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    docs = docs.select("doc_id", "text")
    dictionary = train_dictionary(docs, tokenizer, spaced, end, width, sample, dictionary_size)
    digest = hashlib.sha256(dictionary).digest()
    named = f"{folder}/{digest.hex()}.dict"
    system, at = place(named)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(at) as out:
        out.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (compressor, _) = word_encoder(tokenizer, spaced), _compressors(dictionary)
        part = TaskContext.get().partitionId()
        name = attempt_file(folder, part, ".ids")
        out, size = None, 0
        keys, absent, counts, ends = [], [], [], []
        for batch in batches:
            for piece in slices(batch, "text"):
                if out is None:
                    files, target = place(name)
                    out = files.open_output_stream(target)
                    size = out.write(MAGIC + digest + bytes([width]))
                ids = with_end(encoder.encode(strings(piece, "text")), end)
                for doc, x in zip(piece.column("doc_id").to_pylist(), ids, strict=True):
                    frame = compressor.compress(_pack(x, width))
                    out.write(frame)
                    size += len(frame)
                    keys.append(doc or 0)
                    absent.append(doc is None)
                    counts.append(len(x) // 4)
                    ends.append(size)
        rows = []
        if out is not None:
            index = np.array(keys, "<i8").tobytes() + np.array(absent, "u1").tobytes()
            index += np.array(counts, "<u8").tobytes() + np.array(ends, "<u8").tobytes()
            index = zstandard.compress(index, LEVEL)
            out.write(index)
            out.write(struct.pack(TRAILER, size, len(index), len(keys), MAGIC))
            out.close()
            rows = [(part, name, len(keys), sum(counts))]
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 4, _MANIFEST, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "file", "n_docs", "n_tokens"])

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = cut_lineage(ordered.mapInArrow(write, "part int, file string, n_docs long, n_tokens long"))
    return TokenStore(folder, named, manifest)


_MANIFEST = (pa.int32(), pa.string(), pa.int64(), pa.int64())


def _read_at(source, start: int, length: int) -> bytes:
    return source.read_at(length, start)


def read_index(source) -> tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Id width, dictionary hash, doc ids, null flags, token counts and frame bounds of an open file."""
    head = _read_at(source, 0, 37)
    size = source.size()
    start, length, n, magic = struct.unpack(TRAILER, _read_at(source, size - 24, 24))
    if head[:4] != MAGIC or magic != MAGIC:
        raise ValueError("not a token file")
    data = zstandard.decompress(_read_at(source, start, length))
    keys = np.frombuffer(data, "<i8", n)
    absent = np.frombuffer(data, "u1", n, 8 * n).astype(bool)
    counts = np.frombuffer(data, "<u8", n, 9 * n).astype(np.int64)
    ends = np.frombuffer(data, "<u8", n, 17 * n).astype(np.int64)
    return head[36], head[4:36], keys, absent, counts, np.concatenate([[37], ends])


def read_document(file: str, dictionary: bytes, doc_id: int) -> list[int] | None:
    """Ids of one document from its frame alone; None where the file lacks it."""
    system, at = place(file)
    with system.open_input_file(at) as source:
        width, digest, keys, absent, _, bounds = read_index(source)
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("written with another dictionary")
        skip = int(absent.sum())
        k = skip + int(np.searchsorted(keys[skip:], doc_id))
        if k == len(keys) or keys[k] != doc_id:
            return None
        frame = _read_at(source, int(bounds[k]), int(bounds[k + 1] - bounds[k]))
    ids = _unpack(_compressors(dictionary)[1].decompress(frame), width)
    return np.frombuffer(ids, "<u4").tolist()


def read_tokens(spark: SparkSession, store: TokenStore, read_bytes: int = 8 << 20, ids: bool = True) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32, ids (little-endian unsigned 32-bit).

    ``ids=False`` reads and checks all the same, but leaves the column out.

    A file's start is the sum of the counts in the manifest rows before it; frames are read in runs of about
    ``read_bytes``. A document whose count differs from the index stops the job.
    """
    dictionary_file = store.dictionary
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = store.manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = expected = None
        for file, start in ((r["file"], r["start"]) for b in batches for r in b.to_pylist()):
            system, at = place(file)
            if decompressor is None:
                files_of, where = place(dictionary_file)
                with files_of.open_input_stream(where) as source:
                    dictionary = source.read()
                expected, decompressor = hashlib.sha256(dictionary).digest(), _compressors(dictionary)[1]
            with system.open_input_file(at) as source:
                width, digest, keys, absent, counts, bounds = read_index(source)
                if digest != expected:
                    raise ValueError(f"{file} was written with another dictionary")
                starts = start + np.concatenate([[0], np.cumsum(counts)[:-1]])
                low = 0
                while low < len(keys):
                    high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + read_bytes, "right")) - 1)
                    high = min(high, len(keys))
                    run = memoryview(_read_at(source, int(bounds[low]), int(bounds[high] - bounds[low])))
                    found, sums = [], []
                    for k in range(low, high):
                        frame = run[bounds[k] - bounds[low] : bounds[k + 1] - bounds[low]]
                        one = _unpack(decompressor.decompress(frame), width)
                        if len(one) != 4 * counts[k]:
                            raise ValueError(f"{file}: document {keys[k]} is damaged")
                        sums.append(zlib.crc32(one))
                        if ids:
                            found.append(one)
                    columns = [
                        pa.array(keys[low:high], pa.int64(), mask=absent[low:high]), pa.array(starts[low:high], pa.int64()),
                        pa.array(counts[low:high], pa.int64()), pa.array(sums, pa.int64()),
                    ]
                    if ids:
                        columns.append(pa.array(found, pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names)
                    low = high

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    spread = files.select("file", "start").repartition(max(1, store.manifest.count()))
    return spread.mapInArrow(read, schema)
