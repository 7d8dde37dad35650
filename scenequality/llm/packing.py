"""Best-fit packing of token runs into sequences of fixed capacity, with a bounded number of open bins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequality.llm.common import slices, strings
from scenequality.llm.tokens import with_end, word_encoder
from scenequality.session import cut_lineage

CAPACITY = 4096
OPEN_BINS = 512
PIECES_PER_TASK = 250_000


class OpenBins:
    """At most ``limit`` open bins. Bit f of one integer says that some open bin has f units free; the lowest
    set bit at or above a length is the best fit. Beyond the limit the fullest bin, the lowest bit, closes."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self._free = 0
        self._bins: dict[int, list[int]] = {}
        self._open = 0
        self.made = 0

    def _take(self, free: int) -> int:
        stack = self._bins[free]
        number = stack.pop()
        if not stack:
            self._free ^= 1 << free
        self._open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """Bin number and offset for ``length`` units."""
        fitting = self._free >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            number, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            if self._open == self.limit:
                fullest = (self._free & -self._free).bit_length() - 1
                if fullest <= left:
                    self._take(fullest)
                else:
                    return number, self.capacity - free  # the new one is the fullest: it closes at once
            self._bins.setdefault(left, []).append(number)
            self._free |= 1 << left
            self._open += 1
        return number, self.capacity - free


def token_pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of ``docs`` (doc_id, text): each whole text's ids and ``end``,
    cut into runs of ``capacity``; null text counts as empty and gives one piece with ``end`` alone."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, step = word_encoder(tokenizer, False), 4 * capacity
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                ids = with_end(encoder.encode(strings(part, "text")), end)
                for doc, x in zip(part.column("doc_id").to_pylist(), ids, strict=True):
                    for k in range(0, len(x), step):
                        run = x[k : k + step]
                        rows.append((doc, k // step, k // 4, len(run) // 4, zlib.crc32(run)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), _PIECE, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(
        pieces, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


_PIECE = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, length up to ``capacity``, any more columns).

    The pieces are dealt out by hash to as many tasks as they need at ``pieces_per_task``, ordered by hash in
    each, and packed as they come, so a repeated task gives the same bins. Each task leaves at most
    ``open_bins`` bins open. Lengths of zero take no room; null or longer lengths stop the job. Columns of the
    same names are replaced. An empty table gives an empty result.
    """
    pieces = pieces.drop("sequence_id", "offset")
    n = max(1, -(-pieces.count() // pieces_per_task))
    names = pieces.columns

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            length = batch.column("length").to_pylist()
            if batch.num_rows and not all(x is not None and 0 <= x <= capacity for x in length):
                raise ValueError(f"lengths must lie between 0 and {capacity}")
            placed = np.array([bins.place(x) for x in length], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(placed[:, 0] + base), pa.array(placed[:, 1])],
                [*names, "sequence_id", "offset"],
            )

    mixed = F.xxhash64("doc_id", "piece")
    dealt = pieces.repartition(n, mixed).sortWithinPartitions(mixed, *[c for c in ("doc_id", "piece") if c in names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.mapInArrow(packed, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY,
                   open_bins: int = OPEN_BINS) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and pack the pieces; the piece table, a few numbers per document, is
    written once so that a lost executor never repeats the tokenising."""
    return pack(cut_lineage(token_pieces(docs, tokenizer, end, capacity)), capacity, open_bins)
