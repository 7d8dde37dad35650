"""Ranked lexical search the other way round: the items wait in an inverted index, the documents stream past.

A block of items, bounded by its postings, is sent to every task. Documents are read once per block for the counts of
the items' terms; these counts then run through the index, and each task keeps a bounded heap per item. Heaps merge in
salted groups first, so no item's candidates of all tasks meet at once.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenequality.llm.common import slices
from scenequality.session import cut_lineage

TOP = 10
BLOCK_POSTINGS = 1 << 20  # postings of a block of items; one item is never divided
BATCH_CELLS = 1 << 20  # scores of a batch of documents, documents x items
SALTS = 64


# ---------------------------------------------------------------- terms


def _translation() -> bytes:
    """Letters and digits stay (A-Z in lower case), other ASCII becomes a space; bytes above are letters."""
    out = bytearray(b" " * 128) + bytearray(range(128, 256))
    for c in range(128):
        if chr(c).isalnum():
            out[c] = ord(chr(c).lower())
    return bytes(out)


_FOLD = _translation()


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.translate(_FOLD).split()


def _as_bytes(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).cast("binary").alias(column)


def item_terms(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, term, times) of every term of every item; items without a term are missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                found = Counter(terms(text.as_py()))
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(item, n), pa.array(list(found), pa.binary()), pa.array(found.values(), pa.int64()),
                    ],
                    ["item_id", "term", "times"],
                )

    texts = items.select(F.col(id_column).cast("long").alias("item_id"), _as_bytes(text_column)).distinct()
    found = texts.mapInArrow(run, "item_id long, term binary, times long")
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


# ---------------------------------------------------------------- counts


def term_counts(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term: how many it has, and those of ``known`` by number."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sizes, found, counts = [], [], []
                lengths = []
                for text in part.column("text"):
                    words = terms(text.as_py())
                    lengths.append(len(words))
                    seen = Counter(words)
                    mine = seen.keys() & numbers.keys() if len(seen) < len(numbers) else [t for t in numbers if t in seen]
                    sizes.append(len(mine))
                    found += [numbers[t] for t in mine]
                    counts += [seen[t] for t in mine]
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                out = pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(lengths, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                    ],
                    ["doc_id", "n", "terms", "counts"],
                )
                yield out.filter(pa.array(np.array(lengths) > 0))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _as_bytes("text"))
    return texts.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


# ---------------------------------------------------------------- index and heaps


class ItemIndex:
    """Postings of a block of items: for each term number its items, how often they hold it, and its weight."""

    def __init__(self, items: list[int | None], start: np.ndarray, item: np.ndarray, times: np.ndarray, weight: np.ndarray) -> None:
        self.items, self.start, self.item, self.times, self.weight = items, start, item, times, weight

    def scores(self, length: np.ndarray, owner: np.ndarray, term: np.ndarray, count: np.ndarray, total: int, documents: int) -> np.ndarray:
        """(documents x items) scores of documents of ``length`` terms; ``owner`` says whose term and count it is."""
        m = 25 + 75 * length * documents // total
        gain = self.weight[term] * (1_000_000_000 * count // (1000 * count + 8 * m[owner]))
        many = self.start[term + 1] - self.start[term]
        entry = np.repeat(np.arange(len(term)), many)
        place = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many) + self.start[term][entry]
        out = np.zeros(len(length) * len(self.items), np.int64)
        np.add.at(out, owner[entry] * len(self.items) + self.item[place], gain[entry] * self.times[place])
        return out.reshape(len(length), len(self.items))


class Heaps:
    """The ``top`` best (score, document) per item; of equal scores the smaller id is better, rows without one come last."""

    def __init__(self, items: int, top: int) -> None:
        self._top = top
        self.kept: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]
        self._floor = np.zeros(items, np.int64)  # no score below it can enter
        self._last = np.full(items, np.iinfo(np.int64).max)  # and at it, no id above this one

    def offer(self, scores: np.ndarray, ids: np.ndarray, numbered: np.ndarray) -> None:
        """Take what belongs into the heaps from (documents x items) scores."""
        order = np.where(numbered, ids, np.iinfo(np.int64).max)
        can = (scores > self._floor) | ((scores == self._floor) & (scores > 0) & (order[:, None] <= self._last))
        for item in np.flatnonzero(can.any(0)):
            rows = np.flatnonzero(can[:, item])
            mine = scores[rows, item]
            if len(rows) > self._top:
                best = np.lexsort((order[rows], ~numbered[rows], -mine))[: self._top]
                rows, mine = rows[best], mine[best]
            heap = self.kept[item]
            for score, row in zip(mine.tolist(), rows.tolist(), strict=True):
                entry = (score, bool(numbered[row]), -int(ids[row]))
                if len(heap) < self._top:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            if len(heap) == self._top:
                self._floor[item] = heap[0][0]
                self._last[item] = -heap[0][2] if heap[0][1] else np.iinfo(np.int64).max


def _streamed(counts: DataFrame, index: ItemIndex, documents: int, total: int, top: int) -> DataFrame:
    """(item_id, score, doc_id) of every task's heaps."""
    shared = counts.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        heaps = Heaps(len(items.items), top)
        rows = max(1, BATCH_CELLS // max(len(items.items), 1))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = part.column("terms")
                length = part.column("n").to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(part.num_rows), np.diff(found.offsets.to_numpy()))
                ids = part.column("doc_id")
                scores = items.scores(
                    length, owner, found.flatten().to_numpy(zero_copy_only=False),
                    part.column("counts").flatten().to_numpy(zero_copy_only=False), total, documents,
                )
                heaps.offer(scores, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False))
        found = [(items.items[i], score, -low if there else None) for i, heap in enumerate(heaps.kept) for score, there, low in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in found], pa.int64()) for c in range(3)], ["item_id", "score", "doc_id"]
        )

    return counts.mapInArrow(run, "item_id long, score long, doc_id long")


def _merged(found: DataFrame, top: int) -> DataFrame:
    """Each item's ``top`` of all heaps: heaps of a salt first, then those of all salts."""
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    salted = found.withColumn("salt", F.spark_partition_id() % SALTS)
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order)))
    ranked = some.where(F.col("rank") <= top).drop("rank", "salt").withColumn(
        "rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    )
    return ranked.where(F.col("rank") <= top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _index(postings: list, weights: dict[int, int], terms_: int) -> ItemIndex:
    """``postings`` are (item, term number, times)."""
    items = sorted({p[0] for p in postings}, key=lambda i: (i is None, i or 0))
    number = {item: k for k, item in enumerate(items)}
    rows = np.array([(t, number[i], n) for i, t, n in postings], np.int64).reshape(-1, 3)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    weight = np.zeros(terms_, np.int64)
    for term, w in weights.items():
        weight[term] = w
    return ItemIndex(items, np.searchsorted(rows[:, 0], np.arange(terms_ + 1)), rows[:, 1].copy(), rows[:, 2].copy(), weight)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents of the greatest score above 0.

    Null texts have no terms. Rows of ``items`` that repeat an id and a text count once, different texts of one id count
    together; a null id is an id. Every row of ``docs`` is a document of its own, repeated rows too; at equal scores
    the smaller doc_id comes first and rows without one last. Without items, or without terms, there are no rows.
    """
    postings = cut_lineage(item_terms(items))
    blocks = max(1, math.ceil(postings.count() / block_postings))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = None
    for k in range(blocks):
        mine = postings.where(block == k).collect()
        if not mine:
            continue
        known = {t: i for i, t in enumerate(sorted({bytes(p.term) for p in mine}))}
        counts = cut_lineage(term_counts(docs, known))
        size = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not size[0]:
            continue
        frequency = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weights = {
            r.term: math.floor(1000 * math.log((2 * size[0] + 2) / (2 * r.df + 1))) for r in frequency.collect()
        }
        index = _index([(p.item_id, known[bytes(p.term)], p.times) for p in mine], weights, len(known))
        part = _streamed(counts, index, size[0], size[1], top)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return _merged(found, top)
