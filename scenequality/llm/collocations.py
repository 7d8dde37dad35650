"""Phrase collocations: an FM-index over word ids per shard of the documents, its counts summed across shards.

A shard is what one task holds at a time. Its words become numbers, and the shard's Burrows-Wheeler transforms, forward
and reversed, are built by sorting positions by the next few words, which is all that phrases of bounded length need. An
interval of the forward transform is a phrase; the symbols in front of it are its extensions to the left, and the
matching interval of the reversed one shows what stands to its right.

Two passes keep what shards send small: the first adds up two-word phrases by hash, and the second follows only those
whose hash can reach the least count. Hashes that meet let more through, never less; phrases count as texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenequality.llm.near_dup import mix
from scenequality.operators.running import positions
from scenequality.session import cut_lineage

LONGEST = 5
LEAST_COUNT = 100
TOP = 2000
UNKNOWN = "und"
SHARD_BYTES = 12 << 20
SPLIT_BYTES = 1 << 20
FILTER_BITS = 1 << 27  # 16 MB, sent to every worker whatever the size of the corpus
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_U = np.uint64


# ---------------------------------------------------------------- words of a shard


def _translation() -> bytes:
    out = bytearray(range(256))
    out[ord("A") : ord("Z") + 1] = range(ord("a"), ord("z") + 1)
    for c in _BREAKS:
        out[c] = 0x0A
    out[0x09] = 0x20
    return bytes(out)


class Vocabulary(dict):
    """Numbers of words from 1 on, in order of appearance; 0 is a break between pieces, -1 nothing."""

    def __init__(self) -> None:
        super().__init__({b"": -1, b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) - 1
        return number

    def words(self) -> list[bytes]:
        """Words by number; place 0 is empty."""
        return [b"", *list(self)[2:]]


def numbered(texts: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    """Word numbers of ``texts`` one after the other, a 0 between pieces and around texts."""
    table, parts, held, size = _translation(), [np.zeros(1, np.int32)], [], 0
    for place, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= SPLIT_BYTES or place + 1 == len(texts):
            words = (b"\n".join(held) + b"\n").translate(table).replace(b"\n", b" \n ").split(b" ")
            found = np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words))
            parts.append(found[found >= 0])
            held, size = [], 0
    return np.concatenate(parts)


def _portions(text: bytes) -> Iterator[bytes]:
    """``text`` cut at breaks into portions of about a shard's size; a longer piece without a break stays whole."""
    start = 0
    while len(text) - start > SHARD_BYTES:
        cut = max(text.rfind(bytes([c]), start, start + SHARD_BYTES) for c in _BREAKS)
        if cut < start:
            later = [p for c in _BREAKS if (p := text.find(bytes([c]), start)) >= 0]
            if not later:
                break
            cut = min(later)
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Vocabulary, np.ndarray]]:
    """(language, vocabulary, word numbers) for every language in each shard's worth of (text, lang) rows."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def flush() -> Iterator[tuple[str, Vocabulary, np.ndarray]]:
        for lang, texts in held.items():
            vocabulary = Vocabulary()
            yield lang, vocabulary, numbered(texts, vocabulary)

    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
            for portion in _portions(text.as_py()):
                if size + len(portion) > SHARD_BYTES and held:
                    yield from flush()
                    held, size = {}, 0
                held.setdefault(lang, []).append(portion)
                size += len(portion)
    yield from flush()


def word_keys(lang: str, words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words of one language, by number."""
    head = lang.encode() + b"\0"
    return np.fromiter((xxhash.xxh3_64_intdigest(head + w) for w in words), np.uint64, len(words))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first) + second * _U(0x2545F4914F6CDD1D))


# ---------------------------------------------------------------- the index


def _by_next(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``tokens`` in the order of the ``depth`` numbers that begin there."""
    rank, known = tokens.astype(np.int64), 1
    while True:
        step = min(known, depth - known)
        if not step:
            return np.argsort(rank, kind="stable")
        key = rank * (int(rank.max(initial=0)) + 2)
        key[:-step] += rank[step:] + 1
        known += step
        if known == depth:
            return np.argsort(key, kind="stable")
        order = np.argsort(key, kind="stable")
        changes = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty_like(key)
        rank[order] = changes


class Phrases:
    """Intervals of equally long phrases: their words, where they begin in both orders, and their counts."""

    def __init__(self, words: np.ndarray, low: np.ndarray, low_reversed: np.ndarray, size: np.ndarray) -> None:
        self.words, self.low, self.low_reversed, self.size = words, low, low_reversed, size

    def __len__(self) -> int:
        return len(self.size)


class ShardIndex:
    """Both Burrows-Wheeler transforms of ``tokens`` (0 is a break), good for phrases of up to ``depth`` words."""

    def __init__(self, tokens: np.ndarray, depth: int) -> None:
        self.counts = np.bincount(tokens, minlength=1)
        self.before = self._transform(tokens, depth)
        self.after = self._transform(tokens[::-1], depth)
        self.step = np.empty(len(tokens), np.int64)  # from a position to that of the suffix one word longer
        self.step[np.argsort(self.before, kind="stable")] = np.arange(len(tokens))
        self.runs_before, self.runs_after = (
            np.concatenate([np.zeros(1, np.int64), np.cumsum(np.diff(t) != 0)]) for t in (self.before, self.after)
        )

    @staticmethod
    def _transform(tokens: np.ndarray, depth: int) -> np.ndarray:
        return tokens[_by_next(tokens, depth) - 1]

    def words(self) -> Phrases:
        """All phrases of one word."""
        start = np.cumsum(self.counts) - self.counts
        there = np.flatnonzero(self.counts[1:]) + 1
        return Phrases(there[:, None], start[there], start[there], self.counts[there])

    def extended(self, phrases: Phrases) -> Phrases:
        """Every phrase with one more word in front, as it occurs."""
        if not len(phrases):
            return Phrases(np.zeros((0, phrases.words.shape[1] + 1), np.int64), *(np.zeros(0, np.int64) for _ in range(3)))
        offset = np.cumsum(phrases.size) - phrases.size
        owner = np.repeat(np.arange(len(phrases)), phrases.size)
        place = np.arange(len(owner)) - offset[owner] + phrases.low[owner]
        key = owner * len(self.counts) + self.before[place]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        size = np.diff(first, append=len(order))
        head = order[first]
        word, mine = self.before[place[head]].astype(np.int64), owner[head]
        # in the reversed order the phrases that end alike are sorted by the word that goes in front
        low_reversed = phrases.low_reversed[mine] + first - offset[mine]
        real = word > 0
        words = np.column_stack([word, phrases.words[mine]])
        return Phrases(words[real], self.step[place[head]][real], low_reversed[real], size[real])

    def only_before(self, phrases: Phrases) -> np.ndarray:
        """The word in front of all occurrences of a phrase, 0 where that differs or is a break."""
        return self._only(self.before, self.runs_before, phrases.low, phrases.size)

    def only_after(self, phrases: Phrases) -> np.ndarray:
        """The word behind all occurrences of a phrase, 0 where that differs or is a break."""
        return self._only(self.after, self.runs_after, phrases.low_reversed, phrases.size)

    @staticmethod
    def _only(symbols: np.ndarray, runs: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.where(runs[low] == runs[low + size - 1], symbols[low], 0)


# ---------------------------------------------------------------- passes


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, vocabulary, tokens in shards(batches):
        index = ShardIndex(tokens, 2)
        pairs = index.extended(index.words())
        keys = word_keys(lang, vocabulary.words())
        found = pair_keys(keys[pairs.words[:, 0]], keys[pairs.words[:, 1]]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(pairs.size.astype(np.int64))], ["pair", "count"])


def _surviving(tokens: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """``tokens`` without what is in no pair that the filter lets through; a 0 stands between the rest."""
    first, second = tokens[:-1], tokens[1:]
    there = np.flatnonzero((first > 0) & (second > 0))
    slot = filter_slot(pair_keys(keys[first[there]], keys[second[there]]), len(bits) * 8)
    linked = np.zeros(len(tokens) + 1, bool)  # whether a position goes on to the next one
    linked[there] = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
    kept = linked[:-1].copy()
    kept[1:] |= linked[:-2]
    ends = kept & ~linked[:-1]
    place = np.cumsum(kept.astype(np.int64) + ends)  # a break behind every run
    out = np.zeros(int(place[-1]) + 1 if len(place) else 1, tokens.dtype)
    at = np.flatnonzero(kept)
    out[place[at] - ends[at]] = tokens[at]
    return out


def filter_slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys & _U(bits - 1)).astype(np.int64)


def _phrase_counts(bits: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, vocabulary, tokens in shards(batches):
            words = vocabulary.words()
            counts = np.bincount(tokens, minlength=len(words))[1:]
            if len(counts):
                nothing = pa.nulls(len(counts), pa.int64())
                yield _rows(lang, 1, pa.array(words[1:], pa.binary()), counts, nothing, nothing)
            keys = word_keys(lang, words)
            index = ShardIndex(_surviving(tokens, keys, bits), longest)
            values = pa.array(words, pa.binary())
            phrases = index.words()
            for length in range(2, longest + 1):
                phrases = index.extended(phrases)
                for a in range(0, len(phrases), 1 << 18):
                    part = Phrases(*(x[a : a + (1 << 18)] for x in (phrases.words, phrases.low, phrases.low_reversed, phrases.size)))
                    sides = [
                        pa.array(keys[only].view(np.int64), mask=only == 0) for only in (index.only_before(part), index.only_after(part))
                    ]
                    columns = [values.take(pa.array(c)) for c in part.words.T]
                    yield _rows(lang, length, pc.binary_join_element_wise(*columns, b" "), part.size, *sides)

    return run


def _rows(lang: str, length: int, phrase: pa.Array, counts: np.ndarray, before: pa.Array, after: pa.Array) -> pa.RecordBatch:
    n = len(phrase)
    return pa.RecordBatch.from_arrays(
        [
            pa.repeat(pa.scalar(lang, pa.string()), n), pa.array(np.full(n, length, np.int32)), phrase.cast(pa.string()),
            pa.array(counts.astype(np.int64)), before, after,
        ],
        ["lang", "length", "phrase", "count", "before", "after"],
    )


def frequent_filter(pairs: DataFrame, least: int, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of ``bits`` bits with that of every pair key set whose ``count`` adds up to ``least`` or more.

    Spark builds it in buckets, so what comes to the driver is bounded by ``bits``.
    """
    slots = pairs.groupBy("pair").agg(F.sum("count").alias("count")).where(F.col("count") >= least)
    # bitmap positions begin at 1 in the bucket after those that hold 1 to 32768
    slot = F.col("pair").bitwiseAND(bits - 1) + 1
    buckets = slots.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap")
    )
    out = np.zeros(bits // 8, np.uint8)
    for bucket, bitmap in buckets.collect():
        at = (bucket - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(bitmap), np.uint8)[: len(out) - at]
    return out


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, length, phrase, count, before, after) of all words and of phrases of 2 to ``longest`` words that occur
    ``least`` times or more; ``before`` and ``after`` are the hash of the only word at that side, null if it varies.

    Null texts count as empty and null languages as ``und``; an empty table gives no rows. Repeated rows count each.
    """
    texts = docs.select(
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang")
    )
    bits = docs.sparkSession.sparkContext.broadcast(
        frequent_filter(texts.mapInArrow(_pair_counts, "pair long, count long"), least, filter_bits)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _phrase_counts(bits.value, longest)(batches)

    found = texts.mapInArrow(run, "lang string, length int, phrase string, count long, before long, after long")
    only = {
        side: F.when((F.count(side) == F.count(F.lit(1))) & (F.min(side) == F.max(side)), F.min(side)).alias(side)
        for side in ("before", "after")
    }
    summed = found.groupBy("lang", "length", "phrase").agg(F.sum("count").alias("count"), *only.values())
    return summed.where((F.col("length") == 1) | (F.col("count") >= least))


def _words(phrase: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, top: int = TOP, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    The score of a phrase is that of its weakest cut, floor(1000 a n / (l r)) in exact arithmetic, where a, l and r count
    the phrase and both its parts and n all words. A phrase that occurs only inside a longer one of the same count is
    dropped. Ties go by count, then by the bytes of the phrase.
    """
    found = cut_lineage(phrases(docs, longest, least, filter_bits))
    counts = found.select("lang", "phrase", "count")
    total = found.where("length = 1").groupBy("lang").agg(F.sum("count").alias("n"))
    candidates = found.where("length > 1")
    # a phrase with the same word beside all its occurrences is part of a longer one that occurs as often
    inside = candidates.where(F.col("length") > 2).select(
        "lang", F.col("count").alias("a"),
        F.explode(
            F.array(
                _words(F.col("phrase"), F.lit(1), F.col("length") - 1), _words(F.col("phrase"), F.lit(2), F.col("length") - 1)
            )
        ).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    flagged = F.col("before").isNotNull() | F.col("after").isNotNull()
    alone = (
        candidates.join(inside, ["lang", "phrase"], "left")
        .where(~F.coalesce(flagged & (F.col("longer") == F.col("count")), F.lit(False)))
        .select("lang", "phrase", "length", F.col("count").alias("a"))
    )
    cuts = alone.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1))).select(
        "lang", "phrase", "a", "k", _words(F.col("phrase"), F.lit(1), F.col("k")).alias("head"),
        _words(F.col("phrase"), F.col("k") + 1, F.col("length") - F.col("k")).alias("tail"),
    )
    parts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("count").alias("l")), ["lang", "head"])
    parts = parts.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("count").alias("r")), ["lang", "tail"])
    wide = {c: F.col(c).cast("decimal(18,0)") for c in "alrn"}
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide["n"] * wide["a"], wide["l"] * wide["r"])
    scored = (
        parts.join(total, "lang")
        .withColumn("score", score)
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    )
    # a language may hold most phrases: they are numbered by ranges of the order, never in one task
    placed = positions(cut_lineage(scored), ["lang"], [F.desc("score"), F.desc("a"), "phrase"], "rank", crowded=0)
    return placed.where(F.col("rank") < top).select("lang", (F.col("rank") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
