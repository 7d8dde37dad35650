"""SentencePiece encoding and decoding of documents of any length by a max-plus scan.

A text is segmented into the pieces of a model file so that the sum of their scores is greatest. Short texts are
segmented unit by unit, a unit being what no piece can cross. Giant texts are cut into chunks of equal length, wherever
that falls. Each chunk gives a max-plus matrix: from how far a piece of the chunk before reaches into it, to how far one
of its own reaches into the next, the best score between. Matrices are combined associatively, first in blocks of
chunks, then along the text, which gives the scores of all states before every chunk. With these each chunk tells which
state each of its last ones comes from; these maps are combined in the same way from the right, and each chunk is traced
back by itself. Ties fall as in one pass over the whole text, so the ids are the same.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequality.llm.common import slices, strings
from scenequality.session import cut_lineage

SPACE = "▁"  # how the vocabulary writes a space
GIANT = 1 << 15  # characters from which a text is cut into chunks
CHUNK = 1 << 13
CHUNKS_PER_BLOCK = 64
REMEMBERED = 200_000
UNKNOWN = 10.0  # an unknown character scores this much less than the worst piece
NO = -np.inf


@dataclass(frozen=True)
class Vocabulary:
    """Scores and ids of the normal pieces, ids of the 256 byte pieces, the tree of what a piece can begin with
    (per character: the score, null if it is no piece itself, and what can follow), all pairs of neighbouring
    characters in a piece, the score of an unknown character, the longest piece, whether a space is put before a
    text, all names, and whether a line break is in no piece."""

    pieces: dict[str, tuple[float, int]]
    bytes_: tuple[int, ...]
    tree: dict[str, tuple]
    pairs: frozenset[str]
    unknown: float
    longest: int
    prefix: bool
    names: tuple[str, ...]
    lone_newline: bool


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2 as model

    proto = model.ModelProto()
    with open(path, "rb") as source:
        proto.ParseFromString(source.read())
    kind = model.ModelProto.SentencePiece
    normal = {p.piece: (p.score, i) for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
    single = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
    if len(single) != 256:
        raise ValueError("a vocabulary with all 256 byte pieces is needed")
    rules = proto.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
        raise ValueError("only models that keep the text as it is are read")
    tree: dict[str, tuple] = {}
    for piece in normal:
        level = tree
        for k, char in enumerate(piece, 1):
            level = level.setdefault(char, (normal.get(piece[:k], (None,))[0], {}))[1]
    return Vocabulary(
        normal, tuple(single[b] for b in range(256)), tree, frozenset(p[k : k + 2] for p in normal for k in range(len(p) - 1)),
        min(s for s, _ in normal.values()) - UNKNOWN,
        max(map(len, normal)), rules.add_dummy_prefix, tuple(p.piece for p in proto.pieces),
        not any("\n" in p for p in normal),
    )


def normalised(text: str, words: Vocabulary) -> str:
    return (SPACE + text if words.prefix and text else text).replace(" ", SPACE)


def best_path(text: str, stop: int, words: Vocabulary, entry: dict[int, float]) -> tuple[list[float], list[int]]:
    """Viterbi over the pieces that begin in ``text[:stop]``, from the scores of the positions in ``entry``.

    Gives the score of every position (-inf if none is reached) and the start of the best piece that ends there
    (-1 where a position was entered). Of equal scores the smallest start wins.
    """
    tree, n, alone = words.tree, len(text), (None, {})
    score, came = [NO] * (max(n, *entry) + 1), [-1] * (max(n, *entry) + 1)
    for at, value in entry.items():
        score[at] = value
    for i in range(stop):
        here = score[i]
        if here == NO:
            continue
        worth, level = tree.get(text[i], alone)
        if worth is None:
            worth = words.unknown
        j = i + 1
        if here + worth > score[j]:
            score[j], came[j] = here + worth, i
        while level and j < n:
            step = level.get(text[j])
            if step is None:
                break
            worth, level = step
            j += 1
            if worth is not None and here + worth > score[j]:
                score[j], came[j] = here + worth, i
    return score, came


def _ids(text: str, cuts: list[int], words: Vocabulary) -> bytes:
    out = array("I")
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        found = words.pieces.get(text[a:b])
        if found is not None:
            out.append(found[1])
        else:
            out.extend(words.bytes_[x] for x in text[a:b].encode("utf-8", "surrogatepass"))
    return out.tobytes()


def _trace(came: list[int], end: int) -> list[int]:
    cuts = [end]
    while came[cuts[-1]] >= 0:
        cuts.append(came[cuts[-1]])
    return cuts[::-1]


def encode_unit(unit: str, words: Vocabulary) -> tuple[float, bytes]:
    """Score and ids of a text by itself."""
    score, came = best_path(unit, len(unit), words, {0: 0.0})
    return score[len(unit)], _ids(unit, _trace(came, len(unit)), words)


class UnitEncoder:
    """Scores and ids of texts unit by unit. Units are cut where no piece can cross: before a run of spaces, around line
    breaks if no piece holds one, and between a word and what follows it if no piece holds that pair of characters.
    A vocabulary with a piece that goes on with a space behind something else leaves texts whole.

    About ``remembered`` units are kept; beyond that the half that came first, which holds the frequent ones."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.words = vocabulary(path)
        stop = "\n" if self.words.lone_newline else ""
        inner = f"[^{SPACE}{stop}]"
        crossed = any(b == SPACE != a for a, b in self.words.pairs)
        units = ".+" if crossed else (f"{stop}|" if stop else "") + f"{SPACE}*{inner}+|{SPACE}+"
        self._split = re.compile(units, re.DOTALL).findall
        self._ended = re.compile(r"(\W*\w+)(\W+)").fullmatch
        self._known: dict[str, bytes] = {}
        self._remembered = remembered
        scores = [self.words.pieces.get(name, (0.0,))[0] for name in self.words.names]
        for byte, i in enumerate(self.words.bytes_):
            scores[i] = 0.0 if byte & 0xC0 == 0x80 else self.words.unknown  # a character's first byte counts
        self._worth = np.array(scores)

    def _find(self, unit: str) -> bytes:
        found = self._known.get(unit)
        if found is None:
            found = self._known[unit] = encode_unit(unit, self.words)[1]
        return found

    def _learn(self, units: set[str]) -> None:
        new = units.difference(self._known)
        if len(self._known) + len(new) > self._remembered:
            self._known = dict(itertools.islice(self._known.items(), self._remembered // 2))
            new = units.difference(self._known)
        known, pairs = self._known, self.words.pairs
        for unit in new:
            parts = self._ended(unit)
            if parts is None or unit[parts.end(1) - 1 : parts.end(1) + 1] in pairs:
                self._find(unit)
                continue
            known[unit] = self._find(parts[1]) + self._find(parts[2])

    def encode(self, normal: list[str]) -> list[bytes]:
        """Ids of normalised texts."""
        split = [self._split(t) for t in normal]
        self._learn(set().union(*split))
        get = self._known.__getitem__
        return [b"".join(map(get, units)) for units in split]

    def score(self, normal: str) -> float:
        """The best sum of a normalised text."""
        return float(self._worth[np.frombuffer(self.encode([normal])[0], "<u4")].sum())


@functools.lru_cache(maxsize=2)
def unit_encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)


# ---------------------------------------------------------------- chunks of giant texts


def _safe(text: str, i: int, words: Vocabulary) -> bool:
    """Whether no piece can cross position i."""
    return i <= 0 or i >= len(text) or text[i - 1 : i + 1] not in words.pairs


@dataclass(frozen=True)
class Chunk:
    """A chunk ``text``, the characters ``ahead`` that its pieces can reach, and whether no piece can cross its start
    and its end."""

    text: str
    ahead: str
    behind_safe: bool
    ahead_safe: bool

    def whole(self, words: Vocabulary) -> str:
        return self.text + self.ahead[: words.longest - 1]

    def core(self, words: Vocabulary) -> tuple[int, int] | None:
        """The first and the last place that no piece can cross; None if there is none."""
        n = len(self.text)
        inner = range(1, n)
        first = 0 if self.behind_safe else next((i for i in inner if _safe(self.text, i, words)), None)
        last = n if self.ahead_safe else next((i for i in reversed(inner) if _safe(self.text, i, words)), None)
        if first is None and last is None:
            return None
        return (last if first is None else first), (first if last is None else last)


def cut_chunks(text: str, words: Vocabulary, size: int = CHUNK) -> Iterator[Chunk]:
    """``text`` in chunks of ``size`` characters."""
    for a in range(0, len(text), size):
        b = min(a + size, len(text))
        yield Chunk(text[a:b], text[b : b + words.longest], _safe(text, a, words), _safe(text, b, words))


def chunk_matrix(chunk: Chunk, encoder: UnitEncoder) -> np.ndarray:
    """The max-plus matrix of a chunk: entry i, a piece from before reaches i characters in; exit j, one reaches j
    characters into what is ahead. States that can't be are -inf.

    Where a place in the chunk is crossed by no piece, all paths meet there, so the matrix is the product of a column (up
    to the first such place), the score of the units between, and a row (from the last one on). Otherwise
    every entry takes a pass."""
    words, text, n = encoder.words, chunk.text, len(chunk.text)
    states = words.longest
    matrix = np.full((states, states), NO)
    whole, core = chunk.whole(words), chunk.core(words)
    if core is not None:
        first, last = core
        column, row = np.full(states, NO), np.full(states, NO)
        for i in range(min(states, first + 1)):
            column[i] = best_path(text[:first], first, words, {i: 0.0})[0][first]
        ends = best_path(whole[last:], n - last, words, {0: 0.0})[0][n - last : n - last + states]
        row[: len(ends)] = ends
        matrix[:] = column[:, None] + encoder.score(text[first:last]) + row[None, :]
    else:
        for i in range(min(states, n + 1)):
            ends = best_path(whole, n, words, {i: 0.0})[0][n : n + states]
            matrix[i, : len(ends)] = ends
        for i in range(n + 1, states):
            matrix[i, i - n] = 0.0  # one piece reaches over the whole of a short chunk
    if chunk.ahead_safe:
        matrix[:, 1:] = NO
    return matrix


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def scores_before(matrices: list[np.ndarray], scores: np.ndarray) -> list[np.ndarray]:
    """The scores of all states before each matrix, from those before the first."""
    out = [scores]
    for m in matrices[:-1]:
        out.append((out[-1][:, None] + m).max(0))
    return out


def states_behind(origins: list[list[int]], leave: int) -> list[int]:
    """The state after each chunk (or block) whose maps of origins are given, from that after the last."""
    out = [leave]
    for origin in origins[:0:-1]:
        out.append(origin[out[-1]])
    return out[::-1]


def _entries(scores: np.ndarray) -> dict[int, float]:
    return {i: v for i, v in enumerate(scores.tolist()) if v != NO}


def chunk_origins(chunk: Chunk, scores: np.ndarray, encoder: UnitEncoder) -> list[int]:
    """For each state after the chunk the one before it on the best path, given the scores of those before; of equal
    paths the one that a pass over the whole text would take. States that can't be give 0."""
    words, n = encoder.words, len(chunk.text)
    entries, core = _entries(scores), chunk.core(words)
    if list(entries) == [0]:
        return [0] * words.longest
    if core is not None:
        first = core[0]
        _, came = best_path(chunk.text[:first], first, words, {i: v for i, v in entries.items() if i <= first})
        return [_trace(came, first)[0]] * words.longest
    score, came = best_path(chunk.whole(words), n, words, entries)
    ends = [n + j for j in range(words.longest)]
    return [_trace(came, e)[0] if e < len(score) and score[e] != NO else 0 for e in ends]


def trace_chunk(chunk: Chunk, scores: np.ndarray, leave: int, encoder: UnitEncoder) -> bytes:
    """Ids of the pieces that begin in a chunk, given the scores of the states before it and the state after it."""
    words, text, n = encoder.words, chunk.text, len(chunk.text)
    whole, core, entries = chunk.whole(words), chunk.core(words), _entries(scores)
    if core is None:
        return _ids(whole, _trace(best_path(whole, n, words, entries)[1], n + leave), words)
    first, last = core
    head = best_path(text[:first], first, words, {i: v for i, v in entries.items() if i <= first})[1]
    tail = best_path(whole[last:], n - last, words, {0: 0.0})[1]
    return (
        _ids(text, _trace(head, first), words)
        + encoder.encode([text[first:last]])[0]
        + _ids(whole[last:], _trace(tail, n - last + leave), words)
    )


_CHUNK = ("key", "chunk", "block", "text", "ahead", "behind_safe", "ahead_safe")


def _chunks(docs: DataFrame, path: str, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for k, c in enumerate(cut_chunks(normalised(text, words), words, size)):
                    row = (key, k, k // CHUNKS_PER_BLOCK, c.text, c.ahead, c.behind_safe, c.ahead_safe)
                    yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(_CHUNK, row, strict=True)})

    return docs.select("key", "text").mapInArrow(
        run, "key binary, chunk long, block long, text string, ahead string, behind_safe boolean, ahead_safe boolean")


def _chunk(row: dict) -> Chunk:
    return Chunk(row["text"], row["ahead"], row["behind_safe"], row["ahead_safe"])


def _load(data: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.float64).reshape(*shape)


def _dump(scores: np.ndarray) -> bytes:
    return zlib.compress(scores.tobytes(), 1)


def _giants(docs: DataFrame, path: str, size: int) -> DataFrame:
    """(key, ids) of giant texts ``docs`` (key, text)."""
    chunks = cut_lineage(_chunks(docs, path, size))
    states = vocabulary(path).longest
    start = np.full(states, NO)
    start[0] = 0.0

    def each_chunk(rows: DataFrame, column: str, kind: str, value) -> DataFrame:
        """(key, chunk, block, column): ``value`` of every row of chunks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = unit_encoder(path)
            for batch in batches:
                made = [value(r, encoder) for r in batch.to_pylist()]
                made = pa.array(made, pa.list_(pa.int32()) if kind == "array<int>" else pa.binary())
                kept = batch.select(["key", "chunk", "block"]).columns
                yield pa.RecordBatch.from_arrays([*kept, made], ["key", "chunk", "block", column])

        return rows.mapInArrow(run, f"key binary, chunk long, block long, {column} {kind}")

    def product(frame: pd.DataFrame) -> pd.DataFrame:
        matrices = [_load(m, states, states) for m in frame.sort_values("chunk")["matrix"]]
        return pd.DataFrame({"key": frame["key"].iloc[:1], "block": frame["block"].iloc[:1], "matrix": [_dump(functools.reduce(times, matrices))]})

    def block_scores(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        found = scores_before([_load(m, states, states) for m in frame["matrix"]], start)
        return pd.DataFrame({"key": frame["key"], "block": frame["block"], "scores": list(map(_dump, found))})

    def chunk_scores(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        found = scores_before([_load(m, states, states) for m in frame["matrix"]], _load(frame["scores"].iloc[0], states))
        return pd.DataFrame({"key": frame["key"], "chunk": frame["chunk"], "scores": list(map(_dump, found))})

    matrices = cut_lineage(each_chunk(chunks, "matrix", "binary", lambda r, e: _dump(chunk_matrix(_chunk(r), e))))
    blocks = matrices.groupBy("key", "block").applyInPandas(product, "key binary, block long, matrix binary")
    before = blocks.groupBy("key").applyInPandas(block_scores, "key binary, block long, scores binary")
    scores = cut_lineage(matrices.join(before, ["key", "block"]).groupBy("key", "block").applyInPandas(
        chunk_scores, "key binary, chunk long, scores binary"))

    def composed(frame: pd.DataFrame) -> pd.DataFrame:
        origin = list(range(states))
        for step in frame.sort_values("chunk", ascending=False)["origin"]:
            origin = [int(step[s]) for s in origin]
        return pd.DataFrame({"key": frame["key"].iloc[:1], "block": frame["block"].iloc[:1], "origin": [origin]})

    def block_leaves(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        return pd.DataFrame({"key": frame["key"], "block": frame["block"], "leave": states_behind(list(frame["origin"]), 0)})

    def chunk_leaves(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        found = states_behind(list(frame["origin"]), int(frame["leave"].iloc[0]))
        return pd.DataFrame({"key": frame["key"], "chunk": frame["chunk"], "leave": found})

    scored = chunks.join(scores, ["key", "chunk"])
    origins = cut_lineage(each_chunk(
        scored, "origin", "array<int>", lambda r, e: chunk_origins(_chunk(r), _load(r["scores"], states), e)))
    of_blocks = origins.groupBy("key", "block").applyInPandas(composed, "key binary, block long, origin array<int>")
    behind = of_blocks.groupBy("key").applyInPandas(block_leaves, "key binary, block long, leave int")
    leaves = origins.join(behind, ["key", "block"]).groupBy("key", "block").applyInPandas(
        chunk_leaves, "key binary, chunk long, leave int")
    traced = each_chunk(
        scored.join(leaves, ["key", "chunk"]), "ids", "binary",
        lambda r, e: trace_chunk(_chunk(r), _load(r["scores"], states), r["leave"], e))

    def put_together(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": frame["key"].iloc[:1], "ids": [b"".join(frame.sort_values("chunk")["ids"])]})

    return traced.select("key", "chunk", "ids").groupBy("key").applyInPandas(put_together, "key binary, ids binary")


def encode(docs: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text): the pieces' ids as little-endian unsigned 32-bit.

    The segmentation is that of the greatest sum of the model's piece scores, whatever kind of model the file says
    it is (a file of merge ranks thus gives other ids than merging would); of equal sums the longest last
    pieces win. Characters without a piece become byte pieces. Null text counts as empty and gives no ids. Texts of
    more than ``giant`` characters are cut every ``chunk``, which changes no id where scores are whole numbers (others
    may be rounded differently); equal ones are encoded once. Repeated rows stay, extra columns are ignored, an empty
    table gives none.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    long = F.char_length("text") > giant

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = encoder.encode([normalised(t, encoder.words) for t in strings(part, "text")])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    key = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key")
    giants = rows.where(long).select("doc_id", key, "text")
    distinct = giants.groupBy("key").agg(F.any_value("text").alias("text"))
    found = giants.select("doc_id", "key").join(_giants(distinct, path, chunk), "key").select("doc_id", "ids")
    return rows.where(~long).mapInArrow(short, "doc_id long, ids binary").unionByName(found)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (ids, any more) with text: pieces put together, byte pieces as UTF-8 (what is none becomes
    U+FFFD), spaces written out, and the space before a text taken off. Null ids give a null text; an id outside
    the vocabulary stops the job; a column text is replaced."""
    encoded = encoded.drop("text")
    names = encoded.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        table = [n.replace(SPACE, " ").encode() if n in words.pieces else b"" for n in words.names]
        for value, i in enumerate(words.bytes_):
            table[i] = bytes([value])
        get = table.__getitem__
        for batch in batches:
            for part in slices(batch, "ids", 1 << 20):
                texts = []
                for ids in part.column("ids").to_pylist():
                    if ids is None:
                        texts.append(None)
                        continue
                    text = b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
                    texts.append(text[1:] if words.prefix and text.startswith(" ") else text)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "text"])

    return encoded.mapInArrow(run, f"{schema}, text string")
