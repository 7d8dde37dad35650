"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

Every document is a weighted set of hashed five-word shingles. Darts fall on the plane of (weight, rank) above each
shingle, the same ones wherever that shingle occurs; those below its weight hit the document. Each coordinate of the
signature keeps its earliest dart, so two signatures agree in a coordinate with the chance of their weighted Jaccard
similarity. Equal band keys join documents into loose groups, inside which similarity is then computed exactly.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequality.llm.common import slices, strings
from scenequality.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 34
ROWS = 7  # coordinates of a band: at similarity 0.8 one band of 34 agrees with a chance of 0.9997, at 0.2 of 0.0004
BLOCK_ROWS = 256
_U = np.uint64


# ---------------------------------------------------------------- shingles


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers (two multiply-and-shift rounds)."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


@functools.lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Lower case of every letter, digit and mark, 0 for what separates words."""
    fold = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum():
            low = ch.lower()
            fold[c] = ord(low) if len(low) == 1 else c
        elif c > 0x2FF and unicodedata.category(ch)[0] == "M":
            fold[c] = c
    return fold


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of letters and digits, and where each text's words begin (and the end)."""
    joined = ("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass")
    c = _folded()[np.frombuffer(joined, np.uint32)]
    inside = c > 0
    before = np.concatenate([[False], inside[:-1]])
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(before & ~inside)
    base = _U(0x9E3779B97F4A7C15)
    powers = np.full(len(c) + 1, base, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(c.astype(np.uint64)) * powers[:-1], dtype=np.uint64)])
    # a word's sum starts at a power of the base that depends on its place; its inverse takes that away
    inverse = np.full(len(c) + 1, _U(pow(int(base), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    hashes = mix((sums[end] - sums[start]) * inverse[start])
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    return hashes, np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]))


def shingles(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Hashes of the runs of ``size`` words of each text, repeats included; a shorter text is one run."""
    words, bounds = word_hashes(texts)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        n = b - a
        long = min(size, n)
        value = np.full(max(n - size + 1, int(n > 0)), _U(long), np.uint64)
        for j in range(long):
            value = value * _U(0x2545F4914F6CDD1D) + padded[a + j : a + j + len(value)]
        out.append(mix(value))
    return out


# ---------------------------------------------------------------- signatures


@functools.lru_cache(maxsize=256)
def _poisson(mean: float) -> np.ndarray:
    """Cumulative chances of 0, 1, 2, ... darts."""
    top = int(mean + 12 * np.sqrt(mean) + 30)
    k = np.arange(1, top)
    return np.cumsum(np.exp(np.concatenate([[0.0], np.cumsum(np.log(mean / k))]) - mean))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def _spans(limit: float, first: float) -> Iterator[tuple[int, float, float]]:
    """Cells [0, first), [first, 2 first), ... as far as they begin below ``limit``."""
    number, low, high = 0, 0.0, first
    while low < limit:
        yield number, low, high
        number, low, high = number + 1, high, 2 * high


def darts(elements: np.ndarray, weights: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Element number, rank and id of every dart below an element's weight and below its rank limit.

    The plane above an element is cut into cells by doubling weights and ranks; the number of darts in a cell is
    Poisson with the cell's area as mean, and all is drawn from the hash of element and cell.
    """
    numbers, ranks, ids = [], [], []
    for column, low, high in _spans(float(weights.max(initial=0)), 1.0):
        for row, near, far in _spans(float(limits.max(initial=0)), 2.0**-8):
            use = np.flatnonzero((weights > low) & (limits > near))
            seed = mix(elements[use] + _U((column * 4096 + row + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            chances = _poisson((high - low) * (far - near))
            some = np.flatnonzero(seed >= _U(int(float(chances[0]) * 2**64)))  # most cells hold none
            use, seed = use[some], seed[some]
            n = np.searchsorted(chances, _unit(seed), "right")
            use, seed = np.repeat(use, n), np.repeat(seed, n)
            turn = np.arange(len(use)) - np.repeat(np.cumsum(n) - n, n)
            name = mix(seed + (turn + 1).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))
            rank = near + (far - near) * _unit(mix(name + _U(1)))
            height = low + (high - low) * _unit(mix(name + _U(2)))
            real = (height < weights[use]) & (rank < limits[use])
            numbers.append(use[real])
            ranks.append(rank[real])
            ids.append(name[real])
    return np.concatenate(numbers), np.concatenate(ranks), np.concatenate(ids)


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, sets: int, size: int) -> np.ndarray:
    """(sets x size) ids of the earliest dart in each coordinate of weighted sets of distinct elements; ``owner`` says
    whose element it is, and every set has one. All sets are drawn at once; those whose darts leave a coordinate
    empty are drawn again with a higher limit."""
    kept = np.zeros((sets, size), np.uint64)
    total = np.bincount(owner, weights, sets)
    limit = (size * np.log(size) + 2 * size) / total  # darts expected below it: enough to fill most signatures
    going = np.arange(sets)
    while len(going):
        place = np.full(sets, -1)
        place[going] = np.arange(len(going))
        mine = np.flatnonzero(place[owner] >= 0)
        number, rank, name = darts(elements[mine], weights[mine], limit[owner[mine]])
        cell = place[owner[mine[number]]] * size + (name % _U(size)).astype(np.int64)
        best = np.full(len(going) * size, np.inf)
        np.minimum.at(best, cell, rank)
        first = rank == best[cell]
        filled = np.zeros(len(best), np.uint64)
        filled[cell[first]] = name[first]
        kept[going] = filled.reshape(-1, size)
        going = going[~np.isfinite(best).reshape(-1, size).all(1)]
        limit[going] *= 2
    return kept


def signature(elements: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """The signature of one set."""
    return signatures(elements, weights, np.zeros(len(elements), np.int64), 1, size)[0]


def band_keys(sketches_: np.ndarray, bands: int, rows: int) -> np.ndarray:
    value = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketches_), bands))
    for column in np.moveaxis(sketches_.reshape(-1, bands, rows), 2, 0):
        value = mix(value * _U(0x2545F4914F6CDD1D) + column)
    return value


def _node(text: str, distinct: np.ndarray, counts: np.ndarray | None) -> bytes:
    """16 bytes that name a document's content: equal shingle sets (with their counts, if those matter) share it;
    texts without words share it if they are equal."""
    if not len(distinct):
        return b"\0" + np.frombuffer(_digest(text.encode("utf-8", "surrogatepass")), np.uint8).tobytes()[:15]
    value = distinct if counts is None else mix(distinct + counts.astype(np.uint64))
    return np.array([mix(value).sum(dtype=np.uint64), mix(value + _U(len(value))).sum(dtype=np.uint64)], "<u8").tobytes()


def _digest(data: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(data, digest_size=16).digest()


def text_key(text: str = "text") -> F.Column:
    """16 bytes that tell texts apart; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> DataFrame:
    """(doc_id, text_key, node, keys) of ``docs`` (doc_id, text): the name of the content and its band keys.

    Weights are 1 for each different shingle, or how often it occurs if ``counted``. Null text counts as empty;
    texts without words have no keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = strings(part, "text")
                found = [np.unique(x, return_counts=True) for x in shingles(texts)]
                nodes = [_node(t, x, n if counted else None) for t, (x, n) in zip(texts, found, strict=True)]
                place = {node: k for k, node in reversed(list(enumerate(nodes))) if len(found[k][0])}
                some = [found[k] for k in place.values()]
                keys = np.zeros((0, bands), np.int64)
                if some:
                    x, n = (np.concatenate(c) for c in zip(*some, strict=True))
                    owner = np.repeat(np.arange(len(some)), [len(y) for y, _ in some])
                    weights = n.astype(float) if counted else np.ones(len(x))
                    keys = band_keys(signatures(x, weights, owner, len(some), bands * rows), bands, rows).astype(np.int64)
                order = {node: k for k, node in enumerate(place)}
                own = np.array([order.get(node, -1) for node in nodes])
                offsets = np.concatenate([[0], np.cumsum(np.where(own >= 0, bands, 0))])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("text_key"), pa.array(nodes, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[own[own >= 0]].ravel(), pa.int64())),
                    ],
                    ["doc_id", "text_key", "node", "keys"],
                )

    schema = "doc_id long, text_key binary, node binary, keys array<long>"
    return docs.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(run, schema)


# ---------------------------------------------------------------- groups


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b), label being the least node that can be reached.

    Alternates two steps until nothing changes: every node sends its larger neighbours, then its smaller ones, to
    the least it knows. The number of rounds grows with the logarithm of the longest path. Only partial minima
    and narrow edges are shuffled, and each round is written, so a lost executor repeats one round at most.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        )).alias("e")).select("e.*").where("a <> b").distinct()
        edges = cut_lineage(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )


def _overlaps(one: np.ndarray, others: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of ``one``'s sorted elements each run of ``others`` holds."""
    at = np.searchsorted(one, others)
    same = (at < len(one)) & (one[np.minimum(at, len(one) - 1)] == others)
    return np.add.reduceat(same, bounds[:-1], dtype=np.int64)


def _alike(one: np.ndarray, sets: list[np.ndarray], least: float) -> np.ndarray:
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    shared = _overlaps(one, np.concatenate(sets), bounds)
    return shared >= least * (len(one) + np.diff(bounds) - shared) - 1e-9


def link_block(nodes: list[bytes], sets: list[np.ndarray], least: float) -> list[int]:
    """For each set the index of the first member of its component, where sets of similarity ``least`` or more are
    linked. Each component spreads from its first member over the sets not yet reached, so tight groups cost a few
    passes and no pair is listed."""
    group = [-1] * len(sets)
    rest = list(range(len(sets)))
    while rest:
        root = rest.pop(0)
        group[root] = root
        waiting = [root]
        while waiting and rest:
            alike = _alike(sets[waiting.pop()], [sets[i] for i in rest], least)
            for i in [i for i, yes in zip(rest, alike, strict=True) if yes]:
                group[i] = root
                waiting.append(i)
            rest = [i for i, yes in zip(rest, alike, strict=True) if not yes]
    return group


def _sets(frame: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in frame["elements"]]


_GROUP = ["loose", "block"]


def _inside(rows: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) from each node to the first of its component in its block."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node").drop_duplicates("node")
        nodes = list(frame["node"])
        group = link_block(nodes, _sets(frame), least)
        return pd.DataFrame({"a": nodes, "b": [nodes[g] for g in group]})

    return rows.groupBy(*_GROUP).applyInPandas(run, "a binary, b binary")


def _across(rows: DataFrame, asked: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) between the rows of each block and the ``asked`` rows sent to it, where they are alike."""

    def run(frame: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        if len(frame) and len(other):
            nodes, sets = list(frame["node"]), _sets(frame)
            for name, one in zip(other["node"], _sets(other), strict=True):
                for i in np.flatnonzero(_alike(one, sets, least)):
                    a.append(nodes[i])
                    b.append(name)
        return pd.DataFrame({"a": a, "b": b})

    asked = asked.select(*_GROUP, "node", "elements").toDF(*_GROUP, "node", "elements")  # both come from the same rows
    return rows.groupBy(*_GROUP).cogroup(asked.groupBy(*_GROUP)).applyInPandas(run, "a binary, b binary")


def verified(rows: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) that connect exactly the nodes of ``rows`` (loose, block, blocks, node, elements) that chains of
    similarity ``least`` or more connect within a loose group.

    Blocks are linked on their own. Where a loose group has several, one anchor, from its largest block component,
    is compared with every row; whatever is still apart from the anchor's component is then compared with every
    row of the group. Any link between two components has an end outside the anchor's, so none is lost.
    """
    rows = cut_lineage(rows)
    edges = cut_lineage(_inside(rows, least))
    split = rows.where("blocks > 1")
    if split.isEmpty():
        return edges

    def everywhere(some: DataFrame) -> DataFrame:
        return some.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    held = split.select("loose", "node").join(edges, F.col("node") == F.col("a"))
    sizes = held.groupBy("loose", "b").count()
    anchors = sizes.groupBy("loose").agg(F.max(F.struct("count", "b"))["b"].alias("anchor"))
    anchor_rows = split.join(anchors.select(F.col("anchor").alias("node")), "node")
    edges = cut_lineage(edges.unionByName(_across(split, everywhere(anchor_rows), least)))
    labels = cut_lineage(components(edges))
    own = split.select("loose", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # a row per large group, written so that joining it by group is a join alone, which can be split or broadcast
    main = cut_lineage(anchors.join(labels, F.col("anchor") == F.col("node"), "left").select(
        "loose", F.coalesce("label", "anchor").alias("main")))
    apart = own.join(main, "loose").where("label <> main").select("node")
    return edges.unionByName(_across(split, everywhere(split.join(apart, "node")), least))


def _labelled(docs: DataFrame, least: float, bands: int, rows: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of ``docs``, and (node, first, label) of each content: first is its row of smallest doc_id (rows
    without one last) and text key, label the least node of its class."""
    docs = docs.select("doc_id", "text")
    sketched = cut_lineage(sketches(docs, bands, rows))
    row = F.struct(F.col("doc_id").isNull().alias("unnumbered"), "doc_id", "text_key")
    contents = cut_lineage(sketched.groupBy("node").agg(F.min(row).alias("first"), F.min("keys").alias("keys")))
    keyed = contents.select("node", F.posexplode("keys").alias("band", "key"))
    leaders = keyed.groupBy("band", "key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    pairs = keyed.join(leaders, ["band", "key"]).select(F.col("node").alias("a"), F.col("leader").alias("b"))
    loose = cut_lineage(components(pairs)).withColumnRenamed("label", "loose")
    sizes = loose.groupBy("loose").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    own = contents.select("node", F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"))
    wanted = loose.join(sizes, "loose").join(own, "node").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data = [np.unique(s).tobytes() for s in shingles(strings(part, "text"))]
                kept = part.drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(data, pa.binary())], [*kept.schema.names, "elements"])

    # one text per content: other texts of its doc_id have other keys, and repeats of the row go
    same = docs["doc_id"].eqNullSafe(wanted["_id"]) & (text_key() == wanted["_key"])
    texts = docs.join(wanted, same).select("loose", "block", "blocks", "node", "text").distinct()
    sets = texts.mapInArrow(elements, "loose binary, block int, blocks int, node binary, elements binary")
    labels = cut_lineage(components(verified(sets, least)))
    named = contents.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return sketched, cut_lineage(named)


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, class_id) of every row of ``docs`` (doc_id, text, any more).

    Documents are linked if their sets of different five-word shingles (lower-cased words of letters and digits;
    a shorter text is one shingle) have a Jaccard similarity of ``least`` or more; a class is what links connect,
    and class_id its smallest doc_id. Null text counts as empty; texts without words are linked if equal. Classes
    of which no row has a doc_id have a null class_id. Repeated rows give repeated rows. An empty table gives none.
    """
    sketched, named = _labelled(docs, least, bands, rows, block_rows)
    classes = named.groupBy("label").agg(F.min("first.doc_id").alias("class_id"))
    by_node = cut_lineage(named.join(classes, "label").select("node", "class_id"))
    return sketched.select("doc_id", "node").join(by_node, "node").select("doc_id", "class_id")


def first_of_classes(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row of ``docs`` for each class of ``near_duplicates``: that of smallest doc_id (rows without one last), and
    of several texts under that id the one of smallest text key."""
    named = _labelled(docs, least, bands, rows, block_rows)[1]
    kept = named.groupBy("label").agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_first"))
    keyed = docs.withColumn("_key", text_key())
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_first"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_key"]).drop("_key")
