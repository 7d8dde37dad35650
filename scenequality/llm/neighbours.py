"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenequality.session import cut_lineage

TABLES = 8
PROBES = 16
ROTATIONS = 3
BLOCK_ROWS = 4096
COPY_SALTS = 12
SEED = 20


def _next_power(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def rotate(vectors: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Pseudo-rotation of rows: random signs and a fast Hadamard transform, three times over."""
    n, d = vectors.shape
    size = _next_power(d)
    y = np.zeros((n, size))
    y[:, :d] = vectors
    random = np.random.default_rng([seed, table, size])
    for _ in range(ROTATIONS):
        y = y * random.choice((-1.0, 1.0), size)
        half = 1
        while half < size:
            pair = y.reshape(n, size // (2 * half), 2, half)
            y = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, size)
            half *= 2
        y /= np.sqrt(size)
    return y


def buckets(vectors: np.ndarray, table: int, probes: int = 1) -> np.ndarray:
    """The ``probes`` nearest signed axes of each rotated row, nearest first: 2 x axis, and 1 more if negative."""
    y = rotate(vectors, table)
    axes = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
    return 2 * axes + (np.take_along_axis(y, axes, 1) < 0)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part: an id, and a vector that is neither null, empty nor zero and
    has no null or non-finite component."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector")
    )


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(vector, ids): each different vector once with its ``keep`` smallest different ids; no other copy can be among
    the ``keep`` nearest of anything. Repeated rows go first. Copies are then limited per task, per salt, and once
    more, so that a vector of millions of rows sends a few hundred to the task that ends its list."""
    salted = rows.dropDuplicates(["vec_id", "vector"]).withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(COPY_SALTS)))
    for group in (["vector", "_salt"], ["vector"]):
        order = Window.partitionBy(*group).orderBy("vec_id")
        salted = salted.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep)
    return salted.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


_CELL = ["size", "table_no", "bucket"]


def in_cells(rows: DataFrame, probes: int, tables: int = TABLES) -> DataFrame:
    """``rows`` once per table and probed bucket: size (vector length), table_no and bucket are added."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):
            vectors = batch.column("vector").to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = np.array([vectors[i] for i in rows], np.float64)
                x /= np.abs(x).max(1, keepdims=True)  # only directions count, and norms must stay finite
                chosen = batch.take(pa.array(rows))
                for t in range(tables):
                    for bucket in buckets(x, t, probes).T:
                        cell = [np.full(len(rows), size), np.full(len(rows), t), bucket]
                        columns = [*chosen.columns, *(pa.array(c, pa.int32()) for c in cell)]
                        yield pa.RecordBatch.from_arrays(columns, [*chosen.schema.names, *_CELL])

    return rows.mapInArrow(run, f"{fields}, size int, table_no int, bucket int")


def _rerank(keep: int, candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Exact scores of a block of queries against a block of candidates; each query's ``keep`` best ids leave it. An id
    with several vectors counts once, with its best."""
    keys, found, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if len(candidates) and len(asked):
        x, q = (np.stack(side["vector"].to_numpy()).astype(np.float64) for side in (candidates, asked))
        names, copies = asked["query_key"].to_numpy(), candidates["ids"].to_numpy()
        ids, held = np.concatenate(copies), np.array([len(c) for c in copies])
        different, at = np.unique(ids, return_inverse=True)
        several = len(different) < len(ids)
        if several:  # columns become ids instead of vectors
            order = np.argsort(at, kind="stable")
            column = np.repeat(np.arange(len(held)), held)[order]
            bounds = np.searchsorted(at[order], np.arange(len(different)))
            ids, held = different, np.ones(len(different), np.int64)
        first = np.cumsum(held) - held
        step = max(1, min(256, (1 << 22) // len(column))) if several else 256
        for start in range(0, len(q), step):
            scores = q[start : start + step] @ x.T
            if several:
                scores = np.maximum.reduceat(scores[:, column], bounds, axis=1)
            last = max(0, scores.shape[1] - keep)
            least = np.partition(scores, last, axis=1)[:, last]
            i, j = np.nonzero(scores >= least[:, None])  # ties with the last one stay
            n = held[j]
            keys.append(np.repeat(names[start + i], n))
            values.append(np.repeat(scores[i, j], n))
            found.append(ids[np.repeat(first[j] - np.cumsum(n) + n, n) + np.arange(n.sum())])
    return pd.DataFrame({"query_key": np.concatenate(keys), "vec_id": np.concatenate(found), "score": np.concatenate(values)})


def in_blocks(base: DataFrame, queries: DataFrame, keep: int, block_rows: int) -> DataFrame:
    """Scores within every cell. Both sides of a cell are cut by hash into blocks of about ``block_rows`` and
    every pair of blocks is one group, so groups stay small however full a cell is."""

    def cut(rows: DataFrame, name: str) -> DataFrame:
        counts = rows.groupBy(*_CELL).agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
        return cut_lineage(counts)  # a row per cell: tables x axes

    many, asked = cut(base.select(*_CELL), "blocks"), cut(queries.select(*_CELL), "query_blocks")
    sizes = many.join(asked, _CELL)

    def every(name: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    def own(column: str, name: str) -> F.Column:
        return F.pmod(F.xxhash64(column), F.col(name)).cast("int")

    def rerank(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return _rerank(keep, candidates, asked)

    group = [*_CELL, "block", "query_block"]
    left = base.join(sizes, _CELL).withColumn("block", own("vector", "blocks")).withColumn("query_block", every("query_blocks"))
    right = queries.join(sizes, _CELL).withColumn("query_block", own("vector", "query_blocks")).withColumn("block", every("blocks"))
    return left.select(*group, "vector", "ids").groupBy(*group).cogroup(
        right.select(*group, "vector", "query_key").groupBy(*group)
    ).applyInPandas(rerank, "query_key long, vec_id long, score double")


def best(found: DataFrame, key: str, keep: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def search(vectors: DataFrame, is_query: F.Column, neighbours: int = 20, tables: int = TABLES,
           probes: int = PROBES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``neighbours`` rows of largest inner product found for each query row of ``vectors`` (vec_id, embedding).

    Every usable row is indexed in ``tables`` tables under its nearest signed axis; a query looks into the
    buckets of its ``probes`` nearest axes in each, and all rows there are reranked by exact double-precision
    products. Equal vectors are searched once. Queries whose buckets hold fewer than ``neighbours`` others are
    compared with all rows.

    Columns query_id, rank, vec_id, score; ties go to the smaller vec_id. Only vectors of equal length are
    compared. Rows that ``usable`` leaves out take no part. An id is one neighbour and one query however many rows it
    has, and the best pair of vectors gives its score; it is never its own neighbour. Extra columns are ignored; an empty table gives no row.
    """
    keep = neighbours + 1  # the query's own row may be among them
    rows = usable(vectors)
    base = cut_lineage(distinct_vectors(rows, keep))
    asking = usable(vectors.where(is_query)).dropDuplicates(["vec_id", "vector"])
    queries = cut_lineage(asking.groupBy("vector").agg(F.min("vec_id").alias("query_key")))

    def ranked(pairs: DataFrame) -> DataFrame:
        return best(pairs.groupBy("query_key", "vec_id").agg(F.max("score").alias("score")), "query_key", keep)

    found = cut_lineage(ranked(in_blocks(in_cells(base, 1, tables), in_cells(queries, probes, tables), keep, block_rows)))
    few = found.groupBy("query_key").count().where(F.col("count") >= keep).select("query_key")
    short = cut_lineage(queries.join(few, "query_key", "left_anti"))
    if not short.isEmpty():
        whole = [F.size("vector").alias("size"), F.lit(-1).alias("table_no"), F.lit(0).alias("bucket")]
        rest = in_blocks(base.select("*", *whole), short.select("*", *whole), keep, block_rows)
        found = found.join(short, "query_key", "left_anti").unionByName(ranked(rest))
    named = asking.join(queries, "vector").select(F.col("vec_id").alias("query_id"), "query_key")
    pairs = named.join(found.drop("rank"), "query_key").where("query_id <> vec_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # a query id may have several vectors
    return best(pairs, "query_id", neighbours).select("query_id", "rank", "vec_id", "score")
