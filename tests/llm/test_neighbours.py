"""Neighbour search: recall against brute force, ties, copies and unusable vectors."""

import numpy as np
from pyspark.sql import functions as F

from scenequality.llm import neighbours
from scenequality.llm.common import table

DATA = "/root/testdata/sf0.01"
def every_20():
    return F.col("vec_id") % 20 == 0


def brute(rows, ids, k):
    x = np.array([v for _, v in rows], float)
    names = np.array([i for i, _ in rows])
    out = {}
    for q in ids:
        score = x @ x[list(names).index(q)]
        order = [j for j in np.lexsort((names, -score)) if names[j] != q][:k]
        out[q] = [(int(names[j]), score[j]) for j in order]
    return out


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(20, 48))
    y = neighbours.rotate(x, 3)
    assert y.shape == (20, 64) and np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))


def test_recall_on_the_table(spark):
    vectors = table(spark, DATA, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    found = neighbours.search(vectors, every_20()).collect()
    want = brute(rows, {r.query_id for r in found}, 20)
    hits = sum((r.vec_id in dict(want[r.query_id])) for r in found)
    assert len(found) == 20 * len(want) and hits / len(found) >= 0.9
    scores = {(q, i): s for q, best in want.items() for i, s in best}
    assert all(abs(r.score - scores[r.query_id, r.vec_id]) < 1e-12 for r in found if (r.query_id, r.vec_id) in scores)


def test_copies_ties_blocks_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0] + [0.0] * 7) for i in range(300)]  # one vector three hundred times, some of them queries
    bad = [(400, None), (420, []), (440, [0.0] * 8), (460, [1.0, None] + [0.0] * 6), (480, [float("nan")] * 8),
           (500, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    vectors = spark.createDataFrame([(i, v, 5) for i, v in rows + bad], "vec_id long, embedding array<double>, rank int")
    found = {}
    for r in neighbours.search(vectors, every_20(), 20, probes=8, block_rows=7).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert set(found) == set(want)
    for q, best in want.items():
        assert sorted(found[q]) == list(range(1, 21))
        assert np.allclose([found[q][k + 1][1] for k in range(20)], [s for _, s in best])
        if q >= 100:  # all products are exact here, so ties must go to the smaller id
            assert [found[q][k + 1][0] for k in range(20)] == [i for i, _ in best]


def test_repeated_rows_of_a_hot_vector(spark):
    far = [(100 + i, [0.5, 0.1 * i] + [0.0] * 6) for i in range(30)]
    rows = [(i, [1.0] + [0.0] * 7) for i in range(1, 31)] + far
    vectors = spark.createDataFrame(rows + rows, "vec_id long, embedding array<double>")
    found = neighbours.search(vectors, F.col("vec_id") == 20).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [i for i in range(1, 22) if i != 20]


def test_ids_of_several_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0])]
    rows += [(2, [2.0, 0.01 * i]) for i in range(40)]  # for (1, 0) all before the others, and all one neighbour
    rows += [(10 + i, [0.5, 0.25 * i]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.search(vectors, F.col("vec_id") == 1).orderBy("rank").collect()
    score = {2: 2.0} | {10 + i: max(0.5, 0.25 * i) for i in range(30)}
    want = sorted(score, key=lambda i: (-score[i], i))[:20]
    assert [(r.rank, r.vec_id, r.score) for r in found] == [(k + 1, i, score[i]) for k, i in enumerate(want)]


def test_few_candidates_and_empty_table(spark):
    rows = [(0, [1.0, 0.0]), (1, [-1.0, 0.1]), (2, [0.0, -1.0]), (40, [3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.search(vectors, every_20(), probes=1, tables=1).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(0, 2), (0, 1)]
    assert neighbours.search(vectors.limit(0), every_20()).count() == 0
