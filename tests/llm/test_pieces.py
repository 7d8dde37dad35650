"""The max-plus scan against a plain Viterbi pass, and decoding."""

import functools
import random

import numpy as np
import pytest

from scenequality.llm import sentence_pieces as sp
from scenequality.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
WORDS = sp.vocabulary(PATH)


def plain(text):
    """Best score and ids by looking at every substring."""
    n = len(text)
    best, came = [0.0] + [None] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(max(0, j - WORDS.longest), j):
            piece = WORDS.pieces.get(text[i:j])
            score = piece[0] if piece else WORDS.unknown if j == i + 1 else None
            if score is not None and best[i] is not None and (best[j] is None or best[i] + score > best[j]):
                best[j], came[j] = best[i] + score, i
    cuts = [n]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return best[n], sp._ids(text, cuts[::-1], WORDS)


def texts(alphabet, n, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_units_give_the_whole_text():
    encoder = sp.UnitEncoder(PATH, remembered=40)
    for text in texts(["the", "and", " ", "  ", "\n", "é", "▁", "🙂", "한", "x", ". "], 150, 30, 1):
        normal = sp.normalised(text, WORDS)
        assert encoder.encode([normal])[0] == plain(normal)[1]


def scanned(normal, size):
    encoder = sp.unit_encoder(PATH)
    chunks = list(sp.cut_chunks(normal, WORDS, size))
    start = np.full(WORDS.longest, sp.NO)
    start[0] = 0.0
    scores = sp.scores_before([sp.chunk_matrix(c, encoder) for c in chunks], start)
    leaves = sp.states_behind([sp.chunk_origins(c, s, encoder) for c, s in zip(chunks, scores, strict=True)], 0)
    return b"".join(sp.trace_chunk(c, s, j, encoder) for c, s, j in zip(chunks, scores, leaves, strict=True))


@pytest.mark.parametrize(
    "alphabet", [["the", "and", " of "], list("theandofingr"), ["▁", " ", "a"], ["  ", "é", "\n", "한x", "ing", ", "]])
def test_chunks_give_the_ids_of_the_whole_text(alphabet):
    for text in texts(alphabet, 25, 120, 2):
        normal = sp.normalised(text, WORDS)
        for size in (1, 3, 9, 40):
            assert scanned(normal, size) == plain(normal)[1]


def test_matrices_hold_the_best_scores():
    encoder = sp.unit_encoder(PATH)
    for text in texts(["the", "and", " of ", "x"], 20, 40, 3):
        normal = sp.normalised(text, WORDS)
        if normal:
            whole = [sp.chunk_matrix(c, encoder) for c in sp.cut_chunks(normal, WORDS, 7)]
            assert functools.reduce(sp.times, whole)[0, 0] == plain(normal)[0] == encoder.score(normal)


def test_products_are_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((5, 5)) < 0.3, -np.inf, rng.integers(-9, 1, (5, 5))) for _ in range(3))
    assert (sp.times(sp.times(a, b), c) == sp.times(a, sp.times(b, c))).all()


def test_round_trip(spark):
    giant = "theandofing" * 900 + " with spaces " * 300
    rows = [(1, "Hello, wörld  🙂\n"), (2, None), (3, ""), (4, giant), (4, giant), (None, " x"), (5, "a" * 3000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, ids int")
    found = sp.decode(sp.encode(docs, PATH, giant=500, chunk=200), PATH).collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.text) for r in found), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    ids = lambda rows: sorted((str(r.doc_id), bytes(r.ids)) for r in rows)
    assert ids(found) == ids(sp.encode(docs, PATH).collect())
    assert all(len(r.ids) == 0 for r in found if not r.text)
    assert sp.encode(docs.limit(0), PATH).count() == 0
