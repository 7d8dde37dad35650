"""Collocations against counting every phrase in plain Python, and the index against its text."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scenequality.llm import collocations as C

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, phrase string, count long"


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER))]


def counted(docs, longest=5):
    f = defaultdict(Counter)
    for text, lang in docs:
        for words in pieces(text):
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    f[lang or "und"][tuple(words[i : i + n])] += 1
    return f


def plain(docs, least, top=2000, longest=5):
    out = []
    for lang, f in counted(docs, longest).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = set()
        for q, a in candidates.items():
            for size in range(2, len(q)):
                for i in range(len(q) - size + 1):
                    if a >= candidates[q[i : i + size]]:
                        dropped.add(q[i : i + size])
        rows = []
        for p, a in candidates.items():
            if p not in dropped:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus():
    rng = np.random.default_rng(11)
    draw = lambda n: " ".join(f"w{int(k)}" for k in np.minimum(rng.zipf(1.25, n), 300))
    docs = []
    for i in range(500):
        text = draw(int(rng.integers(1, 60)))
        if i % 3 == 0:
            text += ". The quick BROWN fox jumps over. " + draw(5)
        if i % 4 == 0:
            text += "\nNew York\tCity, new york  city new york!" + draw(3)
        docs.append((text, ["en", "de", None, "und"][i % 4]))
    docs += [(None, "en"), ("", None), (" \t ", "en"), ("...!?", "en"), ("a a a a a a a a", "en"), ("\x00 \x1c Ä İ \U0001f600", "de")]
    docs += [("one two three four five six seven", "en")] * 60  # copies
    return docs


def table(spark, docs, parts=6):
    return spark.createDataFrame([(i, t, g, "x", 1) for i, (t, g) in enumerate(docs)], SCHEMA).repartition(parts)


@pytest.mark.parametrize("least", [2, 20])
def test_every_case_against_plain_counts(spark, least):
    docs = corpus()
    assert got(C.collocations(table(spark, docs), least=least)) == plain(docs, least)


def test_a_full_filter_and_larger_shards_change_nothing(spark):
    docs = corpus()
    assert got(C.collocations(table(spark, docs), least=5, top=40, filter_bits=64)) == plain(docs, 5, 40)
    one = C.collocations(table(spark, docs, parts=1), least=5, longest=3)
    assert got(one) == plain(docs, 5, longest=3)


def test_empty_table(spark):
    assert got(C.collocations(table(spark, []))) == []


def test_scores_beyond_64_bits(spark):
    """1000 a n passes 64 bits long before counts do; the division stays exact."""
    from pyspark.sql import functions as F

    a, n, l, r = 3 * 10**12 + 7, 10**14 + 3, 10**13 + 9, 10**13 + 1
    row = spark.range(1).select(*(F.lit(v).cast("decimal(18,0)").alias(k) for k, v in zip("anlr", (a, n, l, r))))
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * F.col("n") * F.col("a"), F.col("l") * F.col("r"))
    assert row.select(score).first()[0] == 1000 * a * n // (l * r)


def test_index_extends_and_counts_both_sides():
    rng = np.random.default_rng(5)
    tokens = np.concatenate([[0], rng.integers(0, 5, 400), [0]]).astype(np.int32)
    index = C.ShardIndex(tokens, 4)
    phrases = index.words()
    for length in range(1, 5):
        if length > 1:
            phrases = index.extended(phrases)
        windows = defaultdict(list)
        for i in range(len(tokens) - length + 1):
            window = tuple(tokens[i : i + length].tolist())
            if 0 not in window:
                windows[window].append((tokens[i - 1], tokens[i + length] if i + length < len(tokens) else 0))
        found = [tuple(w) for w in phrases.words.tolist()]
        assert sorted(found) == sorted(windows)
        for word, size, before, after in zip(found, phrases.size, index.only_before(phrases), index.only_after(phrases)):
            sides = windows[word]
            assert size == len(sides)
            assert before == (sides[0][0] if len({s[0] for s in sides}) == 1 else 0)
            assert after == (sides[0][1] if len({s[1] for s in sides}) == 1 else 0)


def test_long_texts_are_cut_at_breaks_only(monkeypatch):
    monkeypatch.setattr(C, "SHARD_BYTES", 50)
    text = b"one two three, " * 20 + b"x" * 200 + b" y. end"
    parts = list(C._portions(text))
    assert b",".join(parts).replace(b".", b",") == text.replace(b".", b",")
    assert [len(p) for p in parts if len(p) > 50] == [len(b" " + b"x" * 200 + b" y")]
    assert list(C._portions(b"")) == [b""]
