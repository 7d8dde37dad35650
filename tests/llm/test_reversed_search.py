"""Reversed search against scoring every pair in plain Python."""

import math
import re
from collections import Counter

import numpy as np

from scenequality.llm.reversed_search import Heaps, search, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, n long, terms string, item_id string"
ITEMS = "item_id long, text string, score string"


def plain_terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, top=10):
    bags = [(d, Counter(w), len(w)) for d, t in docs if (w := plain_terms(t))]
    n, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    queries = {}
    for item, text in set(items):
        queries.setdefault(item, Counter()).update(plain_terms(text))
    out = []
    for item, query in queries.items():
        found = []
        for doc, counts, size in bags:
            m = 25 + 75 * size * n // total
            score = sum(
                k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
                for t, k in query.items() if t in counts
            )
            if score > 0:
                found.append((score, doc))
        found.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out += [(item, rank, doc, score) for rank, (score, doc) in enumerate(found[:top], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def words(rng, n, size=60):
    return " ".join(f"w{int(k)}" for k in np.minimum(rng.zipf(1.3, n), size))


def corpus():
    rng = np.random.default_rng(7)
    docs = [(i, words(rng, int(rng.integers(1, 80)))) for i in range(400)]
    docs += [(1000 + i, "w3 w5 the same copy w7") for i in range(150)]  # ties
    docs += [(5, "W3, w5; w5_w7 repeated id"), (None, "w3 w5 w7"), (None, "w3 w5 w7"), (2000, None), (2001, ""), (2002, "... !?")]
    docs += [(2003, "Älter İstanbul \U0001f600 w1-w2\x00w9"), (2004, "w4 " * 60_000)]
    items = [(i, words(rng, int(rng.integers(1, 30)))) for i in range(40)]
    items += [(40, None), (41, ""), (42, "nowhere at all"), (43, "w5 W5 w7"), (43, "w5 W5 w7"), (44, "w1"), (44, "w2 älter"), (None, "w3 w5")]
    return docs, items


def tables(spark, docs, items, parts=6):
    return (
        spark.createDataFrame([(d, t, 1, "x", "y") for d, t in docs], DOCS).repartition(parts),
        spark.createDataFrame([(i, t, "z") for i, t in items], ITEMS),
    )


def test_terms():
    for text in ("A-b c_D9 é—x\x7fy\x80", "", "Straße 12,5 İi", "a\tb\nc\x0b\x1cd"):
        assert [t.decode() for t in terms(text.encode())] == plain_terms(text)


def test_every_case_against_all_pairs(spark):
    docs, items = corpus()
    found = search(*tables(spark, docs, items))
    assert got(found) == plain(docs, items)


def test_blocks_of_items_change_nothing(spark):
    docs, items = corpus()
    assert got(search(*tables(spark, docs, items), block_postings=60)) == plain(docs, items)
    assert got(search(*tables(spark, docs, items), top=3)) == plain(docs, items, 3)


def test_empty_tables(spark):
    docs, items = corpus()
    assert got(search(*tables(spark, [], items))) == []
    assert got(search(*tables(spark, docs, []))) == []
    assert got(search(*tables(spark, [(1, None), (2, "--")], items))) == []


def test_heaps_hold_the_best_whatever_the_order():
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 4, (500, 3))
    ids = rng.permutation(500)
    numbered = ids % 7 > 0
    heaps = Heaps(3, 10)
    for a in range(0, 500, 37):
        heaps.offer(scores[a : a + 37], ids[a : a + 37], numbered[a : a + 37])
    for item in range(3):
        want = sorted((-int(s), not k, int(i)) for s, i, k in zip(scores[:, item], ids, numbered) if s > 0)[:10]
        mine = sorted((-s, not k, -i) for s, k, i in heaps.kept[item])
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        assert [m for m in mine if not m[1]] == [w for w in want if not w[1]]
