"""Exact duplicates against grouping in plain Python."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from scenequality.llm.exact_dup import classes_of, mark_copies, sha256

SCHEMA = "doc_id long, text string, keep_id string, digest string, salt int"


def plain(rows, normalise=lambda t: t):
    """(doc_id, keep_id, group_size, kept, hex) with one kept row per class."""
    groups = defaultdict(list)
    for doc, text in rows:
        groups[normalise(text or "")].append(doc)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known, default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        turns = Counter()
        for i in ids:
            turns[i] += 1
            out.append((i, keep, len(ids), i == keep and turns[i] == 1, sha))
    return sorted(out, key=repr)


def table(spark, rows, parts=5):
    """Rows with further columns whose names are used inside."""
    full = [(d, t, "x", "y", 3) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


ROWS = (
    [(i, "one text that many rows share") for i in range(300)]
    + [(1000 + i, f"text {i % 40}") for i in range(90)]
    + [(2000, None), (2001, ""), (None, ""), (None, "only without an id"), (None, "only without an id"), (None, "text 3")]
    + [(3000, "repeated row")] * 7
    + [(3001, "repeated row"), (3001, "repeated row")]
    + [(4000, "Ünïcode İ \U0001f600 " * 3), (4001, "ünïcode"), (4002, " spaced"), (4003, "spaced"), (4004, "w " * 200_000), (4005, "w " * 200_000)]
)


def test_every_case_against_plain_grouping(spark):
    assert got(mark_copies(table(spark, ROWS))) == plain(ROWS)


def test_weak_digests_are_told_apart_by_the_text(spark):
    weak = lambda text: F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 2))
    assert got(mark_copies(table(spark, ROWS), digest=weak)) == plain(ROWS)
    same = lambda text: F.unhex(F.lit("00"))
    assert got(mark_copies(table(spark, ROWS), digest=same)) == plain(ROWS)


def test_normalised_texts(spark):
    found = mark_copies(table(spark, ROWS), normalise=lambda text: F.regexp_replace(text, "[0-9]", "#"))
    digits = str.maketrans("0123456789", "#" * 10)
    assert got(found) == plain(ROWS, lambda t: t.translate(digits))


def test_empty_table(spark):
    assert got(mark_copies(table(spark, []))) == []


def test_a_task_sends_one_row_per_text(spark):
    docs = table(spark, [(i, "shared") for i in range(900)], parts=3).select("doc_id", "text", sha256(F.col("text")).alias("digest"))
    plan = classes_of(docs)._jdf.queryExecution().executedPlan().toString()
    # the salt is the task's own number, so the partial aggregate before the first exchange merges all copies of a task
    assert plan.count("Exchange") >= 2 and "partial_max" in plan
    assert classes_of(docs).collect()[0].group_size == 900


def test_classes_larger_than_the_hot_share(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(9000)]
    assert got(mark_copies(table(spark, rows))) == plain(rows)
