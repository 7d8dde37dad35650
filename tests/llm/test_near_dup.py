"""Near-duplicate classes against brute force, weighted signatures, components, and the pipeline as a whole."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from scenequality.llm import near_dup
from scenequality.llm.common import table
from scenequality.llm.near_dup import near_duplicates, shingles
from scenequality.llm.queries import vocabulary
from scenequality.llm.tokens import WordEncoder

DATA = "/root/testdata/sf0.01"


def brute_classes(rows, least=0.8):
    """doc_id -> smallest doc_id of its class, by comparing shingle sets as Python strings."""
    import re

    sets = []
    for _, text in rows:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        runs = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else {("raw", text or "")}
        sets.append(runs)
    where, root = {}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, runs in enumerate(sets):
        shared = {}
        for run in runs:
            for j in where.get(run, ()):
                shared[j] = shared.get(j, 0) + 1
            where.setdefault(run, []).append(i)
        for j, n in shared.items():
            if n / (len(runs) + len(sets[j]) - n) >= least:
                root[find(i)] = find(j)
    least_id = {}
    for i, (doc, _) in enumerate(rows):
        least_id[find(i)] = min(doc, least_id.get(find(i), doc))
    return {doc: least_id[find(i)] for i, (doc, _) in enumerate(rows)}


def test_classes_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]
    found = {r.doc_id: r.class_id for r in near_duplicates(table(spark, DATA, "documents")).collect()}
    assert found == brute_classes(rows)


@pytest.mark.parametrize("block_rows", [4, 256])
def test_large_groups_in_small_blocks(spark, block_rows):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(5000)]
    base = list(rng.choice(words, 200))
    rows = []
    for k in range(40):  # near copies, a chain of ever more changes, and texts that share a passage only
        copy = list(base)
        copy[int(rng.integers(200))] = f"c{k}"
        rows.append((k, " ".join(copy)))
    chain = list(rng.choice(words, 200))
    for k in range(25):
        chain = [*chain[:-2], f"d{k}", f"e{k}"] if k % 2 else [f"f{k}", *chain[1:]]
        rows.append((100 + k, " ".join(chain)))
    for k in range(20):
        rows.append((200 + k, " ".join([*base[:100], *rng.choice(words, 150)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_duplicates(docs, block_rows=block_rows).collect()}
    assert found == brute_classes(rows)


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (3, "one two"), (2, "One, two!"), (1, "one two three"), (1, "one two three"), (None, "one two three"),
            (None, "alone"), (7, "!!"), (6, "!!"), (8, "?"), (9, "x " * 30_000), (10, "x " * 30_001)]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, node string, class_id int")
    found = sorted(((r.doc_id, r.class_id) for r in near_duplicates(docs).collect()), key=repr)
    want = [(5, 4), (4, 4), (3, 2), (2, 2), (1, 1), (1, 1), (None, 1), (None, None), (7, 6), (6, 6), (8, 8), (9, 9), (10, 9)]
    assert found == sorted(want, key=repr)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_shingles_ignore_neighbouring_texts():
    alone = [shingles([t])[0] for t in ("a b c d e f", "", "x", "Ä b")]
    together = shingles(["a b c d e f", "", "x", "Ä b"])
    assert all((a == b).all() for a, b in zip(alone, together, strict=True))
    assert [len(x) for x in alone] == [2, 0, 1, 1] and (alone[3] == shingles(["ä, B"])[0]).all()


@pytest.mark.parametrize("scale", [0.25, 1.0, 6.0])
def test_signatures_estimate_weighted_similarity(scale):
    rng = np.random.default_rng(4)
    x = near_dup.mix(np.arange(1, 121, dtype=np.uint64))
    a, b = scale * rng.uniform(0, 2, 120), scale * rng.uniform(0, 2, 120)
    b[:60] = a[:60]
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    size = 2048
    one, other = near_dup.signature(x, a, size), near_dup.signature(x, b, size)
    assert abs((one == other).mean() - exact) < 4 * np.sqrt(exact * (1 - exact) / size)
    assert (near_dup.signature(x[::-1], a[::-1], size) == one).all()


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(300, 301)]
    order = rng.permutation(400)
    named = [(int(order[a]).to_bytes(2, "big"), int(order[b]).to_bytes(2, "big")) for a, b in edges]
    rows = [(bytearray(a), bytearray(b)) for a, b in named]
    found = {bytes(r.node): bytes(r.label) for r in near_dup.components(spark.createDataFrame(rows, "a binary, b binary")).collect()}
    groups = [set(range(61)), {100 + k for k in range(50)}, {300, 301}]
    want = {}
    for g in groups:
        names = [int(order[k]).to_bytes(2, "big") for k in g]
        want |= {n: min(names) for n in names}
    assert found == want


# ---------------------------------------------------------------- pipeline


def test_pipeline_against_brute_force(spark):
    """Every stage's effect, recomputed plainly from the stage before."""
    from test_filters import plain_spans

    docs = table(spark, DATA, "documents")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, DATA))
        steps[name] = docs.collect()
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    before = {r.doc_id: r for r in table(spark, DATA, "documents").collect()}
    named = {r.doc_id: r for r in steps["language"]}
    assert set(named) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
    assert sum(named[i].lang == before[i].lang for i in named) > 0.98 * len(named)
    classes = brute_classes([(r.doc_id, r.text) for r in steps["language"]])
    kept = {r.doc_id: r for r in steps["near_dedup"]}
    assert set(kept) == {i for i, c in classes.items() if i == c} and len(kept) == len(steps["near_dedup"])
    clean = {r.doc_id: r for r in steps["personal_data"]}
    assert set(clean) == set(kept)
    for i, r in clean.items():
        assert r.n_chars == len(r.text)
        assert not plain_spans(r.text) and (r.text == kept[i].text) <= (not plain_spans(kept[i].text))
    ids = WordEncoder(vocabulary("word_bpe_49k.json"), False)
    want = set()
    for i, r in clean.items():
        x = ids.whole([r.text])[0] + (1).to_bytes(4, "little")
        want |= {(i, k // 16384, zlib.crc32(x[k : k + 16384])) for k in range(0, len(x), 16384)}
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in steps["packing"]} == want


def test_pipeline_of_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the and of mail a@b.cd", "en", "s", 22),
            (3, "the and of mail a@b.cd", "en", "s", 22), (None, "la de que los", "es", "s", 13), (4, "12 34", "en", "s", 5)]
    docs = spark.createDataFrame([(*r, "extra", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, spans string, key int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in out}, key=repr) == [3, None]
    spark.createDataFrame([], docs.schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


PIPELINE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_keeps_one_row_per_class(spark):
    base = " ".join(f"w{k}" for k in range(100))
    other = " ".join(f"x{k}" for k in range(100))
    lone = " ".join(f"y{k}" for k in range(100))
    rows = [(1, base), (None, base + " a"), (None, base + " b"), (None, lone), (None, lone + " a"), (None, lone),
            (7, other), (7, base + " c"), (8, other + " a"), (None, "short")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], PIPELINE_SCHEMA)
    found = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(found, key=repr)[:2] == [(1, base), (7, other)] and len(found) == 4
    assert (None, "short") in found and sum(t in (lone, lone + " a") for _, t in found) == 1


def test_pipeline_keeps_mixed_and_unlearnable_documents(spark):
    en, es, fr = "the and with from", "pero ella nosotros", "avec vous jamais"
    rows = [(k, text, lang) for n, (text, lang) in enumerate([(en, "en"), (es, "es"), (fr, "fr")]) for k in range(20 * n, 20 * n + 20)]
    mixed = " ".join([(en + " ") * 12, (es + " ") * 11, (fr + " ") * 12])
    docs = spark.createDataFrame([(i, t, x, "s", len(t)) for i, t, x in [*rows, (99, mixed, None)]], PIPELINE_SCHEMA)
    held = docs.where(corpus_pipeline.F.crc32(corpus_pipeline.F.col("doc_id").cast("string")) % 4 == 2)
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()} == {i for i, _, _ in rows} | {99}
    assert corpus_pipeline.language(spark, held, "").count() == held.count() > 0
