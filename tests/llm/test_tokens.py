"""Token store and packing against the tokenizers library and plain versions."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scenequality.llm import token_store
from scenequality.llm.packing import OpenBins, pack, pack_documents, token_pieces
from scenequality.llm.queries import vocabulary
from scenequality.llm.tokens import WordEncoder

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
TEXTS = [(3, "the end, of it.\nAnd more"), (1, None), (2, ""), (5, "  odd\t spaces \n\n"), (4, "naïve ΣΑΣ İx <|endoftext|>"),
         (None, "no id"), (6, "word " * 9000), (6, "word " * 9000)]


def documents(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, ids int")


@pytest.mark.parametrize("path, spaced", [(BYTES, True), (WORDS, False)])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text("ab E.,!'s\n\t éÀΣςİ½_-한　​🙂1", max_size=40), max_size=6))
def test_words_give_the_ids_of_whole_texts(path, spaced, texts):
    encoder = WordEncoder(path, spaced, words=20)
    assert encoder.encode(texts) == encoder.whole(texts)


@pytest.mark.parametrize("path, spaced", [(BYTES, True), (WORDS, False)])
def test_new_words_of_letters_need_no_regular_expressions(path, spaced):
    encoder, slow = WordEncoder(path, spaced), []
    apart, whole = encoder.apart, encoder.whole
    encoder.apart = lambda words, before="": slow.extend(words) or apart(words, before)
    encoder.whole = lambda texts: slow.extend(texts) or whole(texts)
    words = [a + b + c + "zqéíàß"[k % 6] for k, a in enumerate(["ka", "lö", "mi", "Nu"] * 6) for b in "aeiou" for c in "xyzw"]
    text = " ".join(w + [",", ".", "!?", ""][k % 4] for k, w in enumerate(words))
    assert encoder.encode([text, text, ""]) == [*whole([text]) * 2, b""]
    assert len(slow) < 10


def test_letters_that_come_apart_in_normal_form():
    for path, spaced in [(BYTES, True), (WORDS, False)]:
        encoder = WordEncoder(path, spaced)
        texts = [f"x{c}! {c}, a{c}b." for c in "\u0958\u09df\ufb2a\ufb4e\u212b\u01c5"]
        assert encoder.encode(texts) == encoder.whole(texts)


def test_remembered_words_and_endings_are_bounded():
    encoder = WordEncoder(BYTES, True, words=20)
    for k in range(20):
        texts = [" ".join(f"w{chr(97 + k)}{chr(97 + j)}" + "!?.,;"[j % 5] * (k + 1) + f" q{chr(97 + j)}" for j in range(15))] * 2
        assert encoder.encode(texts) == encoder.whole(texts)
    assert len(encoder._known) <= 60 and len(encoder._ends) <= 60


def test_store_round_trip(spark):
    docs = documents(spark)
    store = token_store.write_tokens(docs, BYTES, 2, dictionary_size=1024)
    found = token_store.read_tokens(spark, store).orderBy("start").collect()
    ordered = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))
    whole = [e + (2).to_bytes(4, "little") for e in WordEncoder(BYTES, True).whole([t or "" for _, t in ordered])]
    assert [r.doc_id for r in found] == [i for i, _ in ordered]
    assert [bytes(r.ids) for r in found] == whole
    assert [r.n_tokens for r in found] == [len(x) // 4 for x in whole]
    assert [r.start for r in found] == list(np.cumsum([0] + [len(x) // 4 for x in whole])[:-1])
    assert [r.ids_crc32 for r in found] == [zlib.crc32(x) for x in whole]


def test_single_document_access(spark):
    store = token_store.write_tokens(documents(spark), BYTES, 2)
    files, path = token_store.place(store.dictionary)
    with files.open_input_stream(path) as source:
        dictionary = source.read()
    got = [token_store.read_document(r.file, dictionary, 3) for r in store.manifest.collect()]
    assert [x for x in got if x is not None] == [np.frombuffer(WordEncoder(BYTES, True).whole([TEXTS[0][1]])[0], "<u4").tolist() + [2]]
    assert all(token_store.read_document(r.file, dictionary, 99) is None for r in store.manifest.collect())


def test_store_of_an_empty_table(spark):
    store = token_store.write_tokens(documents(spark, []), BYTES, 2)
    assert token_store.read_tokens(spark, store).count() == 0


def best_fit(lengths, capacity, limit):
    """Plain best fit over a list of open bins."""
    bins, made, out = [], 0, []
    for n in lengths:
        fitting = [b for b in bins if b[1] >= n]
        if fitting:
            least = min(b[1] for b in fitting)
            chosen = [b for b in fitting if b[1] == least][-1]
            bins.remove(chosen)
        else:
            chosen = [made, capacity]
            made += 1
        out.append((chosen[0], capacity - chosen[1]))
        left = chosen[1] - n
        if left:
            if len(bins) == limit:
                least = min(b[1] for b in bins)
                if least <= left:
                    bins.remove([b for b in bins if b[1] == least][-1])
                    bins.append([chosen[0], left])
            else:
                bins.append([chosen[0], left])
    return out


@settings(max_examples=200, deadline=None)
@given(lengths=st.lists(st.integers(0, 20), max_size=60), limit=st.integers(1, 5))
def test_bins_match_plain_best_fit(lengths, limit):
    bins = OpenBins(20, limit)
    assert [bins.place(n) for n in lengths] == best_fit(lengths, 20, limit)


def check_layout(rows, capacity):
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by_bin.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_bin)


def test_documents_are_cut_and_packed(spark):
    rows = pack_documents(documents(spark), WORDS, 1).collect()
    ids = [x + (1).to_bytes(4, "little") for x in WordEncoder(WORDS, False).whole([t or "" for _, t in TEXTS])]
    want = sorted(
        (str(i), k // 4096, k, len(x[4 * k : 4 * k + 16384]) // 4, zlib.crc32(x[4 * k : 4 * k + 16384]))
        for (i, _), x in zip(TEXTS, ids, strict=True) for k in range(0, len(x) // 4, 4096)
    )
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_layout(rows, 4096)


def test_packing_is_tight_and_ignores_clashing_columns(spark):
    pieces = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "pmod(xxhash64(id), 1500) + 1 AS length", "'x' AS offset")
    rows = pack(pieces).collect()
    total = sum(r.length for r in rows)
    assert check_layout(rows, 4096) <= 1.03 * total / 4096 + 1
    assert pack(pieces.limit(0)).count() == 0
    assert token_pieces(documents(spark, []), WORDS, 1).count() == 0


def test_ids_that_do_not_fit_stop_the_store():
    from scenequality.llm.token_store import _pack

    wide = np.array([1, 65_535], "<u4").tobytes()
    assert _pack(wide, 2) == np.array([1, 65_535], "<u2").tobytes() and _pack(b"", 2) == b""
    with pytest.raises(ValueError, match="width=4"):
        _pack(np.array([1, 70_000], "<u4").tobytes(), 2)
