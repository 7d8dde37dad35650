"""Language spans against a plain Viterbi pass, held-out accuracy, and odd input."""

import numpy as np
import pytest

from scenequality.llm import language
from scenequality.llm.common import table
from scenequality.llm.queries import op5_language

DATA = "/root/testdata/sf0.01"


def plain_viterbi(scores, switch):
    value, back = scores[0].astype(float), []
    for row in scores[1:]:
        best = value.argmax()
        stay = value >= value[best] - switch
        back.append(np.where(stay, np.arange(len(value)), best))
        value = np.where(stay, value, value[best] - switch) + row
    at, total = value.argmax(), value.max()
    path = [at]
    for b in back[::-1]:
        path.append(b[path[-1]])
    return path[::-1], total


def path_score(scores, path, switch):
    return scores[np.arange(len(path)), path].sum() - switch * (np.diff(path) != 0).sum()


@pytest.mark.parametrize("seed", range(8))
def test_blocks_give_the_best_path(seed):
    random = np.random.default_rng(seed)
    sizes = random.integers(1, 400, 12)
    text = np.repeat(np.arange(12), sizes)
    scores = random.integers(-12, 1, (len(text), 3)).astype(np.float32)
    labels = language.viterbi(scores, text, 8.0)
    for k in range(12):
        mine = text == k
        assert path_score(scores[mine], labels[mine], 8.0) == plain_viterbi(scores[mine], 8.0)[1]


def test_held_out_accuracy(spark):
    found = op5_language(spark, DATA).join(table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").selectExpr("avg(CAST(lang = lang_pred AS INT)) AS share", "count(*) AS n").first()
    assert held.n > 200 and held.share > 0.98
    assert found.where("held_out <> (crc32(CAST(doc_id AS STRING)) % 4 = 2)").count() == 0


ENGLISH, RUSSIAN = "the cat and the dog that was there with them", "кошка и собака были там вместе с ними"


def model_of(spark):
    rows = [(k, f"{ENGLISH} {k}", "en") for k in range(30)] + [(k + 50, f"{RUSSIAN} {k}", "ru") for k in range(30)]
    return language.learn(spark.createDataFrame([*rows, (99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string"))


def test_scripts_narrow_and_spans_switch(spark):
    mixed = f"{ENGLISH}. {RUSSIAN}! {ENGLISH}"
    rows = [(1, mixed, "a"), (2, "12 34 !?", "b"), (3, None, "c"), (4, "", "d"), (5, "日本語", "e"), (6, "ά́", "f"),
            (7, (ENGLISH + " ") * 20_000, "g"), (1, mixed, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = [r for r in language.label_spans(docs, model_of(spark)).collect()]
    one = [r for r in found if r.doc_id == 1]
    assert len(one) == 2 and one[0] == one[1]
    cut = [mixed[s.start : s.end] for s in one[0].spans]
    assert [s.lang for s in one[0].spans] == ["en", "ru", "en"] and cut == [ENGLISH, RUSSIAN, ENGLISH]
    assert one[0].lang_pred == "en" and 0.5 < one[0].score < 1
    rest = {r.doc_id: r for r in found}
    assert [(rest[k].lang_pred, rest[k].score, rest[k].spans) for k in (2, 3, 4)] == [("und", 0.0, [])] * 3
    assert rest[5].lang_pred in ("en", "ru") and rest[7].lang_pred == "en" and rest[7].score == 1.0


def test_every_language_is_learned(spark):
    rows = [(k, f"{chr(97 + k // 10) * 3}{chr(107 + k % 10) * 3} " * 5, f"l{k:02}") for k in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert model.languages == tuple(sorted(r[2] for r in rows))
    assert language.label_spans(docs, model).where("lang <> lang_pred").count() == 0
    with pytest.raises(ValueError, match="more than 69"):
        language.learn(docs, languages=69)


def test_empty_model_and_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "words here")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in language.identify(docs, none).collect()] == [("und", 0.0)]
    assert language.label_spans(docs.limit(0), model_of(spark)).count() == 0
