"""Language identification of mixed texts: script ranges narrow the candidates, hashed letter groups score every
word, and a Viterbi pass with a switching penalty labels spans."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequality.llm.common import hash_sample, slices, strings

UNDETERMINED = "und"
GROUPS = 1 << 16  # hash values of letter groups
SWITCH = 12.0  # what a change of language costs, in nats
SMOOTHING = 0.1
SCRIPT_SHARE = 0.01  # of a language's words, for a script to be one of its own
BLOCK = 64  # words of one Viterbi block
LANGUAGES = 256  # about 1 MB of counts for each in every task; more raise an error
SLICE = 1 << 20  # characters labelled at once with up to 64 languages, fewer with more

#: First code points of script ranges, in order; a range ends where the next begins. Fixed values of Unicode.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1D00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"),
    (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"), (0xA720, "Latin"),
    (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Other"),
    (0x20000, "Han"), (0x30000, "Other"),
)


@dataclass(frozen=True)
class Model:
    """Learned languages in order, log chances per letter group (groups x languages), scripts per language."""

    languages: tuple[str, ...]
    groups: np.ndarray
    scripts: np.ndarray


@functools.lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its lower case, or 0 if it is no letter; and whether it is a letter proper (a mark
    belongs to its word but makes no word of a text without letters)."""
    fold, proper = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            fold[c], proper[c] = ord(low) if len(low) == 1 else c, True
        elif c > 0x2FF and unicodedata.category(ch)[0] == "M":
            fold[c] = c
    return fold, proper


@functools.lru_cache(maxsize=1)
def _script_table() -> tuple[np.ndarray, np.ndarray, int]:
    names = sorted({name for _, name in SCRIPTS})
    return np.array([c for c, _ in SCRIPTS]), np.array([names.index(name) for _, name in SCRIPTS]), len(names)


@dataclass
class Words:
    """The words of some texts: their text, place, letters and script, and the hash values of their letter groups
    (``first`` is where each word's groups begin)."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    first: np.ndarray
    two: np.ndarray
    three: np.ndarray
    lettered: np.ndarray


def find_words(texts: list[str]) -> Words:
    fold, proper = _characters()
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if texts else np.zeros(0, np.int64)
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = fold[codes]
    letter = c > 0
    before = np.concatenate([[False], letter[:-1]])
    start, end = np.flatnonzero(letter & ~before), np.flatnonzero(before & ~letter)
    used = letter | before  # a word's letters and the place behind it
    c1 = np.concatenate([np.zeros(1, np.uint32), c[:-1]])
    c2 = np.where(c1 > 0, np.concatenate([np.zeros(2, np.uint32), c[:-2]])[: len(c)], 0).astype(np.uint32)
    at = np.flatnonzero(used)
    a, b, d = c[at], c1[at], c2[at]
    two = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)) >> np.uint32(16)
    three = (a * np.uint32(0xC2B2AE35) + b * np.uint32(0x27D4EB2F) + d * np.uint32(0x165667B1) + np.uint32(0x51ED27)) >> np.uint32(16)
    bounds, kinds, _ = _script_table()
    text = np.searchsorted(begins, start, "right") - 1
    lettered = np.zeros(len(texts), bool)
    lettered[np.searchsorted(begins, np.flatnonzero(proper[codes]), "right") - 1] = True
    return Words(
        text, start - begins[text], end - begins[text], kinds[np.searchsorted(bounds, codes[start], "right") - 1],
        np.searchsorted(at, start), two, three, lettered,
    )


# ---------------------------------------------------------------- learning


def learn(labelled: DataFrame, documents: int = 1000, languages: int = LANGUAGES) -> Model:
    """Fit on the whole texts of at most ``documents`` rows (doc_id, text, lang) of each language, those of the
    smallest id hash. That bound is a parameter of the fit only; prediction covers every row. Every lang value is
    learned; more than ``languages`` of them, which memory would not hold, are an error. Rows with null text or lang
    are left out; without rows the model is empty.
    """
    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(languages + 1).collect()}
    if len(counts) > languages:
        raise ValueError(f"more than {languages} values of lang to learn")
    names = tuple(sorted(counts))
    # one short top list of each language: no window gathers a language's rows
    chosen = [
        i for name in names for i in hash_sample(known.where(F.col("lang") == name).select("doc_id"), counts[name], documents)
    ]
    sample = known.where(F.col("doc_id").isin(chosen)).select("text", "lang")
    place = {name: k for k, name in enumerate(names)}
    n_scripts = _script_table()[2]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(names), 2 * GROUPS + n_scripts), np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                langs = [place.get(x, -1) for x in part.column("lang").to_pylist()]
                texts = strings(part, "text")
                for k in set(langs) - {-1}:
                    words = find_words([t for t, x in zip(texts, langs, strict=True) if x == k])
                    n[k, :GROUPS] += np.bincount(words.two, minlength=GROUPS)
                    n[k, GROUPS : 2 * GROUPS] += np.bincount(words.three, minlength=GROUPS)
                    n[k, 2 * GROUPS :] += np.bincount(words.script, minlength=n_scripts)
        lang, cell = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"lang": lang, "cell": cell, "n": n[lang, cell]})

    totals = np.zeros((len(names), 2 * GROUPS + n_scripts))
    if names:
        cells = sample.mapInArrow(count, "lang long, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
        found = cells.toPandas()  # bounded by languages x groups
        totals[found["lang"].to_numpy(int), found["cell"].to_numpy(int)] = found["n"].to_numpy(float)

    def chances(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * GROUPS))

    groups = np.concatenate([chances(totals[:, :GROUPS]), chances(totals[:, GROUPS : 2 * GROUPS])], axis=1)
    scripts = totals[:, 2 * GROUPS :]
    own = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(1, keepdims=True))
    return Model(names, np.ascontiguousarray(groups.T.astype(np.float32)), own.T.copy())


# ---------------------------------------------------------------- labelling


def word_scores(words: Words, model: Model) -> np.ndarray:
    """Score of each word in each language. Languages that don't use the word's script are out; a script that no
    language uses says nothing."""
    n = len(model.languages)
    if not len(words.start):
        return np.zeros((0, n), np.float32)
    each = model.groups[words.two] + model.groups[words.three + GROUPS]
    scores = np.add.reduceat(each, words.first, axis=0)
    possible = model.scripts[words.script]
    anything = possible.any(1)
    return np.where(possible, scores, np.where(anything[:, None], np.float32(-1e4), np.float32(0)))


def viterbi(scores: np.ndarray, text: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word, for all texts at once.

    ``text`` (ascending) says whose word it is. A text's words are cut into blocks; every block gives a matrix of
    the best score from each language before it to each language at its end; the matrices are combined along
    each text; then all blocks are traced back side by side from their known ends.
    """
    n, languages = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    sizes = np.diff(np.concatenate([heads, [n]]))
    blocks = -(-sizes // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    owner = np.repeat(np.arange(len(heads)), sizes)
    inside = np.arange(n) - heads[owner]
    row, column = first[owner] + inside // BLOCK, inside % BLOCK
    padded = np.zeros((BLOCK, int(blocks.sum()), languages), np.float32)
    padded[column, row] = scores
    # scores are taken relative to the word's best, which keeps long texts exact enough in single precision
    padded -= padded.max(2, keepdims=True)
    free = np.where(np.eye(languages, dtype=bool), 0, -switch).astype(np.float32)
    matrix = free[None] + padded[0][:, None, :]
    for step in range(1, BLOCK):
        matrix = np.maximum(matrix, matrix.max(2, keepdims=True) - np.float32(switch)) + padded[step][:, None, :]
    # along each text, longest first, so that those still going are always a prefix
    order = np.argsort(-blocks, kind="stable")
    reach = np.zeros((len(heads), languages))
    came = np.zeros((len(matrix), languages), np.int64)
    for k in range(int(blocks.max())):
        going = order[: np.searchsorted(-blocks[order], -k, "left")]
        total = reach[going][:, :, None] + matrix[first[going] + k]
        came[first[going] + k] = total.argmax(1)
        reach[going] = total.max(1)
    ends = np.zeros(len(matrix), np.int64)
    state = reach.argmax(1)
    for k in range(int(blocks.max()) - 1, -1, -1):
        going = order[: np.searchsorted(-blocks[order], -k, "left")]
        ends[first[going] + k] = state[going]
        state[going] = came[first[going] + k, state[going]]
    starts = came[np.arange(len(matrix)), ends]
    # inside all blocks at once
    every = np.arange(len(matrix))
    value = free[starts] + padded[0]
    stay = np.zeros((BLOCK, len(matrix), languages), bool)
    best = np.zeros((BLOCK, len(matrix)), np.int64)
    for step in range(1, BLOCK):
        best[step] = value.argmax(1)
        top = value[every, best[step]][:, None] - np.float32(switch)
        stay[step] = value >= top
        value = np.maximum(value, top) + padded[step]
    labels = np.zeros((BLOCK, len(matrix)), np.int64)
    now = ends
    for step in range(BLOCK - 1, -1, -1):
        labels[step] = now
        if step:
            now = np.where(stay[step, every, now], now, best[step])
    return labels[column, row]


_LABELLED = "spans array<struct<start:int,end:int,lang:string>>, lang_pred string, score double"


def label_spans(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """``docs`` with spans (start and end in code points, language), lang_pred and score; needs a column text.

    lang_pred is the language of most letters (ties: the first by name), score its share of them. Null texts,
    texts without a letter and every text under an empty model are ``und`` with score 0 and no spans. Columns of
    the same names are replaced; all others pass through.
    """
    docs = docs.drop("spans", "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages x groups
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        size = SLICE * 64 // max(64, len(model.languages))
        for batch in batches:
            for part in slices(batch, "text", size):
                columns = _labels(strings(part, "text"), model, switch)
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*names, "spans", "lang_pred", "score"])

    return docs.mapInArrow(label, f"{schema}, {_LABELLED}")


def _labels(texts: list[str], model: Model, switch: float) -> list[pa.Array]:
    n, languages = len(texts), len(model.languages)
    words = find_words(texts) if languages else None
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
    if words is None or not len(words.start):
        return [pa.array([[]] * n, pa.list_(span)), pa.array([UNDETERMINED] * n), pa.array([0.0] * n)]
    # a text with marks but no letter has no words
    real = words.lettered[words.text]
    labels = viterbi(word_scores(words, model), words.text, switch)
    letters = np.zeros((n, languages), np.int64)
    np.add.at(letters, (words.text[real], labels[real]), (words.end - words.start)[real])
    change = np.flatnonzero(
        np.concatenate([[True], (words.text[1:] != words.text[:-1]) | (labels[1:] != labels[:-1])])
    )
    last = np.concatenate([change[1:], [len(labels)]]) - 1
    keep = real[change]
    change, last = change[keep], last[keep]
    offsets = np.searchsorted(words.text[change], np.arange(n + 1))
    spans = pa.StructArray.from_arrays(
        [
            pa.array(words.start[change], pa.int32()),
            pa.array(words.end[last], pa.int32()),
            pa.array(np.array(model.languages, object)[labels[change]], pa.string()),
        ],
        fields=list(span),
    )
    total = letters.sum(1)
    top = letters.argmax(1)
    named = np.where(total > 0, np.array(model.languages, object)[top], UNDETERMINED)
    share = np.where(total > 0, letters[np.arange(n), top] / np.maximum(1, total), 0.0)
    return [
        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans),
        pa.array(named, pa.string()),
        pa.array(share, pa.float64()),
    ]


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document is kept from the learning: crc32 of its id as text leaves 2 after division by 4."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def learnable(labelled: DataFrame) -> DataFrame:
    """The rows of ``labelled`` with text and lang that aren't held out."""
    return labelled.where("text IS NOT NULL AND lang IS NOT NULL").where(~F.coalesce(held_out(), F.lit(False)))


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """``docs`` with spans, lang_pred and score, learned from the ``learnable`` rows of ``labelled``."""
    return label_spans(docs, learn(learnable(labelled)))
