"""Exact tokenisation with the tokenizers library, encoding each distinct word once.

Both public vocabularies cut a text before every single space or line break between visible characters, so
the ids of a text are the ids of its words in order. Texts with any other white space or with control
characters are encoded whole. Arrow cuts the texts of a call into words, numbers the distinct ones and puts their ids
together.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS_A_CALL = 64  # words that are encoded in one string

_ODD = re.compile(r"[\x00-\x09\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
_CHANGED = re.compile(  # the two letters whose lower case is longer or depends on their place; those that NFC ends in a mark
    "[\u0130\u03a3\u0958-\u095f\u09dc\u09dd\u09df\u0a33\u0a36\u0a59-\u0a5b\u0a5e\u0b5c\u0b5d\u0f43\u0f4d\u0f52\u0f57\u0f5c\u0f69"
    "\ufb1d\ufb1f\ufb2a-\ufb36\ufb38-\ufb3c\ufb3e\ufb40\ufb41\ufb43\ufb44\ufb46-\ufb4e]"
)
_EDGES = ("  ", "\n\n", " \n", "\n ")
_ENDED = r"^(?P<stem>\n?\pL+)(?P<end>[[:punct:]]+)$"
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")  # equal to their NFC form
_PROBE = ["the", "straße", "niño", *map(chr, range(0xDF, 0xF7)), *map(chr, range(0xF8, 0x100))]
#: Byte-level vocabularies write each byte as a letter: itself where visible, else one from 256 on.
_HIDDEN = {byte: 256 + k for k, byte in enumerate([*range(33), *range(127, 161), 173])}
_SPACE = chr(_HIDDEN.pop(32))


def _plain(text: str) -> bool:
    """Whether all white space is single spaces and line breaks between visible characters."""
    ends = text[:1] + text[-1:]
    return not (" " in ends or "\n" in ends or any(e in text for e in _EDGES) or _ODD.search(text))


def _listed(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes.

    ``spaced`` is true where a space belongs to the word after it (byte-level vocabularies) and false where
    white space and case are dropped. About ``words`` words are remembered; beyond that the half that came first
    stays, which holds the frequent ones. A word of letters with punctuation behind it is put together from both.
    """

    def __init__(self, path: str, spaced: bool, words: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self._letters = Tokenizer(self._tokenizer.model)  # the same merges without regular expressions
        self._letters.pre_tokenizer = WhitespaceSplit()
        self._spaced = spaced
        self._words = words
        self._mark = "\n" if spaced else "|"
        self._between = "\n" if spaced else " | "
        self._mark_ids = self.whole([self._mark])[0]
        self._mark_id = int.from_bytes(self._mark_ids, "little") if len(self._mark_ids) == 4 else None
        self._known: dict[str, bytes] = {}
        self._ends: dict[str, bytes] = {}
        vocabulary = self._letters.get_vocab()
        bound = _SPACE if spaced else getattr(self._letters.model, "end_of_word_suffix", None)
        has = str.startswith if spaced else str.endswith
        self._bound = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that open a word, or end one if not spaced
        self._bound[[i for token, i in vocabulary.items() if bound and has(token, bound)]] = True
        if self.simple(_PROBE) != self.apart(_PROBE, " " if spaced else ""):
            self._bound[:] = False  # not a vocabulary of this kind

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def apart(self, words: list[str], before: str = "") -> dict[str, bytes]:
        """Ids of each word by itself, ``before`` put in front. Many words share a string, with a mark between any two
        that is always a token of its own; words that hold the mark, and strings where it isn't found as often as it
        was put in, are encoded one by one."""
        free = [w for w in words if w and self._mark not in w] if self._mark_id is not None else []
        groups = [free[i : i + WORDS_A_CALL] for i in range(0, len(free), WORDS_A_CALL)]
        joint = [before + (self._between + before).join(g) for g in groups]
        found: dict[str, bytes] = {}
        for group, one in zip(groups, self._tokenizer.encode_batch_fast(joint, add_special_tokens=False), strict=True):
            ids = np.array(one.ids, "<u4")
            marks = 4 * np.flatnonzero(ids == self._mark_id)
            if len(marks) == len(group) - 1:
                raw, ends = ids.tobytes(), [*marks.tolist(), 4 * len(ids)]
                found.update(zip(group, map(raw.__getitem__, map(slice, [0, *(marks + 4).tolist()], ends)), strict=True))
        alone = [w for w in words if w not in found]
        found.update(zip(alone, self.whole([before + w for w in alone]), strict=True))
        return found

    def simple(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of Latin letters, a space in front of each if spaced and lower-cased if not. Neither rules for
        punctuation nor normalisation touch them, so the merges alone give their ids; where not as many words begin
        (or end) in the ids as were put in, they are left out."""
        simple, others = [], []
        for word in words:
            (simple if word.isascii() else others).append(word)
        groups = [w[i : i + WORDS_A_CALL] for w in (simple, others) for i in range(0, len(w), WORDS_A_CALL)]
        joint = [" ".join(g).encode().decode("latin-1") for g in groups]
        if others:
            plain = -(-len(simple) // WORDS_A_CALL)
            joint[plain:] = [x.translate(_HIDDEN) for x in joint[plain:]]
        if self._spaced:
            joint = [_SPACE + x.replace(" ", " " + _SPACE) for x in joint]
        found: dict[str, bytes] = {}
        for group, one in zip(groups, self._letters.encode_batch_fast(joint, add_special_tokens=False), strict=True):
            ids = np.array(one.ids, "<u4")
            at = np.flatnonzero(self._bound[ids])
            if len(at) == len(group):
                at = (4 * at).tolist() if self._spaced else (4 * at + 4).tolist()
                cuts = [*at, 4 * len(ids)] if self._spaced else [0, *at]
                raw = ids.tobytes()
                found.update(zip(group, map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=True))
        return found

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of words that aren't known, which from now on they are."""
        if self._spaced:
            opening = [w[1:] for w in new if w[:1] == "\n"]
            found = self._fresh([w for w in new if w[:1] != "\n"])
            found.update([("\n" + w, self._mark_ids + ids) for w, ids in self.apart(opening).items()])
        else:
            found = self._fresh(new)
        known = self._known
        if len(known) + len(found) > self._words:
            kept = dict(itertools.islice(known.items(), self._words // 2))
            known.clear()
            known.update(kept)
        known.update(found)
        return found

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        found = self.simple([w for w in words if (w.isascii() and w.isalpha()) or _LETTERS.fullmatch(w)])
        found.update(self.apart([w for w in words if w not in found], " " if self._spaced else ""))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; each distinct word of the call is looked up once, and learned if it is new."""
        odd = {i: t for i, t in enumerate(texts) if t and not (_plain(t) and (self._spaced or not _CHANGED.search(t)))}
        out = [b""] * len(texts)
        for i, ids in zip(odd, self.whole(list(odd.values())), strict=True):
            out[i] = ids
        plain = [i for i, t in enumerate(texts) if t and i not in odd]
        if plain:
            cut = pc.split_pattern(pa.array([self._spelt(texts[i]) for i in plain], pa.large_string()), " ")
            words = cut.flatten().dictionary_encode()
            joined = self._ids(words.dictionary).take(words.indices)
            _, bounds, data = joined.buffers()
            at = np.frombuffer(bounds, "<i8", len(joined) + 1)[cut.offsets.to_numpy()].tolist()
            skip = len(self._mark_ids) if self._spaced else 0
            raw = memoryview(data) if data is not None else b""
            for i, low, high in zip(plain, at, at[1:], strict=False):
                out[i] = bytes(raw[low + skip : high])
        return out

    def _spelt(self, text: str) -> str:
        """``text`` with its words between spaces; where a space belongs to the word after it, the first of a line has
        the line break in front, and that of the text too."""
        return "\n" + text.replace("\n", " \n") if self._spaced else text.lower().replace("\n", " ")

    def _ids(self, words: pa.Array) -> pa.Array:
        """Ids of each word; one of letters with punctuation behind it is put together from both."""
        parts = pc.extract_regex(words, _ENDED)
        stems = pc.coalesce(pc.struct_field(parts, "stem"), words).dictionary_encode()
        ends = pc.coalesce(pc.struct_field(parts, "end"), pa.scalar("", words.type)).dictionary_encode()
        tails = _listed(ends.dictionary)
        if len(self._ends) > self._words:
            self._ends.clear()
        new = [w for w in tails if w not in self._ends]
        self._ends.update(zip(new, self.whole(new), strict=True))
        spelt = _listed(stems.dictionary)
        found = list(map(self._known.get, spelt))
        new = [w for w, ids in zip(spelt, found, strict=True) if ids is None]
        if new:
            learned = self._learn(new)
            found = [learned[w] if ids is None else ids for w, ids in zip(spelt, found, strict=True)]
        stem_ids = pa.array(found, pa.large_binary()).take(stems.indices)
        end_ids = pa.array([self._ends[w] for w in tails], pa.large_binary()).take(ends.indices)
        return pc.binary_join_element_wise(stem_ids, end_ids, pa.scalar(b"", pa.large_binary()))


@functools.lru_cache(maxsize=4)
def word_encoder(path: str, spaced: bool) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path, spaced)


def with_end(ids: Iterable[bytes], end: int) -> list[bytes]:
    mark = int(end).to_bytes(4, "little")
    return [x + mark for x in ids]
