"""Token ids of whole texts, as the tokenizers library gives them, with each distinct word encoded once in a task.

A text is cut at ASCII white space, which the vocabulary's own pre-tokenizer drops. Words are looked up a batch at a time
in a hash table of NumPy arrays, by 128 bits of their bytes' hashes; those that it lacks are encoded and added. A word that
has only printable ASCII and Latin-1 letters is lower-cased and cut by the pre-tokenizer's expression here, and the
library's BPE model encodes the parts; any other word goes through the library whole. So ids are the library's in every
case (but for two words of equal 128-bit hashes).
"""

from __future__ import annotations

import re
from contextlib import contextmanager
from itertools import chain

import numpy as np

from .shared import SPACED, release, split_words, utf8, word_hashes

_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: Cached words, at most; they bound memory and change no result.
CACHED = 500_000
#: Words that are looked up at once.
_AT_ONCE = 1 << 17


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level BPE writes bytes: printable ones stand for themselves, the others follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(own))}


_LETTERS = _byte_letters()


#: Marks that the pre-tokenizer always cuts off when they end a word, after a letter.
_MARK = np.isin(np.arange(256), list(b",.;:!?"))
_LETTER = (np.arange(256) | 32 >= 97) & (np.arange(256) | 32 <= 122)


def _marks_apart(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as split_words gives them, but a mark behind an ASCII or Latin-1 letter at the end is a word of its own."""
    if not len(begins):
        return begins, ends, firsts
    two, three = data[np.maximum(ends - 2, 0)], data[np.maximum(ends - 3, 0)]
    latin = (three == 0xC3) & (two >= 0x80) & (two != 0x97) & (two != 0xB7) & (ends - begins > 2)
    counts = 1 + (_MARK[data[ends - 1]] & (ends - begins > 1) & (_LETTER[two] | latin))
    after = np.cumsum(counts)
    b, e = np.repeat(begins, counts), np.repeat(ends, counts)
    marks = after[counts == 2] - 1
    b[marks] = e[marks - 1] = ends[counts == 2] - 1
    return b, e, np.concatenate([[0], after])[firsts]


class Words:
    """An open-addressing table from words' hashes to runs of ids."""

    def __init__(self, cached: int):
        self.cached = cached
        self.clear()

    def clear(self) -> None:
        self.slots, self.n, self.used = 1 << 16, 0, 0
        self.key, self.entry = np.zeros(self.slots, np.uint64), np.empty(self.slots, np.int32)
        self.check, self.start, self.length = np.empty(1 << 15, np.uint64), np.empty(1 << 15, np.int64), np.empty(1 << 15, np.int32)
        self.ids = np.empty(1 << 17, np.int32)

    def find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Entry of each word, -1 if the table lacks it. Hashes are not 0."""
        out, todo, at = np.full(len(h), -1, np.int64), np.arange(len(h)), (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            key = self.key[at]
            same = key == h[todo]
            hit, e = todo[same], self.entry[at[same]]
            out[hit] = np.where(self.check[e] == check[hit], e, -1)
            go = ~same & (key != 0)
            todo, at = todo[go], at[go] + 1 & self.slots - 1
        return out

    def _place(self, h: np.ndarray, entry: np.ndarray) -> None:
        at = (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.key[at] == 0)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.key[at[free]], self.entry[at[free]] = h[free], entry[free]
            left = np.ones(len(h), bool)
            left[free] = False
            h, entry, at = h[left], entry[left], at[left] + 1 & self.slots - 1

    def add(self, h: np.ndarray, check: np.ndarray, ids: list[list[int]]) -> None:
        """Words that the table lacks, each once."""
        new, grown = np.fromiter(chain.from_iterable(ids), np.int32), self.n + len(h)
        for name, most in (("check", grown), ("start", grown), ("length", grown), ("ids", self.used + len(new))):
            have = getattr(self, name)
            if most > len(have):
                setattr(self, name, np.concatenate([have, np.empty(max(most, len(have) * 3 // 2) - len(have), have.dtype)]))
        entry = np.arange(self.n, grown, dtype=np.int32)
        self.check[entry], self.length[entry] = check, np.fromiter(map(len, ids), np.int32, len(ids))
        self.start[entry] = self.used + np.cumsum(self.length[entry]) - self.length[entry]
        self.ids[self.used : self.used + len(new)] = new
        self.n, self.used = grown, self.used + len(new)
        if 2 * self.n > self.slots:
            old, self.slots = np.flatnonzero(self.key), 1 << (2 * self.n).bit_length()
            key, at = self.key[old], self.entry[old]
            self.key, self.entry = np.zeros(self.slots, np.uint64), np.empty(self.slots, np.int32)
            self._place(key, at)
        self._place(h, entry)


class Encoder:
    """The ids of a file's tokenizer."""

    def __init__(self, path: str, cached: int = CACHED):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.words = Words(cached)

    def by_library(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def by_model(self, part: str) -> list[int]:
        """Ids of a lower-case part that the pre-tokenizer's expression leaves whole."""
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(_LETTERS)
        return [t.id for t in self.model.tokenize(letters)]

    def word(self, word: str) -> list[int]:
        if word.isascii() and word.isalpha():
            return self.by_model(word.lower())
        if not _PLAIN.fullmatch(word) or "<|" in word:
            return self.by_library(word)
        return [i for p in _PARTS.findall(word.lower()) for i in self.by_model(p)]

    def _runs(self, array):
        """For runs of words of an Arrow array of texts: the number of the first, and their entries in the table."""
        data, offsets = utf8(array)
        begins, ends, firsts = _marks_apart(data, *split_words(data, offsets, SPACED))
        yield firsts, None
        for k in range(0, len(begins), _AT_ONCE):
            b, e = begins[k : k + _AT_ONCE], ends[k : k + _AT_ONCE]
            part, b, e = data[b[0] : e[-1]], b - b[0], e - b[0]
            raw = part.tobytes()
            # A-Z are lower-cased by the vocabulary anyway; only the names of special tokens are told apart by case.
            h, check = (word_hashes(part, b, e, b"<|" not in raw, seed) for seed in (1, 2))
            h |= np.uint64(1)  # 0 is an empty slot
            entries = self.words.find(h, check)
            lack = np.flatnonzero(entries < 0)
            if len(lack):
                new, at = np.unique(h[lack], return_index=True)
                at = lack[at]
                if self.words.n + len(new) > self.words.cached:  # the table begins anew, with all words of this run
                    self.words.clear()
                    new, at = np.unique(h, return_index=True)
                self.words.add(new, check[at], [self.word(raw[x:y].decode("utf-8", "replace")) for x, y in zip(b[at].tolist(), e[at].tolist())])
                entries = self.words.find(h, check)
            yield k, entries

    def ids(self, array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow array, one after the other, and where each text's begin (one more: the end)."""
        runs = self._runs(array)
        firsts, _ = next(runs)
        values, before = [np.empty(0, np.int32)], np.zeros(firsts[-1] + 1, np.int64)
        for k, entries in runs:
            n, starts = self.words.length[entries], self.words.start[entries]
            ends = np.cumsum(n, dtype=np.int64)
            before[k + 1 : k + 1 + len(n)] = before[k] + ends
            values.append(self.words.ids[np.repeat(starts - ends + n, n) + np.arange(ends[-1])])
        return np.concatenate(values), before[firsts]

    def counts(self, array) -> np.ndarray:
        """How many ids each text of an Arrow array has."""
        runs = self._runs(array)
        firsts, _ = next(runs)
        before = np.zeros(firsts[-1] + 1, np.int64)
        for k, entries in runs:
            before[k + 1 : k + 1 + len(entries)] = before[k] + np.cumsum(self.words.length[entries], dtype=np.int64)
        return np.diff(before[firsts])


_LOADED: dict[str, Encoder] = {}


@contextmanager
def encoder(path: str):
    """A worker's encoder of that file: loaded once. Reused workers keep its table, of some 40 MB when it is full; what else
    a task used goes back to the system at its end."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    try:
        yield _LOADED[path]
    finally:
        release()
