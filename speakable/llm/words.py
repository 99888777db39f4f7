"""Texts coded word by word: equal words of a run of texts are coded once."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r"(?<=\S)(?= )")
#: Two blanks in a row, or one at an end: cutting at every single space would part a run of blanks.
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUNS = rf"{_BLANK}{_BLANK}|\A{_BLANK}|{_BLANK}\z"
#: Marks a word that no space stands in front of, and a text that is not cut.
FIRST, WHOLE = "\x00", "\x01"


def spaced_words(text: str) -> list[str]:
    """A text cut in front of each space that follows a non-blank character.

    The space is left out; the first word, which has none, is marked.
    """
    first, *rest = _CUT.split(text)
    return [FIRST + first, *[x[1:] for x in rest]]


class Parts(dict):
    """Codes of parts of words, made when they are first asked for.

    When ``most`` are held they become the older generation; parts in use move
    over from it, the others go with the next change.
    """

    def __init__(self, make: Callable[[str], bytes], most: int = 120_000):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, part: str) -> bytes:
        code = self.older.get(part)
        if code is None:
            code = self.make(part)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[part] = code
        return code


class WordCoder:
    """Codes of texts as arrays of ids, put together from those of their words.

    Each distinct word of a run of texts is looked up or coded once. Words
    that occur twice are kept for later runs; when too many are kept the older
    half is dropped, so memory stays bounded. ``whole`` says which texts are
    handed over in one piece.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], dtype: np.dtype, whole: Callable[[str], bool], most: int = 100_000):
        self.encode, self.dtype, self.whole, self.most = encode, dtype, whole, most
        self.kept: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(texts)
        odd = pc.match_substring_regex(pa.array(texts, pa.large_string()), _RUNS).to_pylist() if texts else []
        plain, other = [], []
        for i, text in enumerate(texts):
            if text:
                (other if odd[i] or FIRST in text or WHOLE in text or self.whole(text) else plain).append(i)
        if plain:
            # The mark in front of a text becomes that of its first word.
            cut = pc.split_pattern(pa.array([FIRST + texts[i] for i in plain], pa.large_string()), " ")
            for i, ids in zip(plain, self._coded(pc.list_flatten(cut), pc.list_value_length(cut).to_numpy()), strict=True):
                out[i] = ids
        if other:
            rows = [[WHOLE + t] if FIRST in t or WHOLE in t or self.whole(t) else spaced_words(t) for t in (texts[i] for i in other)]
            flat = pa.array(list(chain.from_iterable(rows)), pa.large_string())
            for i, ids in zip(other, self._coded(flat, np.array([len(r) for r in rows])), strict=True):
                out[i] = ids
        return out

    def _coded(self, flat: pa.Array, counts: np.ndarray) -> list[np.ndarray]:
        found = flat.dictionary_encode()
        index = found.indices.to_numpy().astype(np.int64)
        # By way of numpy, which makes strings many times faster than the array's own list.
        words = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = list(map(self.kept.get, words))
        new = [i for i, c in enumerate(codes) if c is None]
        for i, code in zip(new, self.encode([words[i] for i in new]), strict=True):
            codes[i] = code
        often = (np.bincount(index, minlength=len(words)) > 1).tolist()
        self.kept.update((words[i], codes[i]) for i in new if often[i])
        if len(self.kept) > self.most:
            self.kept = dict(list(self.kept.items())[len(self.kept) // 2 :])
        size = np.fromiter(map(len, codes), np.int64, len(codes)) // self.dtype.itemsize
        first = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(codes), self.dtype)
        n = size[index]
        ends = np.cumsum(n)
        out = ids[np.repeat(first[index] - (ends - n), n) + np.arange(n.sum())]
        cut = np.r_[0, ends][np.r_[0, np.cumsum(counts)]].tolist()
        return [out[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
