"""Packing of documents into token windows by the sum-of-squares rule.

A task reads its documents once and keeps an array with the number of partly
filled windows per fill level. A document goes to the level, the empty one
included, after which the sum of the squares of that array is smallest; among
equal levels the fullest is taken. Squares keep levels that few documents
would close from piling up, so most windows are closed by whole documents.
What is longer than a window fills whole windows first, and its rest is placed.

Windows are handed on when they are full. At most ``most_open`` are held; past
that, and at the end of a task, open windows are filled up from the emptiest
ones, whose documents are cut for it. The less than one window of ids that a
task has left at its end is cut at the powers of two of its length, which need
no padding. No rows are shuffled; a sequence is numbered by its task and its
place there, as ``monotonically_increasing_id`` numbers rows, so a task that
runs again numbers alike.

Texts are encoded word by word where the tokenizer file drops white space, as
``WORD_SPEC`` says it; files with other rules are encoded text by text.

Defined cases: a null or empty text is its end id alone; rows that repeat an
id or a text are documents of their own; null ids stay null; texts of any length are
encoded whole; an empty table gives no pieces; further columns are left alone.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import steps
from .token_store import BYTE_CHARS
from .words import FIRST, WHOLE, Parts, WordCoder

WINDOW = 2048
MOST_OPEN = 1024
STEP_BYTES = 2_000_000
#: Ids that a task gathers before it hands pieces on.
FLUSH_IDS = 1_000_000
# The rules of tokenizer files whose words are independent.
WORD_SPEC = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: The pattern of ``WORD_SPEC`` for lower-cased ASCII, and for the letters below ``BEYOND``.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x20\x09-\x0d0-9a-z]+")
_LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\x20\x09-\x0d\x85\xa0\p{L}\p{N}]+")
#: Latin letters with their marks; they have one reading in every version of Unicode, and lower case letter by letter.
BEYOND = "\u0250"
KEPT = 300_000


class WordEncoder:
    """Ids of texts by the tokenizers library; equal words of a run of texts are encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        by_word = all(spec[k] == v for k, v in WORD_SPEC.items())
        self.model = self.tokenizer.model
        ids = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(ids.values()) < 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(" " in s for s in self.special):
            by_word = False
        self.parts = Parts(self._part, KEPT)
        self.coder = WordCoder(self._encode, self.dtype, lambda text: not by_word, KEPT)
        self.by_word = by_word

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.dtype.char, ids).tobytes()

    def _part(self, part: str) -> bytes:
        if not (part.isascii() and part.isprintable()):
            part = part.encode().decode("latin-1").translate(BYTE_CHARS)
        return self._pack([t.id for t in self.model.tokenize(part)])

    def _encode(self, words: list[str]) -> list[bytes]:
        out, part, cut = [], self.parts.__getitem__, _ASCII.findall
        for word in words:
            mark = word[:1]
            whole = mark == WHOLE
            if whole or mark == FIRST:
                word = word[1:]
            if whole or not (word.isascii() or max(word) < BEYOND) or ("<" in word and any(s in word for s in self.special)):
                out.append(self._pack(self.tokenizer.encode(word, add_special_tokens=False).ids))
                continue
            low = word.lower()
            out.append(part(low) if low.isalpha() else b"".join(map(part, (cut if low.isascii() else _LATIN.findall)(low))))
        return out

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.by_word and texts:
            # Fewer words differ; a text that could hold a special string keeps its case.
            low = pc.ascii_lower(pa.array(texts, pa.large_string())).to_pylist()
            texts = [t if "<" in t and any(s in x for s in self.special) else x for t, x in zip(texts, low, strict=True)]
        return self.coder(texts)


def word_encoder(path: str, _made: dict = {}) -> WordEncoder:  # noqa: B006
    """One encoder per worker process and tokenizer file."""
    if path not in _made:
        _made[path] = WordEncoder(path)
    return _made[path]


#: Document, ids before the piece, its ids, ids of the whole document.
Piece = tuple[object, int, np.ndarray, int]


class Packer:
    """Windows of one task. ``full`` holds those that are closed, each a list of pieces."""

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN):
        self.window, self.most_open = window, most_open
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.full: list[list[Piece]] = []
        # What one more or one less window at a level adds to the sum of squares.
        self._more = np.ones(window + 1, np.int64)
        self._more[window] = 0
        self._less = np.full(window + 1, np.iinfo(np.int64).max // 2)
        self._less[0] = 0

    def _count(self, level: int, by: int) -> None:
        n = self.levels[level] + by
        self.levels[level] = n
        self._more[level] = 2 * n + 1
        self._less[level] = 1 - 2 * n if n else np.iinfo(np.int64).max // 2

    def best_level(self, size: int) -> int:
        """The level to which ``size`` ids are added."""
        change = self._more[size:] + self._less[: self.window + 1 - size]
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def _keep(self, level: int, pieces: list[Piece]) -> None:
        if level == self.window:
            self.full.append(pieces)
        else:
            self.open[level].append(pieces)
            self.n_open += 1
            self._count(level, 1)

    def _take(self, level: int) -> list[Piece]:
        self.n_open -= 1
        self._count(level, -1)
        return self.open[level].pop()

    def add(self, doc: object, ids: np.ndarray) -> None:
        n, start = len(ids), 0
        while n - start >= self.window:
            self.full.append([(doc, start, ids[start : start + self.window], n)])
            start += self.window
        if start == n:
            return
        level = self.best_level(n - start)
        pieces = self._take(level) if level else []
        # A copy, since the ids are a view of all those of a run of texts.
        pieces.append((doc, start, ids[start:].copy(), n))
        self._keep(level + n - start, pieces)
        if self.n_open > self.most_open:
            self.settle()

    def settle(self) -> None:
        """Close all open windows but one, the fullest first, with the ids of the emptiest."""
        levels = [level for level in range(1, self.window) for _ in self.open[level]]
        windows = [self._take(level) for level in levels]
        lowest, highest = 0, len(windows) - 1
        while lowest < highest:
            fill, room = windows[highest], self.window - levels[highest]
            while room and lowest < highest:
                doc, start, ids, n = windows[lowest].pop()
                if len(ids) > room:
                    windows[lowest].append((doc, start, ids[:-room], n))
                    start, ids = start + len(ids) - room, ids[-room:]
                fill.append((doc, start, ids, n))
                room -= len(ids)
                levels[lowest] -= len(ids)
                if not levels[lowest]:
                    lowest += 1
            if room:
                break
            self.full.append(fill)
            highest -= 1
        if lowest <= highest:
            rest = windows[highest]
            if rest:
                self._keep(sum(len(p[2]) for p in rest), rest)

    def finish(self) -> None:
        """Settle, and cut what is left at the powers of two of its length."""
        self.settle()
        rest = next((w for level in self.open for w in level), [])
        size = sum(len(p[2]) for p in rest)
        if size:
            self._take(size)
        while size:
            take = room = 1 << size.bit_length() - 1
            part: list[Piece] = []
            while room:
                doc, start, ids, n = rest.pop(0)
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:], n))
                    ids = ids[:room]
                part.append((doc, start, ids, n))
                room -= len(ids)
            self.full.append(part)
            size -= take


def packed(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, most_open: int = MOST_OPEN) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in their sequences.

    Columns: doc_id, start, length, ids (little-endian ``<u4``), ids_crc32, doc_tokens, sequence_id, offset.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, packer, done = word_encoder(tokenizer), Packer(window, most_open), 0
        end = np.array([end_id], code.dtype)

        def rows() -> pd.DataFrame:
            nonlocal done
            out = []
            for sequence in packer.full:
                offset = 0
                for doc, start, ids, n in sequence:
                    data = ids.astype("<u4").tobytes()
                    out.append((doc, start, len(ids), data, zlib.crc32(data), n, done, offset))
                    offset += len(ids)
                done += 1
            packer.full = []
            return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "local", "offset"])

        for batch in batches:
            keys = list(batch["doc_id"])
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for at, run in steps(batch["text"], STEP_BYTES):
                for key, ids in zip(keys[at : at + len(run)], code(texts[at : at + len(run)]), strict=True):
                    packer.add(key, np.concatenate([ids, end]))
                    if len(packer.full) * window >= FLUSH_IDS:
                        yield rows()
        packer.finish()
        if packer.full:
            yield rows()

    kind = docs.schema["doc_id"].dataType
    # Ids travel as text: pandas would hold a column of integers with nulls as floats.
    made = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        pack, "doc_id string, start long, length long, ids binary, ids_crc32 long, doc_tokens long, local long, offset long"
    )
    number = F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("local")
    return made.select(F.col("doc_id").cast(kind).alias("doc_id"), "start", "length", "ids", "ids_crc32", "doc_tokens", number.alias("sequence_id"), "offset")


def padded_length(length: Column, window: int = WINDOW) -> Column:
    """Ids of a sequence with its padding: a power of two stays, all others fill the window."""
    return F.when(length.bitwiseAND(length - 1) == 0, length).otherwise(F.lit(window))


def sequences(pieces: DataFrame, pad_id: int, window: int = WINDOW) -> DataFrame:
    """Whole sequences: sequence_id, length, ids with padding as little-endian ``<u4``. At most ``window`` pieces meet."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), "")).alias("ids"))
    pad = F.lit(int(pad_id).to_bytes(4, "little"))
    return joined.withColumn("ids", F.rpad("ids", (padded_length(F.col("length"), window) * 4).cast("int"), pad))


def packed_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Where each piece of a document is, with the checksum of its ids."""
    return packed(docs, tokenizer, end_id=1).drop("ids")
