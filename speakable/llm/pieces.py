"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The normaliser (leading mark, blanks to marks, removal of extra blanks), the
vocabulary and the byte fallback of a model file are compiled into one
transducer. Composed with a text it is a lattice: an arc for every piece that
matches at a place, and a fallback arc of byte pieces for a character that is
no piece. The ids are the labels of the shortest path in the tropical
semiring.

Weights depend on the kind of model. In a unigram model an arc costs the
negative score of its piece. In a merge model (BPE) an arc costs nothing after
a piece with which its own piece does not merge, and infinitely much
otherwise; exactly one path is finite, since a sequence of pieces is the
result of merging if and only if no merge crosses any of its boundaries. Either
way a place needs one best arc: in a merge model every beginning of a text
has one finite path, and the first complete one found is the shortest.

Where no piece holds a character and its neighbour side by side, no arc spans the
boundary between them and the lattice falls apart; equal parts are solved once and
kept. Texts are first cut at spaces, if no piece goes on after its mark.

Defined cases: null and empty texts have no ids and decode to the empty
text; texts of any length are encoded whole; decoding gives the text back
except for the mark character itself, which reads as a blank, and for what the
normaliser of the model removes. Models with a character map or marks at word
ends are refused.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import steps
from .words import FIRST, WHOLE, Parts, WordCoder

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BPE = 1, 2
NEVER = float("inf")
STEP_BYTES = 1_500_000
_BLANKS = re.compile(" +")


class Pieces:
    """A compiled model."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec, train = proto.normalizer_spec, proto.trainer_spec
        if spec.precompiled_charsmap or train.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("models with a character map, marks at word ends or plain blanks are not supported")
        if train.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and merge models are supported")
        self.merges = train.model_type == BPE
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = [p.score for p in proto.pieces]
        self.bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.unknown_cost = 10 - min((self.scores[i] for i in self.ids.values()), default=0.0)
        self.heads = {w[:n] for w in self.ids for n in range(1, len(w) + 1)}
        self.dtype = np.dtype("<u2" if len(self.scores) <= 1 << 16 else "<u4")
        self.by_word = not any(MARK in w[1:] and w.strip(MARK) for w in self.ids)
        self.surface = {i: w for w, i in self.ids.items()}
        self.said = [
            bytes([int(p.piece[3:5], 16)]) if p.type == BYTE
            else b"" if p.type == CONTROL
            else " ⁇ ".encode() if p.type == UNKNOWN
            else p.piece.replace(MARK, " ").encode()
            for p in proto.pieces
        ]
        self._steps: dict[str, list[tuple[float, str, str]] | None] = {}
        self._fits: dict[tuple[str, str], bool] = {}
        self.inside = {pair for w in self.ids for pair in zip(w, w[1:], strict=False)}
        self.parts = Parts(lambda part: self._code(*self.path(part)))
        self.coder = WordCoder(self._code_words, self.dtype, lambda text: not self.by_word or MARK in text)

    def _code(self, *ids: int) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _fallback(self, char: str) -> list[int]:
        """Byte pieces of a character, or the unknown id."""
        return [self.bytes_[b] for b in char.encode("utf-8", "surrogatepass")] if len(self.bytes_) == 256 else [self.unknown]

    # Merge models: which pieces may stand side by side.

    def _score(self, left: str, right: str) -> float:
        i = self.ids.get(left + right)
        return -NEVER if i is None else self.scores[i]

    def _timeline(self, word: str) -> list[tuple[float, str, str]] | None:
        """Merges that build a piece: score, and the outer left and right symbol after each; None if it is never built."""
        if word not in self._steps:
            symbols, out = list(word), [(NEVER, word[0], word[-1])]
            while len(symbols) > 1:
                best, at = max((self._score(a, b), -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
                if best == -NEVER:
                    break
                symbols[-at : 2 - at] = [symbols[-at] + symbols[1 - at]]
                out.append((best, symbols[0], symbols[-1]))
            self._steps[word] = out if len(symbols) == 1 else None
        return self._steps[word]

    def fits(self, left: str, right: str) -> bool:
        """Whether merging leaves the boundary between two pieces alone.

        Both pieces are merged side by side in order of score, the left one
        first where scores are equal, until a merge across would be due.
        """
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 200_000:
                self._fits.clear()
            known = self._fits[key] = self._no_merge_across(self._timeline(left), self._timeline(right))
        return known

    def _no_merge_across(self, a: list | None, b: list | None) -> bool:
        if a is None or b is None:
            return False
        i = k = 0
        while True:
            across = self._score(a[i][2], b[k][1])
            next_a = a[i + 1][0] if i + 1 < len(a) else -NEVER
            next_b = b[k + 1][0] if k + 1 < len(b) else -NEVER
            if across > next_a and across >= next_b and across > -NEVER:
                return False
            if next_a == next_b == -NEVER:
                return True
            if next_a >= next_b:
                i += 1
            else:
                k += 1

    # The shortest path.

    def path(self, word: str) -> list[int]:
        """Labels of the shortest path through the lattice of a normalised word."""
        arcs = self._merge_path(word) if self.merges else self._cheapest_path(word)
        out: list[int] = []
        for piece in arcs:
            i = self.ids.get(piece)
            out += self._fallback(piece) if i is None else [i]
        return out

    def _arcs(self, word: str, i: int) -> list[str]:
        """Labels of the arcs from a place: matching pieces, or the character itself."""
        out, ids, heads = [], self.ids, self.heads
        for j in range(i + 1, len(word) + 1):
            piece = word[i:j]
            if piece not in heads:
                break
            if piece in ids:
                out.append(piece)
        return out if out and len(out[0]) == 1 else [word[i], *out]

    def _merge_path(self, word: str) -> list[str]:
        """Every finite arc costs nothing, so the first complete finite path is a shortest one.

        Long pieces are tried first. One finite path leads to a place, so a
        place that led nowhere is never entered again.
        """
        if not word:
            return []
        n, dead, fits = len(word), set(), self.fits
        path: list[str] = []
        open_: list[list[str]] = [[a for a in self._arcs(word, 0) if self._timeline(a) is not None]]
        at = [0]
        while at[-1] < n:
            here = at[-1]
            while open_[-1]:
                piece = open_[-1].pop()
                end = here + len(piece)
                if end not in dead and (not path or fits(path[-1], piece)):
                    path.append(piece)
                    at.append(end)
                    open_.append(self._arcs(word, end) if end < n else [])
                    break
            else:
                dead.add(at.pop())
                open_.pop()
                path.pop()
        return path

    def _cheapest_path(self, word: str) -> list[str]:
        n = len(word)
        cost, back = [0.0] + [NEVER] * n, [0] * (n + 1)
        ids, scores = self.ids, self.scores
        for i in range(n):
            for piece in self._arcs(word, i):
                k = ids.get(piece)
                price = cost[i] + (self.unknown_cost if k is None else -scores[k])
                if price < cost[i + len(piece)]:
                    cost[i + len(piece)], back[i + len(piece)] = price, i
        out = []
        while n:
            out.append(word[back[n] : n])
            n = back[n]
        return out[::-1]

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = _BLANKS.sub(" ", text.strip(" "))
        return ((" " if self.prefix and text else "") + text).replace(" ", MARK)

    def _code_words(self, words: list[str]) -> list[bytes]:
        """New words, cut where no piece can span; each part that is new is solved."""
        out, part = [], self.parts.__getitem__
        for word in words:
            if word[:1] == WHOLE:
                text = self.normalised(word[1:])
            elif word[:1] == FIRST:
                text = (MARK * self.prefix + word[1:]).replace(" ", MARK)
            else:
                text = MARK + word.replace(" ", MARK)
            codes, start = [], 0
            for i, pair in enumerate(zip(text, text[1:], strict=False), 1):
                if pair not in self.inside:
                    codes.append(part(text[start:i]))
                    start = i
            codes.append(part(text[start:]))
            out.append(b"".join(codes))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.squeeze:
            texts = [_BLANKS.sub(" ", t.strip(" ")) for t in texts]
        return self.coder(texts)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.said.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def pieces(path: str, _made: dict = {}) -> Pieces:  # noqa: B006
    """One compiled model per worker process and file."""
    if path not in _made:
        with open(path, "rb") as f:
            _made[path] = Pieces(f.read())
    return _made[path]


def encoded(texts: pd.Series, made: Pieces) -> list[np.ndarray]:
    """Ids of a batch of texts, a bounded run at a time; null is the empty text."""
    texts = [t if isinstance(t, str) else "" for t in texts]
    return [x for at, run in steps(texts, STEP_BYTES) for x in made.encode(texts[at : at + len(run)])]


def encode_pieces(text: Column, model: str) -> Column:
    """Ids of a text as an array."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([x.astype(np.int32) for x in encoded(texts, pieces(model))], dtype=object)

    return encode(text)


def decode_pieces(ids: Column, model: str) -> Column:
    """The text of an array of ids; null is the empty text."""

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        made = pieces(model)
        return pd.Series(["" if x is None else made.decode(np.asarray(x)) for x in rows], dtype=object)

    return decode(ids)


def coded_documents(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with its text replaced by ``piece_ids``, ``n_pieces`` and ``decoded``, what the ids stand for.

    Both ways are one pass, a bounded run of texts at a time; other columns pass through, those
    of the three names excepted.
    """
    new = ("piece_ids", "n_pieces", "decoded")
    kept = [c for c in docs.columns if c != text and c not in new]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pieces(model)
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                # Texts become strings a run at a time, not a batch at a time.
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + STEP_BYTES, side="right")))
                here, at = batch.slice(at, end - at), end
                ids = made.encode([t or "" for t in here.column(text).to_pylist()])
                counts = np.array([len(x) for x in ids], np.int64)
                ends = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int32)))
                columns = [here.column(c) for c in kept] + [lists, pa.array(counts), pa.array([made.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *new])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    return docs.select(*(F.col(f"`{c}`") for c in kept), text).mapInArrow(code, ", ".join([*kinds, "piece_ids array<int>", "n_pieces long", "decoded string"]))


def piece_digest(text: Column, model: str) -> Column:
    """Encodes, decodes and describes both without keeping the ids: counts, checksums, and whether the text came back."""

    @F.pandas_udf("n_pieces long, ids_crc32 long, n_chars long, text_sha256 string, round_trip boolean")
    def digest(texts: pd.Series) -> pd.DataFrame:
        made, rows = pieces(model), []
        texts = [t if isinstance(t, str) else "" for t in texts]
        for at, run in steps(texts, STEP_BYTES):
            for text, ids in zip(texts[at : at + len(run)], made.encode(texts[at : at + len(run)]), strict=True):
                back = made.decode(ids)
                crc = zlib.crc32(ids.astype("<u4").tobytes())
                rows.append((len(ids), crc, len(back), hashlib.sha256(back.encode()).hexdigest(), back == text))
        return pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "n_chars", "text_sha256", "round_trip"])

    return digest(text)
