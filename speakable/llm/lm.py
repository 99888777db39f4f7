"""Language-model scoring with a weighted backoff automaton.

The automaton has a root state and a state for every context of up to
``order - 1`` words that training texts hold. From the state of context ``h`` an
arc on ``w`` weighs the smoothed sequence

    log10((c(h w) + mu * P(w | h')) / (c(h) + mu)),   P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

if training texts hold it, ``h'`` being ``h`` without its first word; it leads to the longest
context that ends there. Any other word takes the failure arc of ``h`` to ``h'``, log10(mu /
(c(h) + mu)), and so on down to the root, which has an arc for every word. All words
together have probability one from every state. A text is one traversal from
the state of the end token through its words to the end token, which carries its
state along and adds up the weights of the arcs it takes.

Nothing of the model is ever in one place. Texts are dealt into blocks of
about ``block_bytes``; a block lists its distinct words and word pairs as 64-bit
hashes with their counts in its training texts, cut into buckets by hash;
each bucket adds up what all blocks hold and answers every block with the totals
of just the entries that it asked for. With these a block has the part of the
automaton that its texts can reach, and traverses it. A frequent word is one
entry per block and bucket, so it needs no salt, and both kinds of task
stay bounded because the numbers of blocks and buckets follow the input.

Words: lower-cased A-Z, cut at the six ASCII blanks; the end token counts as a
word that no text can hold. Words are told apart by their 64-bit XXH64 and
pairs by a 64-bit mix of two; a collision would merge two entries.

Defined cases: null and empty texts are the end token alone; without training
texts N and V are 0 and every score is 0; texts of any length are read whole;
repeated rows count each time; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MU = 100.0
BLOCK_BYTES = 16_000_000
END = b" "
_ODD = np.uint64(1)


def word_hash(word: bytes) -> int:
    """Even for words; pairs are odd."""
    return xxhash.xxh64_intdigest(word) & ~1


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) | _ODD


@dataclass
class Grams:
    """Distinct sequences of some length in a block, in the order of (context, last word)."""

    left: np.ndarray  # number of the context one shorter
    right: np.ndarray  # last word
    suffix: np.ndarray  # number of the sequence without its first word
    of: np.ndarray  # per token the sequence that ends there, -1 where its text has just begun
    hashes: np.ndarray


@dataclass
class Block:
    """Texts as numbers: all tokens in a row, each text closed by the end token."""

    hashes: np.ndarray  # of the block's words; number 0 is the end
    tokens: np.ndarray
    starts: np.ndarray
    grams: list[Grams]  # of lengths 2, 3, ...

    @classmethod
    def read(cls, texts: list[bytes], order: int = 2) -> Block:
        known = {END: 0}
        rows = []
        for data in texts:
            words = data.lower().split()
            words.append(END)
            rows.append(np.array([known.setdefault(w, len(known)) for w in words], np.int32))
        tokens = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        starts = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)
        hashes = np.array([word_hash(w) for w in known], np.uint64)
        grams: list[Grams] = []
        # The end of one text is the start of the next, so every token has a word before it.
        context, shorter = np.r_[np.zeros(1, np.int32), tokens[:-1]][: len(tokens)], tokens
        for _ in range(2, order + 1):
            valid = np.flatnonzero(context >= 0)
            code, index, which = np.unique(context[valid].astype(np.int64) * len(known) + tokens[valid], return_index=True, return_inverse=True)
            left, right = (code // len(known)).astype(np.int32), (code % len(known)).astype(np.int32)
            of = np.full(len(tokens), -1, np.int32)
            of[valid] = which
            over = grams[-1].hashes if grams else hashes
            grams.append(Grams(left, right, shorter[valid[index]], of, pair_hash(over[left], hashes[right])))
            shorter = of
            context = np.r_[np.full(1, -1, np.int32), of[:-1]][: len(tokens)]
            context[starts[:-1]] = -1
        return cls(hashes, tokens, starts, grams)

    def keys(self) -> np.ndarray:
        return np.concatenate([self.hashes, *(g.hashes for g in self.grams)])

    def counts(self, train: np.ndarray) -> np.ndarray:
        """How often each key occurs in the training texts of the block."""
        used = np.repeat(train, np.diff(self.starts))
        parts = [np.bincount(self.tokens[used], minlength=len(self.hashes))]
        for g in self.grams:
            of = g.of[used]
            parts.append(np.bincount(of[of >= 0], minlength=len(g.left)))
        return np.concatenate(parts).astype(np.int64)


@dataclass
class Automaton:
    """The states and arcs that the texts of a block can reach.

    State 0 is the root; then come the words and the longer contexts that
    training texts hold. Arcs are sorted by ``state * words + word``.
    """

    words: int
    root: np.ndarray  # per word: weight of the root's arc
    after_root: np.ndarray  # per word: the state that the root's arc leads to
    seen: np.ndarray  # per word: whether training texts hold it
    failure: np.ndarray  # per state: weight of its failure arc
    back: np.ndarray  # per state: where its failure arc leads, the context without its first word
    arc: np.ndarray
    weight: np.ndarray
    target: np.ndarray

    @classmethod
    def build(cls, block: Block, totals: np.ndarray, n: int, v: int, mu: float) -> Automaton:
        size = len(block.hashes)
        ends = np.cumsum([size, *(len(g.left) for g in block.grams)])
        counts = np.split(totals, ends[:-1])
        first = np.r_[1, 1 + ends[:-1]].astype(np.int64)  # first state of each length
        p = (counts[0] + 0.5) / (n + 0.5 * (v + 1))
        root, state = np.log10(p), 1 + np.arange(size)
        after_root = np.where((counts[0] > 0) & bool(block.grams), state, 0)
        back = [np.zeros(1, np.int64), np.zeros(size, np.int64)]
        arcs, weights, targets = [], [], []
        for k, g in enumerate(block.grams):
            own = counts[k + 1]
            # Seen or not, the weight is that of the smoothed count; an unseen sequence has no arc and gets the same by failure.
            p = (own + mu * p[g.suffix]) / (counts[k][g.left] + mu)
            shorter = first[k] + g.suffix
            there = own > 0
            arcs.append((first[k] + g.left[there]) * size + g.right[there])
            weights.append(np.log10(p[there]))
            last = k + 1 == len(block.grams)
            targets.append((shorter if last else first[k + 1] + np.arange(len(own)))[there].astype(np.int32))
            if not last:
                back.append(shorter)
        held = np.concatenate(counts[: len(back) - 1])
        failure = np.r_[0.0, np.log10(mu / (held + mu))]
        none = [np.zeros(0, np.int64)]
        return cls(size, root, after_root, counts[0] > 0, failure, np.concatenate(back), np.concatenate(arcs or none), np.concatenate(weights or none), np.concatenate(targets or none))

    def traverse(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: log10 probability, the same by the root alone, and the number of known tokens.

        All texts are read side by side from left to right, the longest first,
        so those that still go on are the first ones.
        """
        length = np.diff(block.starts)
        if not len(length):
            return np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        by = np.argsort(-length, kind="stable")
        start, running = block.starts[:-1][by], np.searchsorted(-length[by], -np.arange(length.max()), side="left")
        score, state = np.zeros(len(by)), np.full(len(by), self.after_root[0], np.int64)
        for t, m in enumerate(running.tolist()):
            word = block.tokens[start[:m] + t]
            open_ = np.arange(m)
            while len(open_):
                now, w = state[open_], word[open_]
                code = now * self.words + w
                at = np.minimum(np.searchsorted(self.arc, code), max(len(self.arc) - 1, 0))
                hit = (self.arc[at] == code) if len(self.arc) else np.zeros(len(code), bool)
                free = ~hit & (now == 0)
                done, end = open_[hit], open_[free]
                score[done] += self.weight[at[hit]]
                state[done] = self.target[at[hit]]
                score[end] += self.root[w[free]]
                state[end] = self.after_root[w[free]]
                left = ~hit & ~free
                open_ = open_[left]
                score[open_] += self.failure[now[left]]
                state[open_] = self.back[now[left]]
        out = np.empty(len(by))
        out[by] = score
        at = block.starts[:-1]
        return out, np.add.reduceat(self.root[block.tokens], at), np.add.reduceat(self.seen[block.tokens].astype(np.int64), at)


def _blocks(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """Documents with their block; the number of blocks follows the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // block_bytes) + 1
    # The id alone would put all rows of one id into one block.
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n


def lm_scores(docs: DataFrame, train: str = "train", mu: float = MU, block_bytes: int = BLOCK_BYTES, order: int = 2) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text, and a boolean column named by ``train``).

    Columns: doc_id, train, n_tokens, n_known, train_tokens, vocabulary, base_score, score.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.coalesce(F.col(train), F.lit(False)).alias("train"))
    rows, n = _blocks(rows, block_bytes)
    dealt = rows.repartition(n, "block")

    def texts_of(frame: pd.DataFrame) -> list[bytes]:
        return [t.encode() if isinstance(t, str) else b"" for t in frame["text"]]

    def ask(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        block = Block.read(texts_of(frame), order)
        keys = block.keys()
        by = np.argsort(keys)
        keys, counts = keys[by], block.counts(frame["train"].to_numpy(bool))[by]
        bucket = _bucket(keys, n)
        cut = np.searchsorted(bucket, np.arange(n + 1))
        parts = [(k, key[0], keys[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()) for k, a, b in zip(range(n), cut[:-1], cut[1:], strict=True)]
        return pd.DataFrame(parts, columns=["bucket", "block", "keys", "counts"])

    def answer(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, np.uint64) for k in frame["keys"]]
        counts = np.concatenate([np.frombuffer(c, "<u4") for c in frame["counts"]]).astype(np.float64)
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(place, counts, len(every)).astype("<u8")
        word = (every & _ODD) == 0
        ends = np.r_[0, np.cumsum([len(k) for k in keys])]
        found = [_narrow(totals[place[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pd.DataFrame(
            {
                "block": frame["block"],
                "bucket": key[0],
                "totals": found,
                "n": int(totals[word].sum()),
                "v": int((totals[word] > 0).sum()),
            }
        )

    def walk(key: tuple, frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        block = Block.read(texts_of(frame), order)
        by = np.argsort(block.keys())
        told = told.sort_values("bucket")
        totals = np.empty(len(by), np.float64)
        totals[by] = np.concatenate([_wide(t) for t in told["totals"]])
        n_tokens, v = int(told["n"].sum()), int(told["v"].sum())
        automaton = Automaton.build(block, totals, n_tokens, v, mu)
        score, base, known = automaton.traverse(block)
        return pd.DataFrame(
            {
                "doc_id": frame["doc_id"],
                "train": frame["train"],
                "n_tokens": np.diff(block.starts),
                "n_known": known,
                "train_tokens": n_tokens,
                "vocabulary": v,
                "base_score": base,
                "score": score,
            }
        )

    asked = dealt.groupBy("block").applyInPandas(ask, "bucket int, block int, keys binary, counts binary")
    told = asked.groupBy("bucket").applyInPandas(answer, "block int, bucket int, totals binary, n long, v long")
    out = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(
        walk,
        "doc_id string, train boolean, n_tokens long, n_known long, train_tokens long, vocabulary long, base_score double, score double",
    )
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Ranges of the sorted hashes, alike in size."""
    return np.minimum((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32), np.uint64(n - 1)).astype(np.int64)


def _narrow(values: np.ndarray) -> bytes:
    """Totals in as few bytes each as the largest needs; most fit one byte, and the others follow whole."""
    small = np.minimum(values, 255).astype(np.uint8)
    return np.uint32(len(values)).tobytes() + small.tobytes() + values[small == 255].astype("<u8").tobytes()


def _wide(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    small = np.frombuffer(data, np.uint8, n, 4)
    out = small.astype(np.float64)
    out[small == 255] = np.frombuffer(data, "<u8", -1, 4 + n)
    return out
