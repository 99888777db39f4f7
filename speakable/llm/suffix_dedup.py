"""Removal of byte strings that occur more than once, by bounded interval expansion on a BWT.

Which strings can be equal is settled first. Every window of ``length`` bytes has
an anchor, its ``seed``-byte piece with the least hash (the leftmost of
equals); equal windows have equal anchors at equal places. Windows in a row
with one anchor are a fragment, so a text falls into about one fragment per
``(length - seed) / 2`` bytes, and equal windows always lie in fragments with the
same anchor hash. Fragments whose anchor occurs once are dropped. Fragments equal
byte for byte are one class, told by two 64-bit hashes; all windows of a class
with two members are repeated, and one member stands for it.

Classes with the same anchor still have to be compared, since they can share
some windows and not others. Their bytes are gathered in blocks of bounded
size; the block's rotations are sorted, and from its Burrows-Wheeler transform
intervals are extended to the left breadth-first: the queue of round ``l``
holds the intervals of strings of length ``l``, and the right end of an
extension that has no common prefix yet gets ``l``. Rounds stop at ``length``;
neighbours without a value by then have at least that much in common, so the
windows that start there are repeated.

An anchor may have very many classes (a passage that all documents hold, with
other text around it in each). Beyond ``most_classes`` its windows are dealt one
by one, by their content: the interval of a whole window is then its group, and
only its count is needed.

Defined cases: null and empty texts have no bytes and lose none; texts below
``length`` bytes lose none; rows equal in id and text count as two places, so both
lose all; texts of any length are read whole; equal strings never cross documents;
other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from .common import drop_stored, steps, stored

LENGTH, SEED = 200, 48
MOST_CLASSES = 4096
BLOCK_BYTES = 1_500_000
BREAK, STOP = 0xFF, 0xFE  # bytes that UTF-8 never has
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_VALUE = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)
_PLACE = np.uint64((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the ``seed`` bytes at each place."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * _powers(_BASE, n), out=sums[1:])
    x = (sums[seed:] - sums[:-seed]) * _powers(_BACK, n - seed + 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row, from running minima of blocks."""
    n = len(values)
    pad = -n % width
    wide = np.r_[values, np.full(pad, ~np.uint64(0), np.uint64)].reshape(-1, width)
    ahead = np.minimum.accumulate(wide, axis=1).ravel()
    behind = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])


def fragments(run: list[bytes], length: int, seed: int) -> tuple[np.ndarray, ...]:
    """For all texts of a run: text number, start, number of windows, anchor hash, hash of the bytes."""
    long = [i for i, t in enumerate(run) if len(t) >= length]
    if not long:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    data = b"".join(run[i] for i in long)
    size = np.array([len(run[i]) for i in long])
    first = np.r_[0, np.cumsum(size)[:-1]]
    if len(data) >= 1 << 24:  # one text of 16 MB or more: places need all their bits
        return _long_fragments(run, long, length, seed)
    hashes = seed_hashes(np.frombuffer(data, np.uint8), seed)
    place = np.arange(len(hashes), dtype=np.uint64)
    anchor = (window_least((hashes & ~_PLACE) | place, length - seed + 1) & _PLACE).astype(np.int64)
    windows = size - length + 1
    start = np.repeat(first, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    text = np.repeat(np.arange(len(long)), windows)
    at = anchor[start]
    head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    count = np.diff(np.r_[head, len(at)])
    begin = start[head]
    digest = xxhash.xxh3_64_intdigest
    whole = np.array([digest(data[a : a + c + length - 1]) for a, c in zip(begin.tolist(), count.tolist(), strict=True)], np.uint64)
    which = text[head]
    return np.array(long)[which], begin - first[which], count, hashes[at[head]], whole


def _long_fragments(run: list[bytes], long: list[int], length: int, seed: int) -> tuple[np.ndarray, ...]:
    """The same text by text, each in parts that overlap by a window less one; a fragment at a cut becomes two."""
    parts = []
    step = (1 << 24) - 1 - length
    for i in long:
        text = run[i]
        for at in range(0, len(text) - length + 1, step):
            _, start, count, anchor, whole = fragments([text[at : at + step + length - 1]], length, seed)
            parts.append((np.full(len(start), i), start + at, count, anchor, whole))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# The index of a block.


def rotation_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Rotations sorted by at least their first ``depth`` bytes."""
    n = len(data)
    ring = np.r_[data, data[:8]] if n >= 8 else np.resize(data, n + 8)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | ring[j : j + n].astype(np.uint64)
    # Rotations with equal beginnings may stand in any order; they share their rank.
    kind = np.int32 if n < 1 << 31 else np.int64
    order = np.argsort(key)
    rank = np.empty(n, kind)
    rank[order] = _first_equal(key[order])
    width = 8
    active = order.astype(kind)
    while width < depth:
        groups = rank[active]
        alone = np.ones(len(active), bool)
        same = groups[1:] == groups[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        active = active[~alone]
        if not len(active):
            break
        groups, second = rank[active], rank[(active + kind(width)) % kind(n)]
        by = np.argsort(groups * np.int64(n) + second)
        active, groups, second = active[by], groups[by], second[by]
        new_group = np.r_[True, groups[1:] != groups[:-1]]
        at = np.arange(len(active), dtype=kind)
        head = np.maximum.accumulate(np.where(new_group, at, kind(0)))
        first = np.maximum.accumulate(np.where(new_group | np.r_[True, second[1:] != second[:-1]], at, kind(0)))
        rank = rank.copy()
        rank[active] = groups + first - head
        width *= 2
    return np.argsort(rank)


def _first_equal(ordered: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(np.r_[True, ordered[1:] != ordered[:-1]], np.arange(len(ordered)), 0))


def bounded_prefixes(bwt: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each rotation with the one before it; ``length`` where it is that or more.

    Breadth-first backward extension: round ``l`` takes the intervals of
    strings of length ``l``, extends each by every byte that stands before it,
    and gives ``l`` to the right ends that have no value yet.
    """
    n = len(bwt)
    kind = np.int32 if n < 1 << 22 else np.int64  # 256 times a place must fit
    stride = n + 1
    column = bwt.astype(kind)
    by_byte = np.argsort(bwt, kind="stable").astype(kind)
    places = column[by_byte] * kind(stride) + by_byte  # (byte, row) sorted: its rank is the row after extension
    run = np.cumsum(np.r_[True, bwt[1:] != bwt[:-1]], dtype=kind) - kind(1)  # equal bytes in a row extend together
    run_byte = column[np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])]
    out = np.full(n + 1, length, kind)
    out[0] = out[n] = 0
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.array([0], kind), np.array([n], kind)
    for level in range(length):
        a, b = run[low], run[high - 1]
        count = b - a + kind(1)
        k = len(low)
        interval = np.repeat(np.arange(k, dtype=kind), count)
        member = np.arange(len(interval), dtype=kind) - np.repeat(np.cumsum(count, dtype=kind) - count - a, count)
        # Sorted by byte, then interval, the new intervals come in the order of their rows, and both searches run forwards.
        code = run_byte[member] * kind(k) + interval
        code.sort()
        code = code[np.r_[True, code[1:] != code[:-1]]]
        byte, interval = np.divmod(code, kind(k))
        byte *= kind(stride)
        new_high = np.searchsorted(places, byte + high[interval]).astype(kind)
        fresh = ~known[new_high]
        new_low = np.searchsorted(places, (byte + low[interval])[fresh]).astype(kind)
        low, high = new_low, new_high[fresh]
        out[high] = level
        known[high] = True
        if not len(low):
            break
    return out[:n]


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its windows also start elsewhere in the block."""
    parts = []
    for t in texts:
        parts += [t, bytes([BREAK])]
    data = np.frombuffer(b"".join(parts) + bytes([STOP]), np.uint8)
    order = rotation_order(data, length)
    common = bounded_prefixes(data[order - 1], length)
    deep = common >= length
    both = np.zeros(len(data), bool)
    both[order] = deep | np.r_[deep[1:], False]
    out, at = [], 0
    for t in texts:
        out.append(both[at : at + max(len(t) - length + 1, 0)])
        at += len(t) + 1
    return out


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs that are true."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return first, end - first


# The Spark side.

FRAGMENT = "id long, tie long, start int, n int, h long, d long"


def _fragment_rows(docs: DataFrame, length: int, seed: int) -> DataFrame:
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, ties = batch["id"].to_numpy(), batch["tie"].to_numpy()
            for first, run in steps(batch["text"]):
                which, start, n, h, d = fragments(run, length, seed)
                yield pd.DataFrame({"id": ids[first + which], "tie": ties[first + which], "start": start, "n": n, "h": h.view(np.int64), "d": d.view(np.int64)})

    return docs.mapInPandas(make, FRAGMENT)


def _cut(text_rows: DataFrame, length: int) -> DataFrame:
    """(h, d, data) of the fragments listed with each text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
                data = text.encode()
                rows = [(w["h"], w["d"], w["copies"], w["many"], data[w["start"] : w["start"] + w["n"] + length - 1]) for w in wanted]
                yield pd.DataFrame(rows, columns=["h", "d", "copies", "many", "data"])

    return text_rows.select("text", "wanted").mapInPandas(cut, "h long, d long, copies long, many boolean, data binary")


def _compare(classes: DataFrame, length: int) -> DataFrame:
    """(h, d, first, n) runs of repeated windows, by the index of each block of anchors."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            for h, d, flags in zip(rows["h"], rows["d"], repeated_starts([bytes(x) for x in rows["data"]], length), strict=True):
                out += [(h, d, a, n) for a, n in zip(*(x.tolist() for x in _ranges(flags)), strict=True)]
            return pd.DataFrame(out, columns=["h", "d", "first", "n"])

        for batch in batches:
            held.append(batch)
            if sum(int(x["data"].map(len).sum()) for x in held) < BLOCK_BYTES:
                continue
            rows = pd.concat(held, ignore_index=True)
            anchors = rows["h"].to_numpy()
            ends = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
            size, begin = np.cumsum(rows["data"].map(len).to_numpy()), 0
            for end in ends:  # whole anchors only; the last may go on
                if size[end - 1] - (size[begin - 1] if begin else 0) >= BLOCK_BYTES or end == ends[-1]:
                    yield flush(rows.iloc[begin:end])
                    begin = end
            held = [rows.iloc[begin:].reset_index(drop=True)]
        if held and sum(map(len, held)):
            yield flush(pd.concat(held, ignore_index=True))

    return classes.repartition("h").sortWithinPartitions("h").select("h", "d", "data").mapInPandas(look, "h long, d long, first int, n int")


def _count_windows(classes: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many classes, window by window."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for h, d, data in zip(batch["h"], batch["d"], batch["data"], strict=True):
                n = len(data) - length + 1
                yield pd.DataFrame({"h": h, "d": d, "first": np.arange(n), "w": [digest(data[i : i + length]) for i in range(n)]})

    windows = classes.select("h", "d", "data").mapInPandas(deal, "h long, d long, first int, w binary")
    often = windows.groupBy("w").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("w")
    return windows.join(often, "w", "left_semi").select("h", "d", "first", F.lit(1).alias("n"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED, most_classes: int = MOST_CLASSES) -> DataFrame:
    """(id, tie, spans): per text of ``docs`` (id, tie, text) the runs of repeated windows as (start, n)."""
    made = _fragment_rows(docs, length, seed)
    twice = stored(made.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"), "anchors")
    alive = stored(made.join(twice, "h", "left_semi"), "fragments")
    drop_stored(twice)
    one = F.min(F.struct("id", "tie", "start", "n")).alias("one")
    classes = stored(alive.groupBy("h", "d").agg(F.count(F.lit(1)).alias("copies"), one), "classes")
    per_anchor = classes.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").withColumn("many", F.col("k") > most_classes)
    # A class with copies is repeated as a whole; it is compared all the same, for the sake of its partners.
    wanted = classes.join(per_anchor, "h").groupBy("one.id", "one.tie").agg(F.collect_list(F.struct("h", "d", "copies", "many", "one.start", "one.n")).alias("wanted"))
    bytes_ = stored(_cut(docs.join(wanted, ["id", "tie"]).dropDuplicates(["id", "tie"]), length), "compared", few=False)
    some = _compare(bytes_.filter("NOT many"), length).unionByName(_count_windows(bytes_.filter("many"), length))
    whole = classes.filter("copies > 1").select("h", "d", F.lit(0).alias("first"), F.col("one.n").alias("n"))
    some = some.join(classes.filter("copies > 1").select("h", "d"), ["h", "d"], "left_anti")
    # The exchange keeps the blocks' work in as many tasks as before, and lets the slim result be written in few parts.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(whole.unionByName(some).repartition(parts, "h", "d"), "repeated")
    drop_stored(bytes_)
    spans = alive.select("h", "d", "id", "tie", "start").join(found, ["h", "d"])
    return spans.groupBy("id", "tie").agg(F.collect_list(F.struct((F.col("start") + F.col("first")).alias("start"), "n")).alias("spans"))


def kept_bytes(data: bytes, spans: list, length: int) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal removed runs; spans are runs of window starts."""
    if not len(spans):
        return data, 0
    start = np.array([s["start"] for s in spans])
    order = np.argsort(start)
    start = start[order]
    end = np.maximum.accumulate((start + np.array([s["n"] for s in spans])[order]) + length - 1)
    new = np.r_[True, start[1:] > end[:-1]]
    first = start[new]
    last = end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]
    parts = [data[a:b] for a, b in zip(np.r_[0, last].tolist(), np.r_[first, len(data)].tolist(), strict=True)]
    return b"".join(parts), len(first)


def _number(kind: DataType) -> Column:
    """An integer for each id; for ids that are none, a hash, and the hash of the text tells them apart."""
    return F.col("doc_id").cast("long") if isinstance(kind, IntegralType) else F.xxhash64("doc_id")


def remove_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256."""
    keyed = docs.select(
        "doc_id",
        F.coalesce(_number(docs.schema["doc_id"].dataType), F.lit(0)).alias("id"),
        F.xxhash64("text", F.col("doc_id").isNull()).alias("tie"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    spans = repeated_spans(keyed.select("id", "tie", "text"), length, **options)

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    def take(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, own in zip(texts, spans, strict=True):
            data = text.encode()
            kept, n = kept_bytes(data, [] if own is None else own, length)
            rows.append((len(data), len(data) - len(kept), n, kept, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return keyed.join(spans, ["id", "tie"], "left").select("doc_id", take("text", "spans").alias("r")).select("doc_id", "r.*")
