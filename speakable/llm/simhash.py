"""SimHash near-duplicates over a hierarchical index in Gray order.

Fingerprints that differ in at most ``d`` of 64 bits agree, if the bits are cut
into ``d + 2`` blocks, in at least two of them. Each pair of blocks gives a
mask, and the masked bits of a fingerprint are the key of a bucket. Within a
bucket the fingerprints are sorted by Gray rank, which keeps neighbours alike,
and a tree is laid over the order: a node knows the bits that all of its
members share. Two nodes are compared on the bits that both share; the
differences found there already exceed ``d`` for most pairs, which drops the
whole groups at once, and where even all unshared bits cannot bring the differences
above ``d`` the groups are linked as a whole. A bucket only reports which of
its members hang together, never its pairs.

Equal fingerprints are one row from the start, so copies cost nothing. A
bucket beyond ``bucket_rows`` rows is cut into runs of its Gray order
and each pair of runs whose shared bits allow a link is searched in
a task of its own. Components grow from the links by star contraction in
joins; no group is gathered in one place.

Defined cases: a text without words (null and empty ones included) has
fingerprint zero and is linked like any other; one with fewer words than a
shingle is one shingle; texts of any length are read whole; rows with a null
id take part, and a component of such rows alone has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored
from .jaccard import first_of_similar

SEED = 42
FAN = 8
BUCKET_ROWS = 16_384
#: Rows of whole buckets that one step of the search holds, and node pairs it looks at together.
STEP_ROWS, STEP_PAIRS = 131_072, 1 << 20


def fingerprint(data: bytes, shingle: int) -> int:
    """Majority of the bits of all shingle hashes; ``data`` is UTF-8."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words))
    begin = np.r_[0, ends[:-1]][: len(words) - k + 1].tolist()
    stop = (ends[k - 1 :] - 1).tolist()
    hash_ = xxhash.xxh64_intdigest
    count, n = np.zeros(64, np.int64), len(begin)
    for at in range(0, n, 65_536):
        h = np.array([hash_(joined[a:b], SEED) for a, b in zip(begin[at : at + 65_536], stop[at : at + 65_536], strict=True)], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * count > n, bitorder="little")
    return int(bits.view("<u8")[0])


def simhash(text: Column, shingle: int) -> Column:
    """Fingerprint of a text as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def make(texts: pd.Series) -> pd.Series:
        found = [fingerprint(t.encode(), shingle) if isinstance(t, str) else 0 for t in texts]
        return pd.Series(np.array(found, np.uint64).view(np.int64))

    return make(text)


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Position of a bit pattern in the Gray code."""
    rank = bits.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_rank_column(bits: Column) -> Column:
    """The same as a signed integer whose order is that of the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, shift))
    return bits.bitwiseXOR(F.lit(-(1 << 63)))


def masks(distance: int) -> list[int]:
    """Masks of every two out of ``distance + 2`` blocks, as signed integers."""
    n = distance + 2
    cuts = [64 * i // n for i in range(n + 1)]
    block = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(n)]
    return [x - (1 << 64) if x >> 63 else x for x in (a | b for a, b in combinations(block, 2))]


class GrayForest:
    """Trees over buckets of fingerprints, each in Gray order; buckets lie one after the other."""

    def __init__(self, bucket: np.ndarray, bits: np.ndarray):
        self.bits = bits
        n = len(bits)
        new = np.r_[True, bucket[1:] != bucket[:-1]]
        first = np.flatnonzero(new)
        place = np.arange(n) - first[np.cumsum(new) - 1]
        number = np.cumsum(new) - 1
        self.levels = [(np.arange(n), np.arange(1, n + 1), bits, ~np.uint64(0) * np.ones(n, np.uint64))]
        self.starts = [np.arange(n)]
        width, most = 1, int(np.diff(np.r_[first, n]).max(initial=1))
        while width < most:
            width *= FAN
            head = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (place[1:] // width != place[:-1] // width)])
            all_, any_ = np.bitwise_and.reduceat(bits, head), np.bitwise_or.reduceat(bits, head)
            below = self.starts[-1]
            self.levels.append((np.searchsorted(below, head), np.searchsorted(below, np.r_[head[1:], n]), all_, ~(all_ ^ any_)))
            self.starts.append(head)
        self.parent = np.arange(n)

    def _root(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self._root()
            a, b = root[a], root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def components(self, distance: int) -> np.ndarray:
        """For each fingerprint, the first one of its bucket that it hangs together with."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.starts[top]))
        self._search(top, roots, roots, distance)
        return self._root()

    def _search(self, level: int, a: np.ndarray, b: np.ndarray, distance: int) -> None:
        """Compare pairs of nodes of a level, ``a`` not after ``b``; go on with the children of those left."""
        for at in range(0, len(a), STEP_PAIRS // (FAN * FAN)):
            x, y = a[at : at + STEP_PAIRS // (FAN * FAN)], b[at : at + STEP_PAIRS // (FAN * FAN)]
            _, _, bits, shared = self.levels[level]
            both = shared[x] & shared[y]
            least = np.bitwise_count((bits[x] ^ bits[y]) & both)
            near = least <= distance
            x, y, both, least = x[near], y[near], both[near], least[near]
            if level == 0:
                self._join(x, y)
                continue
            whole = least + (64 - np.bitwise_count(both).astype(np.int64)) <= distance
            self._link_whole(level, x[whole], y[whole])
            x, y = x[~whole], y[~whole]
            begin, end = self.levels[level][0], self.levels[level][1]
            n_x, n_y = end[x] - begin[x], end[y] - begin[y]
            pair = np.repeat(np.arange(len(x)), n_x * n_y)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(n_x * n_y) - n_x * n_y, n_x * n_y)
            child_x, child_y = begin[x[pair]] + k // n_y[pair], begin[y[pair]] + k % n_y[pair]
            # A node against itself holds each pair of children twice; a child against itself matters above the leaves.
            once = (x[pair] != y[pair]) | (child_x < child_y) | ((child_x == child_y) & (level > 1))
            self._search(level - 1, child_x[once], child_y[once], distance)

    def _link_whole(self, level: int, x: np.ndarray, y: np.ndarray) -> None:
        start = self.starts[level]
        stop = np.r_[start[1:], len(self.bits)]
        for own, other in ((x, x), (y, x)):
            size = stop[own] - start[own]
            member = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[own], size)
            self._join(np.repeat(start[other], size), member)


def bucket_links(rows: DataFrame, distance: int) -> DataFrame:
    """``a`` hangs together with the smaller ``b``, for the members of each bucket (t, key, run_a, run_b)."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush(rows: pd.DataFrame) -> pd.DataFrame:
            ids = rows[["t", "key", "run_a", "run_b"]].to_numpy()
            bucket = np.cumsum(np.r_[False, (ids[1:] != ids[:-1]).any(axis=1)])
            bits = rows["bits"].to_numpy(np.int64)
            first = GrayForest(bucket, bits.view(np.uint64)).components(distance)
            linked = np.flatnonzero(first != np.arange(len(first)))
            pair = np.sort(np.column_stack([bits[linked], bits[first[linked]]]), axis=1)
            pair = np.unique(pair[pair[:, 0] != pair[:, 1]], axis=0)
            return pd.DataFrame({"a": pair[:, 1], "b": pair[:, 0]})

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < STEP_ROWS:
                continue
            rows = pd.concat(held, ignore_index=True)
            ids = rows[["t", "key", "run_a", "run_b"]].to_numpy()
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1))
            held = [rows]
            if len(cuts):
                cut = int(cuts[-1]) + 1  # the last bucket may go on in the next batch
                yield flush(rows.iloc[:cut])
                held = [rows.iloc[cut:].reset_index(drop=True)]
        if held and sum(map(len, held)):
            yield flush(pd.concat(held, ignore_index=True))

    by = ["t", "key", "run_a", "run_b"]
    return rows.repartition(*by).sortWithinPartitions(*by, "gray").select(*by, "bits").mapInPandas(search, "a long, b long")


def links(prints: DataFrame, distance: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pairs (a, b), b < a, that connect all fingerprints (distinct, column ``bits``) linked at the distance."""
    keys = [F.struct(F.lit(i).alias("t"), F.col("bits").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(distance))]
    rows = prints.select("bits", gray_rank_column(F.col("bits")).alias("gray"), F.inline(F.array(*keys)))
    many = stored(rows.groupBy("t", "key").count().filter(F.col("count") > bucket_rows), "large-buckets")
    single = F.lit(0).cast("long").alias("run_a"), F.lit(0).cast("long").alias("run_b")
    if many.isEmpty():
        return bucket_links(rows.select("t", "key", *single, "bits", "gray"), distance)
    plain = rows.join(many, ["t", "key"], "left_anti").select("t", "key", *single, "bits", "gray")
    # Runs of the Gray order: a range partition holds consecutive rows, and every bucket_rows of them start a new run.
    large = rows.join(many.select("t", "key"), ["t", "key"]).select("t", "key", "bits", "gray")
    parts = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    run = F.shiftleft(F.shiftright(place, 33), 30) + F.floor(place.bitwiseAND((1 << 33) - 1) / bucket_rows)
    ordered = large.repartitionByRange(parts, "t", "key", "gray").sortWithinPartitions("t", "key", "gray")
    cut = stored(ordered.withColumn("run", run), "runs", few=False)
    nodes = cut.groupBy("t", "key", "run").agg(F.expr("bit_and(bits)").alias("every"), F.expr("bit_or(bits)").alias("some"))
    shared = lambda n: F.bitwise_not(F.col(f"{n}.every").bitwiseXOR(F.col(f"{n}.some")))
    same = (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.run") <= F.col("y.run"))
    apart = F.bit_count(F.col("x.every").bitwiseXOR(F.col("y.every")).bitwiseAND(shared("x")).bitwiseAND(shared("y")))
    pairs = nodes.alias("x").join(nodes.alias("y"), same & (apart <= distance)).select("x.t", "x.key", F.col("x.run").alias("run_a"), F.col("y.run").alias("run_b"))
    each = pairs.select("t", "key", "run_a", "run_b", F.explode(F.array_distinct(F.array("run_a", "run_b"))).alias("run"))
    paired = cut.join(each, ["t", "key", "run"]).select("t", "key", "run_a", "run_b", "bits", "gray")
    return bucket_links(plain.unionByName(paired), distance)


def components(edges: DataFrame) -> DataFrame:
    """The smallest member of the component of each node (a, b) -> (node, root); roots themselves are left out.

    Large and small stars alternate: every node hands its larger, then its smaller
    neighbours the smallest node it sees, until nothing changes. Each round
    is written to the shared folder.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
        drop_stored(edges)
        edges = after
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document (doc_id, text): doc_id, bits, tie (hash of the text), component_id."""
    made = stored(docs.select("doc_id", simhash(F.col("text"), shingle).alias("bits"), F.xxhash64("text").alias("tie")), "fingerprints", few=False)
    prints = made.groupBy("bits").agg(F.min("doc_id").alias("first"))
    hang = components(links(prints.select("bits"), distance, bucket_rows))
    rooted = prints.join(hang, F.col("bits") == F.col("node"), "left").select("bits", "first", F.coalesce("root", "bits").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(ids, "root").select("bits", "root", "component_id")
    return made.join(named, "bits").select("doc_id", "bits", "tie", "root", "component_id")


def hex_bits(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def one_per_group(docs: DataFrame, shingle: int = 5, similar: float = 0.8, distance: int = 6) -> DataFrame:
    """Keep, with all its columns, the first document of each set of near copies.

    Fingerprints that hang together at the distance name the first candidates, which ``jaccard`` checks exactly.
    """

    def roots(prints: DataFrame) -> DataFrame:
        return components(links(prints, distance)).select(F.col("node").alias("bits"), "root")

    return first_of_similar(docs, roots, shingle, similar)
