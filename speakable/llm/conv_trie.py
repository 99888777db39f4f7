"""Prefix trie of conversations, built from double-array tries of bounded shards.

A node stands for a distinct sequence of first turns. Turns are 128-bit
digests of role and text, so no text is moved. Conversations are cut into
segments of ``deep`` turns; a segment hangs on the node where the one before
it ends, and equal segments on equal nodes are one row with a count and the
smallest member. Segments are dealt into shards by the shortest prefix (of 1, 2, 4,
... turns) that no more than ``shard_turns`` turns share, so a first turn that a
third of all conversations open with is split further down.

A task packs its shards into one double array: turns get dense numbers, a child
stands at ``base[node] + number``, and ``check`` names its parent. Every segment is
then followed through the array, which gives a node its members, and a pass from
the last node to the first sums subtrees. Nodes below a shard's prefix are whole.
Those above it are shared by shards: each shard sends one row for each, rows
of a node are added up over all shards, and what these nodes add themselves to the
nodes above them is summed over their paths.

Segments of later turns are solved first; the totals of the subtree on a node are
carried to the segments that end there. There is one round per ``deep`` turns of
the longest conversation.

Defined cases: null role and text are empty; turns come in the order of
their number, null first, equal numbers in the order of their digests; rows
without a conversation id belong to no conversation and are left out; repeated rows
are turns of their own; an empty table has no nodes; further columns are left
alone. Conversation ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import number_rows
from .common import stored

DEEP = 1024
SHARD_TURNS = 50_000
#: Ids that are joined to one text before they meet those of other tasks.
CHUNK_IDS = 50_000
#: Places that are tried for a node's children before they go to the end of the array.
TRIES = 64
_MOD = 1 << 62
NO_IDS = hashlib.sha256(b"").hexdigest()


# Turns.


def _numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place in all rows, and per conversation the first place and the number of turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    slim = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = number_rows(slim, ["conv_id", "turn", "digest"])
    convs = rows.groupBy("conv_id").agg(F.min("row_no").alias("first"), F.count(F.lit(1)).alias("n_own"))
    return rows, convs


_TURN = ["conv_id", "depth", "digest", "chars", "n_total"]


def _with_markers(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row of depth 0 for every conversation, so that those without turns are members of the root."""
    marks = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"), "n_total")
    return turns.select(*_TURN).unionByName(marks)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """Turns of ``conversations`` (conv_id, turn, role, text) as they are: conv_id, depth, digest, chars, n_total."""
    rows, convs = _numbered(conversations)
    convs = convs.withColumn("n_total", F.col("n_own"))
    turns = rows.join(convs, "conv_id").withColumn("depth", F.col("row_no") - F.col("first") + 1)
    return _with_markers(turns, convs)


def rebuilt_rows(conversations: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Turns of rebuilt conversations, as ``turn_rows`` gives them.

    Conversation ``c`` begins with the first ``h`` turns of conversation
    ``c - c % every`` and goes on with its own turns after its first ``h``,
    where ``h`` is the unsigned crc32 of ``c`` as text modulo ``heads``.
    """
    rows, convs = _numbered(conversations)
    convs = convs.withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("long"))
    base = F.col("conv_id") - F.col("conv_id") % every
    placed = rows.join(convs, "conv_id").withColumn("pos", F.col("row_no") - F.col("first") + 1)
    # At most heads - 1 turns of one conversation, for at most 2 * every of them.
    openings = (
        placed.filter((F.col("conv_id") % every == 0) & (F.col("pos") < heads))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("opening"))
        .withColumnRenamed("conv_id", "base")
    )
    shared = F.when(F.col("h") > 0, F.slice("opening", 1, F.col("h").cast("int")))
    convs = convs.withColumn("base", base).join(openings, "base", "left").withColumn("shared", F.coalesce(shared, F.slice("opening", 1, 0)))
    convs = convs.withColumn("k", F.coalesce(F.size("shared"), F.lit(0)).cast("long"))
    convs = convs.withColumn("k", F.greatest("k", F.lit(0))).withColumn("n_total", F.col("k") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))
    convs = stored(convs.select("conv_id", "first", "h", "k", "n_total", "shared"), "trie-conversations")
    own = (
        rows.join(convs.drop("shared"), "conv_id")
        .withColumn("pos", F.col("row_no") - F.col("first") + 1)
        .filter(F.col("pos") > F.col("h"))
        .withColumn("depth", F.col("pos") - F.col("h") + F.col("k"))
    )
    begun = convs.select("conv_id", "n_total", F.explode("shared").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.digest", "t.chars", "n_total")
    return _with_markers(own.select(*_TURN).unionByName(begun.select(*_TURN)), convs)


# Segments.


def _hexes(turns: Column, n: Column | None = None) -> Column:
    part = turns if n is None else F.slice(turns, 1, n)
    return F.array_join(F.transform(part, lambda t: F.hex(t["digest"])), "")


def _mod(total: Column) -> Column:
    return F.pmod(total, F.lit(_MOD).cast("decimal(38,0)")).cast("long")


def _segments(turns: DataFrame, deep: int) -> DataFrame:
    """Up to ``deep`` turns of a conversation: s1, s2 name the node where they begin, q1, q2 where they end."""
    block = F.when(F.col("depth") > 0, F.floor((F.col("depth") - 1) / deep)).otherwise(0).cast("int")
    turn = F.when(F.col("depth") > 0, F.struct("depth", "digest", "chars"))
    cut = (
        turns.withColumn("block", block)
        .repartition("conv_id", "block")
        .groupBy("conv_id", "block")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.max("n_total").alias("n_total"))
    )
    content = F.md5(_hexes(F.col("turns")).cast("binary"))
    cut = cut.withColumn("l1", F.xxhash64(F.lit(1), content, "block")).withColumn("l2", F.xxhash64(F.lit(2), content, "block"))
    cut = stored(cut, "trie-segments", few=False)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.filter(F.col("n_total") > deep).select("conv_id", "block", *(_mod(F.sum(F.col(c).cast("decimal(38,0)")).over(before)).alias(s) for c, s in (("l1", "s1"), ("l2", "s2"))))
    cut = cut.join(starts, ["conv_id", "block"], "left").na.fill(0, ["s1", "s2"])
    for q, s, c in (("q1", "s1", "l1"), ("q2", "s2", "l2")):
        cut = cut.withColumn(q, _mod(F.col(s).cast("decimal(38,0)") + F.col(c).cast("decimal(38,0)")))
    last = F.col("block") == F.greatest(F.floor((F.col("n_total") - 1) / deep), F.lit(0))
    return cut.withColumn("last", last).select("conv_id", "block", "s1", "s2", "q1", "q2", "turns", "last")


def _ends(segments: DataFrame) -> DataFrame:
    """Per node q1, q2 the digest of the ids of the conversations that end there, in ascending order.

    Ids are joined to chunks where they are sorted; only chunks meet, and
    they are hashed one after the other without being held together.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, ids = [], None, []
        for batch in batches:
            for q1, q2, c in zip(*(batch.column(x).to_pylist() for x in ("q1", "q2", "conv_id")), strict=True):
                if now != (q1, q2) or len(ids) == CHUNK_IDS:
                    if ids:
                        out.append((*now, ids[0], ",".join(map(str, ids))))
                    now, ids = (q1, q2), []
                ids.append(c)
            if len(out) > 1000:
                yield _batch(out, names, kinds)
                out = []
        if ids:
            out.append((*now, ids[0], ",".join(map(str, ids))))
        if out:
            yield _batch(out, names, kinds)

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for q1, q2, chunk in zip(*(batch.column(x).to_pylist() for x in ("q1", "q2", "ids")), strict=True):
                if now == (q1, q2):
                    state.update(b",")
                else:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (q1, q2), hashlib.sha256()
                state.update(chunk.encode())
            if out:
                yield _batch(out, ["q1", "q2", "ends"], [pa.int64(), pa.int64(), pa.string()])
        if now is not None:
            yield _batch([(*now, state.hexdigest())], ["q1", "q2", "ends"], [pa.int64(), pa.int64(), pa.string()])

    names, kinds = ["q1", "q2", "first", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    key = ["q1", "q2", "conv_id"]
    rows = segments.filter("last").select(*key).repartitionByRange(*key).sortWithinPartitions(*key)
    chunks = rows.mapInArrow(join, "q1 long, q2 long, first long, ids string")
    return chunks.repartition("q1", "q2").sortWithinPartitions("q1", "q2", "first").mapInArrow(hash_, "q1 long, q2 long, ends string")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _sharded(seg: DataFrame, shard_turns: int, deep: int) -> DataFrame:
    """Adds ``k``, the depth of the segment's shard in its block, and ``shard``, the prefix of that depth."""
    size = F.size("turns")
    powers = F.filter(F.array(*(F.lit(1 << i) for i in range(deep.bit_length()))), lambda p: p <= F.size("turns"))
    probes = seg.select("q1", "q2", "s1", "s2", size.alias("w"), F.explode(F.transform(powers, lambda p: F.struct(p.alias("p"), F.md5(_hexes(F.col("turns"), p).cast("binary")).alias("hash")))).alias("x"))
    probes = probes.select("q1", "q2", "s1", "s2", "w", "x.*")
    group = ["s1", "s2", "p", "hash"]
    heavy = probes.groupBy(*group).agg(F.sum("w").alias("turns")).filter(F.col("turns") > shard_turns).drop("turns")
    deepest = probes.join(heavy, group, "left_semi").groupBy("q1", "q2").agg(F.max("p").alias("heavy"))
    k = F.least(F.coalesce(2 * F.col("heavy"), F.lit(1)), size + 1)
    prefix = F.concat_ws("|", "s1", "s2", "k", _hexes(F.col("turns"), F.col("k")))
    return seg.join(deepest, ["q1", "q2"], "left").withColumn("k", k).withColumn("shard", F.unhex(F.md5(prefix.cast("binary")))).drop("heavy")


# Double arrays.


class DoubleArray:
    """A trie in two arrays: the child of ``node`` on symbol ``c`` is ``base[node] + c`` if ``check`` there is ``node``."""

    def __init__(self, sequences: list[list]):
        """``sequences`` are sorted lists of symbols; symbols are numbered in the order in which nodes need them."""
        self.base, self.check = [0], [0]
        self.numbers: dict = {}
        self.order = [0]  # nodes, parents before children
        self.n_children: dict[int, int] = {}
        self._free = 1
        todo = [(0, 0, len(sequences), 0)]
        for node, low, high, depth in todo:
            while low < high and len(sequences[low]) == depth:
                low += 1
            runs = []
            at = low
            while at < high:
                symbol, first = sequences[at][depth], at
                while at < high and sequences[at][depth] == symbol:
                    at += 1
                runs.append((self.numbers.setdefault(symbol, len(self.numbers)), first, at))
            self.n_children[node] = len(runs)
            if not runs:
                continue
            base = self.base[node] = self._place([c for c, _, _ in runs])
            for c, first, end in runs:
                child = base + c
                self.check[child] = node
                self.order.append(child)
                todo.append((child, first, end, depth + 1))

    def _place(self, symbols: list[int]) -> int:
        """A base under which the places of all symbols are free."""
        check, least, most = self.check, min(symbols), max(symbols)
        while self._free < len(check) and check[self._free] >= 0:
            self._free += 1
        place, base = self._free, None
        for _ in range(TRIES):
            # Places past the end are free.
            if all(place - least + c >= len(check) or check[place - least + c] < 0 for c in symbols):
                base = place - least
                break
            place += 1
            while place < len(check) and check[place] >= 0:
                place += 1
        if base is None:
            base = len(check) - least
        more = base + most + 1 - len(check)
        if more > 0:
            check.extend([-1] * more)
            self.base.extend([0] * more)
        return base

    def walk(self, sequence: list) -> list[int]:
        """Nodes of a sequence, the root left out."""
        node, out = 0, []
        for symbol in sequence:
            child = self.base[node] + self.numbers[symbol]
            if self.check[child] != node:
                raise KeyError(symbol)
            out.append(child)
            node = child
        return out


_NODE = {
    "upper": pa.bool_(), "key": pa.binary(), "parent": pa.binary(), "path": pa.list_(pa.binary()), "level": pa.int64(), "conv_id": pa.int64(),
    "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved": pa.int64(), "ends": pa.string(),
    "chars": pa.int64(), "root_conv": pa.int64(), "s1": pa.int64(), "s2": pa.int64(),
}
_NODE_DDL = (
    "upper boolean, key binary, parent binary, path array<binary>, level long, conv_id long, parent_conv_id long, n_convs long, n_children long,"
    " n_leaves long, saved long, ends string, chars long, root_conv long, s1 long, s2 long"
)


def _solve(rows: list[dict]) -> list[tuple]:
    """Nodes of a pack of shards: those below the shards' prefixes whole, those above as this pack's share."""
    shards: dict[bytes, int] = {}
    paths = []
    for r in rows:
        shard = shards.setdefault(r["shard"], len(shards))
        if len(r["turns"]) >= r["k"]:
            paths.append(([shard, *(t["digest"] for t in r["turns"][r["k"] :])], r))
    paths.sort(key=lambda x: x[0])
    trie = DoubleArray([p for p, _ in paths])
    size = len(trie.check)
    n, least, ends, chars, level = [0] * size, [None] * size, [None] * size, [0] * size, [0] * size
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    tops: dict[int, dict] = {}
    for path, r in paths:
        nodes = trie.walk(path)
        tops.setdefault(nodes[0], r)
        for i, node in enumerate(nodes):
            n[node] += r["n"]
            least[node] = r["m"] if least[node] is None else min(least[node], r["m"])
            chars[node], level[node] = r["turns"][r["k"] - 1 + i]["chars"], r["k"] + i
        ends[nodes[-1]] = r["ends"]
        children[nodes[-1]], leaves[nodes[-1]], saved[nodes[-1]] = r["t_children"], r["t_leaves"], r["t_saved"]
    for node in reversed(trie.order[1:]):
        children[node] += trie.n_children[node]
        leaves[node] += children[node] == 0
        saved[node] += (n[node] - 1) * chars[node]
        parent = trie.check[node]
        if parent:
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
    out = []
    above: dict[bytes, list] = {}
    keys: dict[bytes, list[bytes]] = {}

    def prefix_keys(r: dict) -> list[bytes]:
        """Names of the nodes above the shard, the block's root first."""
        if r["shard"] not in keys:
            state = hashlib.md5(f"{r['s1']}|{r['s2']}".encode(), usedforsecurity=False)
            found = [state.digest()]
            for t in r["turns"][: r["k"] - 1]:
                state.update(t["digest"])
                found.append(state.digest())
            keys[r["shard"]] = found
        return keys[r["shard"]]

    def add(r: dict, n: int, m: int | None, leaves: int, saved: int, children: int = 0, ends: str | None = None) -> None:
        names = prefix_keys(r)
        for j, name in enumerate(names):
            row = above.get(name)
            if row is None:
                row = above[name] = [name, names[j - 1] if j else None, names[:j], j, None, 0, 0, 0, 0, None, r["turns"][j - 1]["chars"] if j else 0, r["root_m"], r["s1"], r["s2"]]
            row[4] = m if row[4] is None or (m is not None and m < row[4]) else row[4]
            row[5] += n
            row[7] += leaves
            row[8] += saved
        row[6] += children
        row[9] = row[9] or ends

    for r in rows:
        if len(r["turns"]) >= r["k"]:
            add(r, r["n"], r["m"], 0, 0)
        else:
            add(r, r["n"], r["m"], r["t_leaves"], r["t_saved"], r["t_children"], r["ends"])
    for node, r in tops.items():
        add(r, 0, None, leaves[node], saved[node], 1)
    for node in trie.order[1:]:
        parent = trie.check[node]
        top = tops[node] if parent == 0 else None
        over = least[parent] if parent else top["root_m"] if top["k"] == 1 else None
        up = prefix_keys(top)[-1] if top and top["k"] > 1 else None
        out.append((False, None, up, None, level[node], least[node], over, n[node], children[node], leaves[node], saved[node], ends[node], None, None, None, None))
    for key, parent, path, j, m, count, kids, leaf, save, end, width, root_m, s1, s2 in above.values():
        out.append((True, key, parent, path, j, m, None, count, kids, leaf, save, end, width, root_m, s1, s2))
    return out


def _shards(pack_turns: int):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, turns = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if turns >= pack_turns and r["shard"] != rows[-1]["shard"]:
                    yield _batch(_solve(rows), list(_NODE), list(_NODE.values()))
                    rows, turns = [], 0
                rows.append(r)
                turns += len(r["turns"])
        if rows:
            yield _batch(_solve(rows), list(_NODE), list(_NODE.values()))

    return solve


def _merged(upper: DataFrame) -> DataFrame:
    """Nodes above the shards: shares of all packs added up, and what these nodes add to each other."""
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("parent", "path", "level", "chars", "root_conv", "s1", "s2")]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    nodes = upper.groupBy("key").agg(*first, *sums, F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"))
    nodes = stored(nodes, "trie-upper")
    kids = nodes.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = nodes.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids")
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("own", (F.col("n_convs") - 1) * F.col("chars"))
    below = nodes.select(F.explode("path").alias("key"), "leaf", "own").groupBy("key").agg(F.sum("leaf").alias("l"), F.sum("own").alias("o"))
    nodes = nodes.join(below, "key", "left")
    nodes = nodes.withColumn("n_leaves", F.col("n_leaves") + F.col("leaf") + F.coalesce("l", F.lit(0))).withColumn("saved", F.col("saved") + F.col("own") + F.coalesce("o", F.lit(0)))
    over = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("over"))
    nodes = nodes.join(over, "parent", "left").withColumn("parent_conv_id", F.when(F.col("level") == 1, F.col("root_conv")).otherwise(F.col("over")))
    return stored(nodes.drop("leaf", "own", "l", "o", "over", "path"), "trie-merged")


def prefix_nodes(turns: DataFrame, deep: int = DEEP, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct prefix of the conversations that ``turn_rows`` or ``rebuilt_rows`` gives.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    segments = _segments(turns, deep)
    most, smallest = segments.agg(F.max("block"), F.min("conv_id")).first()
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = None
    if most is None:
        none = segments.limit(0).select("conv_id", *(F.lit(None).cast("long").alias(c) for c in columns[1:-1]))
        return none.withColumn(columns[-1], F.lit(None).cast("string"))
    same = segments.groupBy("q1", "q2").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("m"), *(F.first(c).alias(c) for c in ("block", "s1", "s2", "turns"))
    )
    same = stored(same.join(_ends(segments), ["q1", "q2"], "left"), "trie-distinct", few=False)
    tails = None
    for block in range(most, -1, -1):
        seg = same.filter(F.col("block") == block)
        if tails is None:
            seg = seg.withColumns({c: F.lit(0).cast("long") for c in ("t_children", "t_leaves", "t_saved")})
        else:
            seg = seg.join(tails, ["q1", "q2"], "left").na.fill(0, ["t_children", "t_leaves", "t_saved"])
        if block:
            over = same.filter(F.col("block") == block - 1).select(F.col("q1").alias("s1"), F.col("q2").alias("s2"), F.col("m").alias("root_m"))
            seg = seg.join(over, ["s1", "s2"], "left")
        else:
            seg = seg.withColumn("root_m", F.lit(smallest))
        dealt = _sharded(seg, shard_turns, deep).repartition("shard").sortWithinPartitions("shard")
        solved = stored(dealt.mapInArrow(_shards(shard_turns), _NODE_DDL), "trie-nodes", few=False)
        upper = _merged(solved.filter("upper"))
        tails = upper.filter("level = 0").select(
            F.col("s1").alias("q1"), F.col("s2").alias("q2"), F.col("n_children").alias("t_children"), F.col("n_leaves").alias("t_leaves"), F.col("saved").alias("t_saved")
        )
        names = upper.select(F.col("key").alias("parent"), F.col("conv_id").alias("over"))
        lower = solved.filter("NOT upper").join(names, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "over"))
        here = lower.select(*_OUT).unionByName(upper.filter(F.lit(block == 0) | (F.col("level") > 0)).select(*_OUT))
        here = here.withColumn("depth", F.col("level") + block * deep)
        found = here if found is None else found.unionByName(here)
    return found.withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_IDS))).withColumnRenamed("saved", "saved_tokens").select(*columns)


_OUT = ["level", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
