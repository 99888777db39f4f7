"""Manifest of a dataset as a tree of SHA-256 digests whose parents keep midstates.

A row is a leaf: the digest of its fields, each ``-`` if null, else its UTF-8
byte count, ``:`` and its value. Per group, leaves ascend by key; every
``FAN`` consecutive nodes become the digest of their hexadecimal digests until one is
left, the group's subroot. Subroots, ordered by group (null first, bytewise),
give the root the same way. Digests are lowercase hexadecimal.

A parent keeps a copy of its hash state before each child slot. To fold a
changed child, the copy of its slot is resumed with the new digest and the
digests right of it; what stands left of it is not hashed again. Above a
block, all its leaves share one state per level.

No task holds a tree. Leaves are numbered per group by a range partitioning;
runs of ``FAN ** LEVELS`` are blocks, whose tops are the nodes of the next
tier, and so on. The way down hands each block the siblings above it, a
few strings per level; the leaf tier then makes proofs and folds. A group with
most rows is many blocks.

Defined cases: null fields count as ``-``, so null keys and groups are rows like
others, first in their order; rows with equal keys stand side by side in the
order of their leaf digests; empty and very long texts are hashed whole; an
empty table gives no rows; further columns are left alone.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import number_rows
from .common import stored

FAN = 8
#: Levels of a block, which so holds 4096 leaves.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Most groups whose table of sizes is sent to all executors; more are joined by shuffling.
MOST_BROADCAST = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "tree long, block long, lefts array<string>, rights array<string>, top string, root string"


def leaf(*fields: Column) -> Column:
    """Digest of a row's fields."""

    def coded(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(coded, fields)).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Parent:
    """A node with the hash states before each of its child slots."""

    def __init__(self, children: list[str]):
        self.children, self.states = children, []
        state = hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()
        self.rights = ["".join(children[i + 1 :]).encode() for i in range(len(children))]

    def fold(self, slot: int, child: str) -> str:
        """The digest with another child: resumes the slot's state."""
        state = self.states[slot].copy()
        state.update(child.encode())
        state.update(self.rights[slot])
        return state.hexdigest()

    def siblings(self, slot: int) -> tuple[str, str]:
        return "".join(self.children[:slot]), self.rights[slot].decode()


def grow(nodes: list[str], levels: int) -> list[list[Parent]]:
    """Parents level by level."""
    out = []
    for _ in range(levels):
        row = [Parent(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
        nodes = [p.digest for p in row]
        out.append(row)
    return out


def _levels(n: int, tier: int, deep: int) -> int:
    """Levels of a block of this tier in a tree with ``n`` leaves; blocks have at most ``deep``."""
    return max(0, min(deep, height(n) - deep * tier))


def _block(deep: int) -> Column:
    return F.floor(F.col("pos") / FAN**deep).cast("long").alias("block")


def _climb(nodes: DataFrame, tier: int, deep: int) -> DataFrame:
    """Tops of the blocks of a tier: tree, n (leaves of the tree), pos (block), digest."""

    def top(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("pos")
        n = int(rows["n"].iloc[0])
        hexes = [bytes(d).hex() for d in rows["digest"]]
        parents = grow(hexes, _levels(n, tier, deep))
        found = parents[-1][0].digest if parents else hexes[0]
        return pd.DataFrame({"tree": [key[0]], "n": [n], "pos": [key[1]], "digest": [bytes.fromhex(found)]})

    blocks = nodes.select("tree", "n", "pos", "digest", _block(deep))
    return blocks.groupBy("tree", "block").applyInPandas(top, "tree long, n long, pos long, digest binary")


def _descend(nodes: DataFrame, above: DataFrame, tier: int, deep: int) -> DataFrame:
    """For every node of a tier the siblings on its way up; ``above`` has those of its block."""

    def spread(key: tuple, frame: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("pos")
        parents = grow([bytes(d).hex() for d in rows["digest"]], _levels(int(rows["n"].iloc[0]), tier, deep))
        up = path.iloc[0]
        lefts, rights = [], []
        for i in range(len(rows)):
            sides, at = [], i
            for level in parents:
                sides.append(level[at // FAN].siblings(at % FAN))
                at //= FAN
            lefts.append([a for a, _ in sides] + list(up["lefts"]))
            rights.append([b for _, b in sides] + list(up["rights"]))
        return pd.DataFrame({"tree": key[0], "block": rows["pos"], "lefts": lefts, "rights": rights, "top": up["top"], "root": up["root"]})

    blocks = nodes.select("tree", "n", "pos", "digest", _block(deep))
    return blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(spread, _PATH)


def _tiers(leaves: DataFrame, most: int, deep: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes per tier, the leaves first, and the tops of all trees (tree, n, digest)."""
    tiers, tops = [leaves], None
    for tier in range(max(1, -(-height(most) // deep))):
        made = stored(_climb(tiers[-1], tier, deep), "merkle-nodes")
        done = F.udf(lambda n, t=tier: height(n) <= deep * (t + 1), "boolean")(F.col("n"))
        top = made.filter(done).select("tree", "n", "digest")
        tops = top if tops is None else tops.unionByName(top)
        tiers.append(made.filter(~done))
    return tiers[:-1], tops


def manifest(rows: DataFrame, key: str, group: str, deep: int = LEVELS) -> DataFrame:
    """Roots, proofs and folds of ``rows`` with columns ``key``, ``group``, leaf and claimed.

    ``claimed`` is the leaf digest that is folded into the tree instead of the
    row's own. Columns: key, leaf, subroot, root, proof_sha256 (the digest of
    all siblings on the way from the leaf to the root), folded_root, verified.
    """
    slim = rows.select(F.col(key).alias("key"), F.col(group).alias("group"), F.unhex("leaf").alias("leaf"), F.unhex(F.nullif(F.col("claimed"), F.col("leaf"))).alias("other"))
    numbered = number_rows(slim, ["group", "key", "leaf", "other"])
    sizes = numbered.groupBy("group").agg(F.min("row_no").alias("first"), F.count(F.lit(1)).alias("n"))
    trees = stored(number_rows(sizes, ["group"], "tree").withColumn("tree", F.col("tree") - 1), "merkle-trees")
    n_trees, most = trees.agg(F.count(F.lit(1)), F.max("n")).first()
    if not n_trees:
        return _output(numbered.limit(0), key)
    small = F.broadcast(trees) if n_trees <= MOST_BROADCAST else trees
    placed = numbered.join(small.withColumnRenamed("group", "of"), F.col("group").eqNullSafe(F.col("of")))
    leaves = placed.select("tree", "n", (F.col("row_no") - F.col("first")).alias("pos"), F.col("leaf").alias("digest"), "key", "other")

    tiers, subroots = _tiers(leaves, most, deep)
    crown = stored(subroots.select(F.lit(-1).cast("long").alias("tree"), F.lit(n_trees).alias("n"), F.col("tree").alias("pos"), "digest"), "merkle-subroots")
    upper, tops = _tiers(crown, n_trees, deep)
    root = bytes(tops.first().digest).hex()
    empty = F.array().cast("array<string>")
    path = leaves.sparkSession.range(1).select(F.lit(-1).cast("long").alias("tree"), F.lit(0).cast("long").alias("block"), empty.alias("lefts"), empty.alias("rights"), F.lit("").alias("top"), F.lit(root).alias("root"))
    for tier in range(len(upper) - 1, -1, -1):
        path = _descend(upper[tier], path, tier, deep)
    # A node of the crown is a tree; its path is that of the tree's only block on top.
    paths = path.select(F.col("block").alias("tree"), "lefts", "rights", "root").join(crown.select(F.col("pos").alias("tree"), F.hex("digest").alias("top")), "tree")
    above = paths.select("tree", F.lit(0).cast("long").alias("block"), "lefts", "rights", F.lower("top").alias("top"), "root")
    ends = above
    for tier in range(len(tiers) - 1, 0, -1):
        # Trees whose top stands in a lower tier have no nodes here and pass by.
        here = _descend(tiers[tier], above.join(tiers[tier].select("tree").distinct(), "tree", "left_semi"), tier, deep)
        above = stored(here.unionByName(ends.join(here.select("tree").distinct(), "tree", "left_anti")), "merkle-paths")
    return _output(_folded(leaves, above, deep), key)


def _folded(leaves: DataFrame, above: DataFrame, deep: int) -> DataFrame:
    def fold(key: tuple, frame: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("pos")
        own = [bytes(d).hex() for d in rows["digest"]]
        claimed = [a if b is None else bytes(b).hex() for a, b in zip(own, rows["other"], strict=True)]
        parents = grow(own, _levels(int(rows["n"].iloc[0]), 0, deep))
        up = path.iloc[0]
        lefts, rights = list(up["lefts"]), [r.encode() for r in up["rights"]]
        states = [hashlib.sha256(left.encode()) for left in lefts]
        rest = "".join(a + b for a, b in zip(up["lefts"], up["rights"], strict=True))
        proofs, folded = [], []
        for i, changed in enumerate(claimed):
            parts, at = [], i
            for level in parents:
                parent, slot = level[at // FAN], at % FAN
                parts += parent.siblings(slot)
                changed, at = parent.fold(slot, changed), at // FAN
            for state, right in zip(states, rights, strict=True):
                resumed = state.copy()
                resumed.update(changed.encode())
                resumed.update(right)
                changed = resumed.hexdigest()
            proofs.append(digest(*parts, rest))
            folded.append(changed)
        return pd.DataFrame({"key": rows["key"], "leaf": own, "subroot": up["top"], "root": up["root"], "proof_sha256": proofs, "folded_root": folded})

    # Ids travel as text: pandas would hold a column of integers with nulls as floats.
    kind = leaves.schema["key"].dataType
    blocks = leaves.withColumn("key", F.col("key").cast("string")).withColumn("block", _block(deep))
    out = blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(
        fold, "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    )
    return out.withColumn("key", F.col("key").cast(kind))


def _output(rows: DataFrame, key: str) -> DataFrame:
    text = F.lit(None).cast("string")
    for name in ("subroot", "root", "proof_sha256", "folded_root"):
        rows = rows if name in rows.columns else rows.withColumn(name, text)
    named = rows.select(F.col("key").alias(key), F.col("leaf").cast("string").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root")
    return named.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(doc_id: Column, every: int = 3) -> Column:
    """Whether ``every`` divides the unsigned crc32 of the id as text; null ids are left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % every == 0, F.lit(False))


def document_manifest(docs: DataFrame, deep: int = LEVELS) -> DataFrame:
    """The manifest of ``documents``, with the texts of some rows lower-cased after it was made."""
    own = leaf(*map(F.col, FIELDS))
    other = leaf(*(lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in FIELDS))
    rows = docs.select("doc_id", "lang", own.alias("leaf"), F.when(tampered(F.col("doc_id")), other).otherwise(own).alias("claimed"))
    return manifest(rows, "doc_id", "lang", deep)
