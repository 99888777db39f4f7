"""One of each set of near copies, by the Jaccard similarity of distinct word shingles.

Candidates come from the fingerprints of ``simhash`` first: each text of a group
whose fingerprints hang together is compared with the group's first one. Fingerprints
reach few of the pairs at 0.8, so texts that share a band are candidates as well:
the minima of ``ROWS`` seeded hashes over a text's
shingles, for ``BANDS`` independent groups of seeds. Two texts of similarity J
share one with probability 1 - (1 - J^ROWS)^BANDS, which is 0.9998 at 0.8. A
candidate of either kind is only dropped after its shingles were compared, all of
them, with those of the text that it would be dropped for.

Texts are taken in the order of the hash of their words: one stays unless one before it
that stays is similar to it. So nothing is dropped over a chain of links, and
what stays is not similar among itself. A round compares every unsettled text with
the first few texts of its keys, one in the first round and four times as many in each
further one, so groups of copies collapse onto their first texts before
keys are compared in depth; no pair is compared twice. Settled are texts whose
earlier key mates were all compared and none of them is similar and unsettled,
and what is similar to them. The order is random, so the number of rounds grows
with the logarithm of the largest key. Every round is written to the shared folder.

Bands are the keys of the first round. What it leaves unsettled is keyed anew, by its rarest
shingles: shingles are ordered by how many of these texts hold them, and two
texts that share enough of them for the similarity share one among the first few of
each (``rarest_keys``). Variants of one text nearly all hold even the rarest of its shingles;
so texts are put in families by a common base, and those of one family are keyed
by their rarest differences from it instead (``family_keys``). Texts that resemble each other but
not enough seldom meet, and no similar pair is lost. A pair is joined once per key, not once a round.

Texts of equal words are one unit from the start, so copies cost nothing.
Words are separated by blanks and compared without the case of ASCII letters; a
text with fewer words than a shingle is one shingle; all texts without words
(null and empty ones included) are copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, in_few_parts, steps, stored

SEED = 42
BANDS, ROWS = 28, 6
#: Shingles whose hashes are taken under all seeds together.
STEP_SHINGLES = 32_768
#: A class of ``_first_keys`` is this many powers of two narrower than a set is large; what rounding may cost a bound.
CLASS_BITS, EPS = 5, 1e-6
_RNG = np.random.default_rng(SEED)
_FLIP = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False)
_TIMES = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Hash of every shingle in its order, with repeats."""
    k = min(shingle, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begin = np.r_[0, ends[:-1]][: len(words) - k + 1].tolist()
    stop = (ends[k - 1 :] - 1).tolist()
    hash_ = xxhash.xxh64_intdigest
    return np.array([hash_(joined[a:b], SEED) for a, b in zip(begin, stop, strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Fingerprint of a text: the bits set in over half of its shingle hashes."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def band_keys(hashes: list[np.ndarray]) -> np.ndarray:
    """Keys (texts x BANDS) of texts that have shingles."""
    least = np.full((len(hashes), BANDS * ROWS), ~np.uint64(0))
    at = 0
    while at < len(hashes):
        end, size = at + 1, len(hashes[at])
        while end < len(hashes) and size + len(hashes[end]) <= STEP_SHINGLES:
            size += len(hashes[end])
            end += 1
        all_ = np.concatenate(hashes[at:end])
        first = np.r_[0, np.cumsum([len(h) for h in hashes[at : end - 1]], dtype=np.int64)].astype(np.int64)
        for i in range(BANDS * ROWS):
            least[at:end, i] = np.minimum.reduceat((all_ ^ _FLIP[i]) * _TIMES[i], first)
        at = end
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX, (len(hashes), 1))
    for i in range(ROWS):
        key = (key ^ least[:, i::ROWS]) * _MIX
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def sketch(text: Column, shingle: int) -> Column:
    """Struct of ``unit``, a 128-bit hash of the words, ``bits``, their fingerprint, and ``keys``, the bands."""

    @F.pandas_udf("unit binary, bits long, keys array<long>")
    def make(texts: pd.Series) -> pd.DataFrame:
        units, bits, keys = [], [], []
        for _, run in steps(texts):
            words = [data.lower().split() for data in run]
            units += [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]
            full = [i for i, w in enumerate(words) if w]
            own: list[np.ndarray] = [np.zeros(0, np.int64)] * len(run)
            hashes = [shingle_hashes(words[i], shingle) for i in full]
            prints = np.zeros(len(run), np.uint64)
            for i, h, k in zip(full, hashes, band_keys(hashes), strict=True):
                prints[i], own[i] = majority(h), k
            bits += prints.view(np.int64).tolist()
            keys += own
        return pd.DataFrame({"unit": units, "bits": bits, "keys": keys})

    return make(text)


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(unit, set): the distinct shingle hashes of ``texts`` (unit, text), a run of texts at a time."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, run in steps(batch["text"]):
                found = [np.unique(shingle_hashes(data.lower().split(), shingle)).view(np.int64) for data in run]
                yield pd.DataFrame({"unit": batch["unit"].iloc[at : at + len(run)].to_numpy(), "set": found})

    return texts.select("unit", "text").mapInPandas(make, "unit binary, set array<long>")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets, computed row by row in the engine; none of two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _leads(members: DataFrame, most: int) -> DataFrame:
    """(key, lead, rank) of the first ``most`` units of every key and the one after them; the rank limit runs before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy("unit"))
    return members.withColumn("rank", rank).filter(F.col("rank") <= most + 1).select("key", F.col("unit").alias("lead"), "rank", "led", F.col("apart").alias("lead_apart"))


def _hanging(units: DataFrame, roots: DataFrame) -> DataFrame:
    """(unit, lead) of every unit and the first one whose fingerprint hangs together with its own (bits, root)."""
    rooted = units.select("unit", "bits").join(roots.select("bits", "root"), "bits", "left").select("unit", F.coalesce("root", "bits").alias("root"))
    first = rooted.groupBy("root").agg(F.min("unit").alias("lead"))
    return rooted.join(first, "root").filter("lead < unit").select("unit", "lead")


def _marked(members: DataFrame, leads: DataFrame, most: int) -> DataFrame:
    """Members, ``led`` where all that seek the key have met the unit; it stays among the first of the key."""
    met = leads.filter((F.col("rank") <= most) & ~F.col("led")).select("key", F.col("lead").alias("unit"), F.lit(True).alias("now"))
    return members.join(met, ["key", "unit"], "left").withColumn("led", F.col("led") | F.coalesce("now", F.lit(False))).drop("now")


def _similar(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(unit, lead, near) of pairs, by all of their shingles."""
    other = sets.select(F.col("unit").alias("lead"), F.col("set").alias("lead_set"))
    return pairs.join(other, "lead").join(sets, "unit").select("unit", "lead", (jaccard(F.col("set"), F.col("lead_set")) >= similar).alias("near"))


def _compared(members: DataFrame, leads: DataFrame, most: int, sets: DataFrame, known: DataFrame, similar: float) -> DataFrame:
    """(unit, lead, near) of the pairs of a unit and an earlier one of those it seeks that were not compared before."""
    led = leads.filter((F.col("rank") <= most) & ~F.col("led")).select(F.col("key").alias("seeks"), "lead", "lead_apart")
    pairs = members.join(led, "seeks").filter("lead < unit AND coalesce(apart <> lead_apart, true)").select("unit", "lead").distinct()
    return _similar(pairs.join(known, ["unit", "lead"], "left_anti"), sets, similar)


def _settled(members: DataFrame, leads: DataFrame, most: int, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unit) of the members that stay, and of those that are similar to one of them."""
    own = members.select("unit").distinct()
    # Behind the first one that is no lead, a unit has not met all the earlier ones that it seeks.
    beyond = leads.filter(F.col("rank") > most).select(F.col("key").alias("seeks"), F.col("lead").alias("bound"))
    first = own.join(members.join(beyond, "seeks").filter("unit > bound").select("unit"), "unit", "left_anti")
    links = known.filter("near").join(own, "unit", "left_semi")
    links = links.join(own.select(F.col("unit").alias("lead")), "lead", "left_semi")
    stay = stored(first.join(links, "unit", "left_anti"), "stay")
    gone = stored(links.join(stay.select(F.col("unit").alias("lead")), "lead", "left_semi").select("unit").distinct(), "gone")
    return stay, gone


def _first_keys(rows: DataFrame, similar: float) -> DataFrame:
    """(unit, key, seeks, apart) of rows (unit, n, family, apart, set): of any two units at least this similar, one seeks a key of the other.

    ``set`` has what tells a unit of n shingles from the base of its family: shingles that one of the two has and the
    other lacks; against no base, all of its shingles. Only units of a family meet, and of these only those that are ``apart``
    or have null there. Two sets with d and e such differences share at least (r + s) / 2 of them, where r is
    d - q * n, s is e - q * m and q is (1 - similar) / (1 + similar); call it c. In any order of all differences the first
    that they share is then among the first d - c + 1 of the one and e - c + 1 of the other; if c is not positive,
    all differences and one more key for nothing at all do. Rare differences come first here. As c depends on both units,
    r is put in classes, of a width that depends on the power of two below n, and a unit has keys for every
    class that a partner can be in and that holds a unit with the difference, with c for the least r of the class. A key names
    the unit's class and the partner's; sought is the key with the two exchanged. The result is stored.
    """
    q = (1 - similar) / (1 + similar)
    n = F.col("n").cast("double")
    r = F.size("set") - q * n
    held = rows.select("unit", "n", "family", "apart", r.alias("r"), F.explode_outer("set").alias("h"))
    rare = held.groupBy("family", "h").agg(F.count(F.lit(1)).alias("df"), F.min("apart").alias("some"), F.max("apart").alias("other"))
    rare = rare.filter("df > 1 AND (some IS NULL OR some <> other)").select("family", "h", "df")
    entry = F.when(F.col("df").isNotNull(), F.struct("df", "h"))
    shared = held.join(rare, ["family", "h"], "left").groupBy("unit", "n", "family", "apart", "r").agg(F.array_sort(F.collect_list(entry)).alias("shared"))

    def power(of: Column) -> Column:
        return F.floor(F.log2(of)).cast("int")

    def width(exponent: Column) -> Column:
        return F.pow(F.lit(2.0), F.greatest(exponent - CLASS_BITS, F.lit(0)))

    own = F.floor(F.col("r") / width(F.col("own_power"))).cast("int")
    nothing = F.array(F.struct(F.lit(0).cast("long").alias("df"), F.lit(0).cast("long").alias("h")))
    # No class that a partner can be in begins below this, so none asks for more differences.
    least = F.col("r") - 2 * q * n / similar - EPS - width(power(n / similar + EPS))
    # Differences of no other unit come before all others and need no key.
    longest = (F.size("shared") + 1 - F.greatest(F.ceil((F.col("r") + least) / 2 - EPS), F.lit(0))).cast("int")
    each = shared.withColumn("longest", longest).filter("longest > 0").withColumn("own_power", power(n))
    entries = F.posexplode(F.slice(F.concat("shared", nothing), F.lit(1), F.col("longest"))).alias("place", "s")
    first = each.select("unit", "n", "family", "apart", "r", F.size("shared").alias("size"), "own_power", own.alias("own"), entries)
    first = stored(first.select("*", "s.df", "s.h").drop("s"), "first", few=False)

    met = F.col("apart").isNull() | (F.col("some") != F.col("apart")) | (F.col("last") != F.col("apart"))
    count = F.count(F.lit(1)).alias("there"), F.min("apart").alias("some"), F.max("apart").alias("last")
    # Classes are taken from the units that have the difference, never listed: a unit has few partners, but many classes.
    classes = first.groupBy("family", "df", "h", F.col("own_power").alias("other_power"), F.col("own").alias("other")).agg(*count)
    # A little wider on both sides, so that no rounding loses a class.
    near = F.col("other_power").between(power(n * similar - EPS), power(n / similar + EPS))
    lowest = F.floor((F.col("r") - 2 * q * n / similar - EPS) / width(F.col("other_power")))
    highest = F.floor((F.col("r") + 2 * q * n + EPS) / width(F.col("other_power")))
    common = F.ceil((F.col("r") + F.col("other") * width(F.col("other_power"))) / 2 - EPS)
    near = near & F.col("other").between(lowest, highest) & (F.col("place") <= F.col("size") - F.greatest(common, F.lit(0)))
    others = (F.col("own_power") != F.col("other_power")) | (F.col("own") != F.col("other")) | (F.col("there") > 1)
    key = F.xxhash64("family", "df", "h", "own_power", "own", "other_power", "other")
    seeks = F.xxhash64("family", "df", "h", "other_power", "other", "own_power", "own")
    keyed = first.join(classes, ["family", "df", "h"]).filter(near & others & met).select("unit", key.alias("key"), seeks.alias("seeks"), "apart")
    keyed = stored(keyed, "keyed")
    there = keyed.groupBy(F.col("key").alias("seeks")).agg(*count)
    sought = stored(keyed.join(there, "seeks").filter("key <> seeks OR there > 1").filter(met).select("unit", "key", "seeks", "apart"), "members")
    drop_stored(first)
    drop_stored(keyed)
    return sought


def rarest_keys(sets: DataFrame, similar: float) -> DataFrame:
    """(unit, key, seeks) by the rarest shingles of whole sets."""
    rows = sets.select("unit", F.size("set").alias("n"), F.lit(b"").alias("family"), F.lit(None).cast("binary").alias("apart"), "set")
    return _first_keys(rows, similar).select("unit", "key", "seeks")


def bases(known: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, base): of a unit and those that it was compared with, the one that most of ``units`` were compared with."""
    own = units.select("unit", F.col("unit").alias("lead"))
    pairs = known.join(units, "unit", "left_semi").select("unit", "lead").unionByName(own)
    followed = pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(followed, "lead").groupBy("unit").agg(F.max_by("lead", F.struct("n", "lead")).alias("base"))


def family_keys(sets: DataFrame, based: DataFrame, similar: float) -> DataFrame:
    """(unit, key, seeks, apart): units of one base (unit, base) meet by their differences from it, others by whole sets.

    Variants of one text share nearly all of it, so nearly all of them hold even its rarest shingles; where they
    differ from it they share little unless they are similar.
    """
    of = sets.select(F.col("unit").alias("base"), F.col("set").alias("base_set"))
    rows = sets.join(based, "unit").join(of, "base").withColumn("n", F.size("set"))
    differ = F.concat(F.array_except("set", "base_set"), F.array_except("base_set", "set"))
    inside = rows.select("unit", "n", F.col("base").alias("family"), F.lit(None).cast("binary").alias("apart"), differ.alias("set"))
    across = rows.select("unit", "n", F.lit(b"").alias("family"), F.col("base").alias("apart"), "set")
    return _first_keys(inside.unionByName(across), similar)


def _union(parts: list[DataFrame]) -> DataFrame | None:
    every = None
    for part in parts:
        every = part if every is None else every.unionByName(part)
    return every


def first_of_similar(docs: DataFrame, roots_of: Callable[[DataFrame], DataFrame], shingle: int = 5, similar: float = 0.8) -> DataFrame:
    """Drop, with all their columns, the documents similar to an earlier one that stays.

    ``roots_of`` gives distinct fingerprints (bits) the root of the component that
    they hang together in: (bits, root); those alone may be left out.

    Texts come in the order of the hash of their words. Of documents with equal words
    that with the smallest id (null ids last), then the smallest hash of the text,
    stands for all; of rows equal in both one is kept.
    """
    tie = F.xxhash64("text").alias("tie")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", tie).alias("first")
    made = docs.select(first, sketch(F.col("text"), shingle).alias("s"))
    units = stored(made.groupBy("s.unit").agg(F.min(F.struct("first", "s.keys", "s.bits")).alias("f")).select("unit", "f.first", "f.keys", "f.bits"), "units", few=False)
    hanging = stored(_hanging(units, roots_of(units.select("bits").distinct())), "hanging")
    members = units.select("unit", "first", F.explode(F.array_distinct("keys")).alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    members = stored(members.join(shared, "key", "left_semi"), "members")

    row = docs.select("doc_id", tie, "text")
    both = hanging.select(F.explode(F.array("unit", "lead")).alias("unit")).distinct()
    meeting = members.select("unit", "first").unionByName(units.join(both, "unit", "left_semi").select("unit", "first"))
    asked = meeting.select("unit", F.col("first.doc_id").alias("asked_id"), F.col("first.tie").alias("asked_tie")).distinct()
    texts = row.join(asked, row["doc_id"].eqNullSafe(asked["asked_id"]) & (row["tie"] == asked["asked_tie"]))
    sets = stored(shingle_sets(texts, shingle).dropDuplicates(["unit"]), "shingle-sets", few=False)
    known = stored(_similar(hanging, sets, similar), "compared")
    # What is similar to the first of its group shares one more band with it.
    star = known.filter("near").select(F.explode(F.array("unit", "lead")).alias("unit"), F.xxhash64("lead").alias("key")).distinct()
    both = stored(members.select("unit", "key").unionByName(star).withColumn("seeks", F.col("key")).withColumn("apart", F.lit(None).cast("binary")).withColumn("led", F.lit(False)), "members")
    drop_stored(members)
    members, dropped = both, []
    most = 1
    while not members.isEmpty():
        leads = stored(_leads(members, most), "leads")
        fresh = stored(_compared(members, leads, most, sets, known, similar), "compared")
        stay, gone = _settled(members, leads, most, known.unionByName(fresh))
        after = stored(_marked(members, leads, most).join(stay.unionByName(gone), "unit", "left_anti"), "members")
        if most == 1:
            # Only sets that can be asked for again are kept.
            based = stored(bases(known.unionByName(fresh), after.select("unit").distinct()), "bases")
            asked = based.select("unit").unionByName(based.select(F.col("base").alias("unit"))).distinct()
            fewer = stored(sets.join(asked, "unit", "left_semi"), "shingle-sets", few=False)
            bands, after = after, family_keys(fewer, based, similar).withColumn("led", F.lit(False))
            drop_stored(bands)
            drop_stored(based)
            drop_stored(sets)
            sets = fewer
        left = after.select("unit").distinct()
        both = known.unionByName(fresh).join(left, "unit", "left_semi").join(left.select(F.col("unit").alias("lead")), "lead", "left_semi")
        both = stored(both.select("unit", "lead", "near"), "compared")
        for old in (members, leads, stay, known, fresh):
            drop_stored(old)
        members, known, most = after, both, most * 4
        dropped.append(gone)
    drop_stored(known)
    drop_stored(members)
    drop_stored(sets)

    kept = units.select("unit", "first")
    if dropped:
        kept = kept.join(_union(dropped), "unit", "left_anti")
    kept = kept.select(F.col("first.doc_id").alias("first_id"), F.col("first.tie").alias("first_tie"))
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), tie)
    kept = row.join(kept, row["doc_id"].eqNullSafe(kept["first_id"]) & (row["tie"] == kept["first_tie"]), "left_semi")
    return in_few_parts(kept.dropDuplicates(["doc_id", "tie"]).select("row.*"))
