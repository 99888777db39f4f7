"""Templated (written, spoken) pairs, leakage-free splits and their records.

Every draw is integer arithmetic on ``(seed, id, slot)``: the same ids give the
same pairs on any cluster, whatever the partitioning. The ids come from a
table; one pair per id is built in a single projection, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import let, lookup, squash, strip
from ..functions.readings import (
    ABBREVIATIONS,
    CARDINAL,
    LITERAL,
    ORDINAL,
    decimal_parts,
    electronic_parts,
    fraction_parts,
    measure_parts,
    money_parts,
    part,
    speak,
    telephone_parts,
    time_parts,
    year_parts,
)
from ..functions.words import to_roman, word_list
from .prefix import durable, number_rows

# Vocabulary.
NAMES = [
    "Adams", "Bennett", "Clarke", "Dawson", "Ellis", "Foster", "Grant", "Hughes", "Irwin", "Jensen",
    "Keller", "Lawson", "Mercer", "Newton", "Owens", "Porter", "Quinn", "Reeves", "Sutton", "Turner",
    "Vance", "Walsh", "Mary", "Peter", "John", "Anne", "Paul", "James",
]
STREETS = [
    "Elm", "Baker", "Maple", "Oak", "Pine", "Cedar", "Park", "Church", "Market", "King", "Queen",
    "River", "Hill", "Lake",
]
STREET_SUFFIXES = {
    "St": "Street", "Dr": "Drive", "Ln": "Lane", "Ave": "Avenue", "Rd": "Road", "Blvd": "Boulevard",
}
TITLES = {"Dr": "Doctor", "Mr": "Mister", "Mrs": "Missus", "Prof": "Professor", "St": "Saint"}
MONTHS = [
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
    "November", "December",
]
REGNAL = ["Henry", "Louis", "George", "Edward", "William", "Charles", "Richard", "Elizabeth", "Catherine"]
UNCOVERED = ["Episode", "Grade", "Level", "Type", "Mark", "Form", "Phase", "Series", "Edition"]
DECADES = ["1820", "1900", "1910", "1920", "1930", "1940", "1950", "1960", "1970", "1980", "1990", "2000", "2010"]
MEASURE_UNITS = ["km", "kg", "cm", "mm", "ml", "GB", "MB", "mph", "kW", "%", "ft", "mi", "oz"]
DENOMINATORS = ["2", "3", "4", "5", "6", "8", "10"]
MINUTES = ["0", "0", "5", "15", "30", "45"]
HOSTS = ["example", "books", "audio", "openlib", "readit"]
HOST_DOMAINS = ["com", "org", "net", "io"]
MAILBOXES = ["info", "hello", "contact"]
ABBREVIATION_KEYS = ["Mr", "Mrs", "Prof", "etc", "vs", "Inc", "Ltd", "Dept", "Ave"]
PLAIN = [
    "The morning light fell softly across the quiet valley.",
    "She closed the book and listened to the rain outside.",
    "He had never seen the harbor so calm before.",
    "They spoke of old friends and distant summers.",
    "A gentle wind carried the scent of pine through the camp.",
    "Nothing about the letter seemed unusual at first.",
]
# Carrier sentences, {X} marks the place.
GENERIC = [
    "The total came to {X} in the end.",
    "She said {X} would be enough for now.",
    "He counted {X} before he left the room.",
    "According to the ledger, {X} remained.",
    "They reported {X} without any comment.",
    "Only {X} could be found on the shelf.",
    "The manuscript clearly states {X}.",
    "We settled on {X} after the meeting.",
    "It was {X}, give or take.",
    "Everyone agreed that {X} was fair.",
]
COUNTS = [
    "{X} people attended the rally that evening.",
    "There were {X} votes counted by midnight.",
    "The warehouse held {X} crates in total.",
    "More than {X} readers signed the petition.",
    "A crowd of {X} gathered outside the hall.",
]
YEARS = [
    "In {X}, everything began to change.",
    "By {X} the project was complete.",
    "The treaty was signed in {X}.",
    "She was born in {X} near the coast.",
]
TIMES = [
    "We arrived at {X} sharp.",
    "The train departs at {X} every day.",
    "Dinner is served at {X} in the hall.",
]
DATES = ["The letter was dated {X}.", "On {X} the festival opened.", "Their anniversary falls on {X}."]

PRIME = 2_147_483_647
SEED = 42
HARD_SHIFT = 999


def draw_sql(id_col: str, slot: int, size: int | str, seed: int) -> str:
    """SQL text of a draw from 0 to ``size`` - 1.

    The quotient of the id goes in after the square: added before it, it would only
    move one id's draws to another id. No two ids below 2**62 share all their draws.
    """
    first = slot * 69_621 + seed * 16_807 + 1
    low = f"pmod({id_col}, {PRIME}L)"
    high = f"(pmod(({id_col} - {low}) div {PRIME}L, {PRIME}L) * 40692L % {PRIME}L)"
    mixed = f"(({low} * 48271L + {first}L) % {PRIME}L)"
    return f"(shiftright((({mixed} * {mixed} + {slot + 1}L + {high}) % {PRIME}L) * 16807L % {PRIME}L, 3) % ({size}))"


@dataclass(frozen=True)
class Draws:
    """Draws for one id column and seed."""

    id_col: str
    seed: int

    def below(self, slot: int, size: int | str) -> Column:
        return F.expr(draw_sql(self.id_col, slot, size, self.seed))

    def between(self, slot: int, low: int, high: int) -> Column:
        return self.below(slot, high - low + 1) + low

    def chance(self, slot: int, percent: int) -> Column:
        return self.below(slot, 100) < percent

    def pick(self, slot: int, options: list[str]) -> Column:
        return F.element_at(word_list(options), (self.below(slot, len(options)) + 1).cast("int"))


CARRIER, BARE = 90, 91


def _made(carrier: Column, written: Column, parts: Column, plural: bool = False) -> Column:
    return F.struct(
        carrier.alias("carrier"), written.alias("written"), parts.alias("parts"), F.lit(plural).alias("plural")
    )


def _text(n: Column) -> Column:
    return n.cast("string")


def _bare_or(d: Draws, percent: int, carriers: list[str]) -> Column:
    return F.when(d.chance(BARE, percent), "{X}").otherwise(d.pick(CARRIER, carriers))


def _grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def plain(d: Draws) -> Column:
    sentence = d.pick(1, PLAIN)
    return _made(F.lit("{X}"), sentence, F.array(part(LITERAL, sentence)))


def cardinals(d: Draws) -> Column:
    band = d.below(1, 4)
    n = (
        F.when(band == 0, d.between(2, 0, 99))
        .when(band == 1, d.between(2, 100, 999))
        .when(band == 2, d.between(2, 1000, 99_999))
        .otherwise(d.between(2, 100_000, 9_999_999))
    )
    written = F.when((n >= 1000) & d.chance(3, 60), _grouped(n)).otherwise(_text(n))
    return _made(_bare_or(d, 25, GENERIC), written, F.array(part(CARDINAL, _text(n))))


def counts(d: Draws) -> Column:
    n = _text(d.between(1, 1500, 2099))
    return _made(d.pick(CARRIER, COUNTS), n, F.array(part(CARDINAL, n)))


def years(d: Draws) -> Column:
    n = _text(d.between(1, 1500, 2025))
    return _made(d.pick(CARRIER, YEARS), n, year_parts(n))


def decades(d: Draws) -> Column:
    first = d.pick(1, DECADES)
    return _made(d.pick(CARRIER, GENERIC), F.concat(first, F.lit("s")), year_parts(first), plural=True)


def ordinals(d: Draws) -> Column:
    n = d.between(1, 1, 120)
    suffix = (
        F.when((n % 100).isin(11, 12, 13), "th")
        .when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd")
        .otherwise("th")
    )
    return _made(_bare_or(d, 25, GENERIC), F.concat(_text(n), suffix), F.array(part(ORDINAL, _text(n))))


def decimals(d: Draws) -> Column:
    places = (d.below(1, 3) + 1).cast("int")
    tail = F.rtrim(F.substring(F.lpad(_text(d.below(3, 1000)), 3, "0"), 1, 3).substr(F.lit(1), places), F.lit("0"))
    written = F.concat(_text(d.below(2, 999)), F.lit("."), F.when(tail == "", "0").otherwise(tail))
    return _made(d.pick(CARRIER, GENERIC), written, decimal_parts(written))


def moneys(d: Draws) -> Column:
    tenths = d.between(2, 10, 100)
    short = F.concat(
        F.lit("$"), _text(F.floor(tenths / 10)), F.lit("."), _text(tenths % 10), d.pick(3, ["M", "B", "k"])
    )
    cents = F.when(d.below(5, 2) == 0, "").otherwise(F.concat(F.lit("."), F.lpad(_text(d.below(6, 100)), 2, "0")))
    full = F.concat(F.lit("$"), _grouped(d.between(4, 1, 999_999)), cents)
    written = F.when(d.chance(1, 40), short).otherwise(full)
    return _made(d.pick(CARRIER, GENERIC), written, money_parts(written))


def measures(d: Draws) -> Column:
    tenths = d.between(3, 1, 999)
    number = F.when(d.below(2, 2) == 0, _text(d.between(3, 1, 999))).otherwise(
        F.concat(_text(F.floor(tenths / 10)), F.lit("."), _text(tenths % 10))
    )
    written = F.concat(number, F.when(d.below(4, 2) == 0, "").otherwise(" "), d.pick(1, MEASURE_UNITS))
    return _made(_bare_or(d, 30, GENERIC), written, measure_parts(written))


def times(d: Draws) -> Column:
    at = d.below(2, len(MINUTES) + 1)
    minute = F.when(at < len(MINUTES), F.element_at(word_list(MINUTES), F.least(at, F.lit(len(MINUTES) - 1)).cast("int") + 1)).otherwise(
        _text(d.between(3, 1, 59))
    )
    half = d.below(4, 3)
    written = F.concat(
        _text(d.between(1, 1, 12)), F.lit(":"), F.lpad(minute, 2, "0"),
        F.when(half == 0, "").when(half == 1, " AM").otherwise(" PM"),
    )
    return _made(d.pick(CARRIER, TIMES), written, time_parts(written))


def fractions(d: Draws) -> Column:
    below = d.pick(1, DENOMINATORS)
    top = d.below(2, 2520) % (below.cast("bigint") - 1) + 1
    written = F.concat(_text(top), F.lit("/"), below)
    return _made(d.pick(CARRIER, GENERIC), written, fraction_parts(written))


def telephones(d: Draws) -> Column:
    area, line = _text(d.between(1, 200, 999)), _text(d.between(2, 200, 999))
    last = F.lpad(_text(d.below(3, 10_000)), 4, "0")
    written = F.when(d.below(4, 2) == 0, F.concat_ws("-", area, line, last)).otherwise(
        F.concat(F.lit("("), area, F.lit(") "), line, F.lit("-"), last)
    )
    return _made(d.pick(CARRIER, GENERIC), written, telephone_parts(written))


def electronics(d: Draws) -> Column:
    host = F.concat(d.pick(1, HOSTS), F.lit("."), d.pick(2, HOST_DOMAINS))
    written = F.when(d.below(3, 2) == 0, F.concat(F.lit("www."), host)).otherwise(
        F.concat(d.pick(4, MAILBOXES), F.lit("@"), host)
    )
    return _made(d.pick(CARRIER, GENERIC), written, electronic_parts(written))


def dates(d: Draws) -> Column:
    month, day, year = d.pick(1, MONTHS), _text(d.between(2, 1, 28)), _text(d.between(3, 1700, 2025))
    parts = F.concat(F.array(part(LITERAL, month), part(ORDINAL, day), part(LITERAL, ",")), year_parts(year))
    return _made(d.pick(CARRIER, DATES), F.concat(month, F.lit(" "), day, F.lit(", "), year), parts)


def ambiguous_streets(d: Draws) -> Column:
    title, suffix = d.pick(1, list(TITLES)), d.pick(5, list(STREET_SUFFIXES))
    name, street = d.pick(2, NAMES), d.pick(4, STREETS)
    number = _text(d.between(3, 2, 990))
    written = F.concat(
        title, F.lit(". "), name, F.lit(" lived at "), number, F.lit(" "), street, F.lit(" "), suffix, F.lit(".")
    )
    parts = F.array(
        part(LITERAL, F.concat(lookup(TITLES, title), F.lit(" "), name, F.lit(" lived at"))),
        part(CARDINAL, number),
        part(LITERAL, F.concat(street, F.lit(" "), lookup(STREET_SUFFIXES, suffix), F.lit("."))),
    )
    return _made(F.lit("{X}"), written, parts)


def regnal_numerals(d: Draws) -> Column:
    name, n = d.pick(1, REGNAL), d.between(2, 1, 20)
    parts = F.array(part(LITERAL, name), part(LITERAL, "the"), part(ORDINAL, _text(n)))
    return _made(d.pick(CARRIER, GENERIC), F.concat(name, F.lit(" "), to_roman(n)), parts)


def uncovered_numerals(d: Draws) -> Column:
    name, n = d.pick(1, UNCOVERED), d.between(2, 1, 12)
    parts = F.array(part(LITERAL, name), part(CARDINAL, _text(n)))
    return _made(d.pick(CARRIER, GENERIC), F.concat(name, F.lit(" "), to_roman(n)), parts)


def abbreviations(d: Draws) -> Column:
    key, name = d.pick(1, ABBREVIATION_KEYS), d.pick(2, NAMES)
    tail = F.concat(F.lit(" "), name, F.lit(" agreed to the terms."))
    spoken = F.concat(lookup(ABBREVIATIONS, F.lower(key)), tail)
    return _made(F.lit("{X}"), F.concat(key, F.lit("."), tail), F.array(part(LITERAL, spoken)))


def mixed(d: Draws) -> Column:
    n, share = _text(d.between(1, 2, 99)), _text(d.between(2, 1, 99))
    parts = F.array(
        part(LITERAL, "About"), part(CARDINAL, n), part(LITERAL, "of the"), part(CARDINAL, share),
        part(LITERAL, "percent surveyed agreed."),
    )
    return _made(
        F.lit("{X}"), F.concat(F.lit("About "), n, F.lit(" of the "), share, F.lit("% surveyed agreed.")), parts
    )


# Builder, relative weight, labels, hard. Weights need not add up to 100.
BUILDERS = {
    "plain": (plain, 6, ["PLAIN"], False),
    "cardinal": (cardinals, 12, ["CARDINAL"], False),
    "count_in_year_range": (counts, 6, ["CARDINAL"], True),
    "year": (years, 6, ["DATE"], False),
    "decade": (decades, 5, ["DATE"], True),
    "ordinal": (ordinals, 7, ["ORDINAL"], False),
    "decimal": (decimals, 5, ["DECIMAL"], False),
    "money": (moneys, 8, ["MONEY"], False),
    "measure": (measures, 8, ["MEASURE"], False),
    "time": (times, 6, ["TIME"], False),
    "fraction": (fractions, 5, ["FRACTION"], False),
    "telephone": (telephones, 4, ["TELEPHONE"], False),
    "electronic": (electronics, 4, ["ELECTRONIC"], False),
    "date": (dates, 6, ["DATE"], True),
    "ambiguous_street": (ambiguous_streets, 6, ["ABBREV"], True),
    "regnal_roman": (regnal_numerals, 2, ["ROMAN"], False),
    "uncovered_roman": (uncovered_numerals, 2, ["ROMAN"], True),
    "abbreviation": (abbreviations, 3, ["ABBREV"], False),
    "mixed": (mixed, 2, ["CARDINAL", "MEASURE"], False),
}
HARD_BUILDERS = [name for name, spec in BUILDERS.items() if spec[3]]


def _fill(made: Column) -> Column:
    """Put written and spoken form into the carrier."""
    words = let(
        speak(made["parts"]),
        lambda w: F.when(~made["plural"], F.replace(w, F.lit(" ,"), F.lit(",")))
        .when(F.endswith(w, F.lit("y")), F.regexp_replace(w, "y$", "ies"))
        .otherwise(F.concat(w, F.lit("s"))),
    )
    return F.struct(
        F.replace(made["carrier"], F.lit("{X}"), made["written"]).alias("before"),
        squash(F.replace(made["carrier"], F.lit("{X}"), words)).alias("after"),
    )


def build_pairs(ids: DataFrame, builder: str, id_col: str = "id", seed: int = SEED) -> DataFrame:
    """One pair per id from a single builder."""
    make, _, labels, hard = BUILDERS[builder]
    made = let(make(Draws(id_col, seed)), _fill)
    return ids.select(F.col(id_col).alias("pair_id"), made.alias("pair")).select(
        "pair_id",
        "pair.before",
        "pair.after",
        F.array(*[F.lit(c) for c in labels]).alias("classes"),
        F.lit(hard).alias("hard"),
    )


def draw_pairs(ids: DataFrame, id_col: str = "id", seed: int = SEED, hard_only: bool = False) -> DataFrame:
    """One pair per id, the builder drawn by weight (equal weights for the hard ones)."""
    names = HARD_BUILDERS if hard_only else list(BUILDERS)
    weights = [1 if hard_only else BUILDERS[n][1] for n in names]
    d = Draws(id_col, seed + HARD_SHIFT if hard_only else seed)
    rows = ids.select(F.col(id_col), d.below(0, sum(weights)).alias("_ticket"))
    made, labels, hard, bound = None, None, None, 0
    for name, weight in zip(names, weights):
        bound += weight
        make, _, classes, is_hard = BUILDERS[name]
        cond = F.col("_ticket") < bound
        cells = (make(d), F.array(*[F.lit(c) for c in classes]), F.lit(is_hard))
        if made is None:
            made, labels, hard = (F.when(cond, c) for c in cells)
        else:
            made, labels, hard = (w.when(cond, c) for w, c in zip((made, labels, hard), cells))
    return rows.select(
        F.col(id_col).alias("pair_id"), let(made, _fill).alias("pair"), labels.alias("classes"), hard.alias("hard")
    ).select("pair_id", "pair.before", "pair.after", "classes", "hard")


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Each (before, after) once, from its smallest id; combined before the shuffle."""
    first = F.min(F.struct("pair_id", "classes", "hard")).alias("first")
    return pairs.groupBy("before", "after").agg(first).select(
        "first.pair_id", "before", "after", "first.classes", "first.hard"
    )


def generate_pairs(
    ids: DataFrame, n: int | None = None, id_col: str = "id", seed: int = SEED, hard_only: bool = False
) -> DataFrame:
    """Distinct pairs from the ids, the first ``n`` of them by id if a size is given."""
    pairs = distinct_pairs(draw_pairs(ids, id_col, seed, hard_only))
    # Each task keeps its first n rows, so no more than n a task are moved.
    return pairs if n is None else pairs.orderBy("pair_id").limit(n)


def shuffle_key(id_col: str, seed: int) -> Column:
    """Key of a seeded permutation."""
    return F.expr(draw_sql(id_col, 99, PRIME, seed))


def shuffled(pairs: DataFrame, seed: int = SEED, out: str = "place") -> DataFrame:
    """Number the rows from 1 in seeded order, by ranges whose number follows the session's partitions."""
    keyed = pairs.withColumn("_key", shuffle_key("pair_id", seed))
    return number_rows(keyed, ["_key", "pair_id"], out).drop("_key")


def without_leaks(rows: DataFrame, train: DataFrame, key: str = "before") -> DataFrame:
    """Rows whose input does not occur among the training inputs; digests meet, not texts."""
    digest = F.sha2(F.col(key).cast("string").cast("binary"), 256).alias("_digest")
    return rows.withColumn("_digest", digest).join(train.select(digest).distinct(), "_digest", "left_anti").drop("_digest")


def build_splits(
    pool: DataFrame, hard: DataFrame, n_train: int, n_val: int, seed: int = SEED, real: DataFrame | None = None
) -> DataFrame:
    """train, val, test and hard rows in one table, free of training inputs outside train.

    The placed pool feeds three branches, so it is written once.
    """
    placed = durable(shuffled(pool, seed))
    cols = ["pair_id", "before", "after", "classes", "hard"]
    split = (
        F.when(F.col("place") <= n_train, "train").when(F.col("place") <= n_train + n_val, "val").otherwise("test")
    )
    rows = placed.withColumn("split", split).select(*cols, "split")
    train = rows.filter(F.col("split") == "train")
    if real is not None:
        train = train.unionByName(real.withColumn("split", F.lit("train")).select(*cols, "split"))
    held = rows.filter(F.col("split") != "train").unionByName(
        hard.withColumn("split", F.lit("hard")).select(*cols, "split")
    )
    return train.unionByName(without_leaks(held, train).select(*cols, "split"))


def leakage(splits: DataFrame) -> DataFrame:
    """Number of held-out inputs that also occur in train, in one pass; 0 after ``without_leaks``."""
    digest = F.sha2(F.col("before").cast("binary"), 256).alias("_digest")
    trained = F.col("split") == "train"
    per = splits.groupBy(digest).agg(F.max(trained).alias("_trained"), F.count_if(~trained).alias("_held"))
    return per.agg(F.coalesce(F.sum(F.when(F.col("_trained"), F.col("_held"))), F.lit(0)).alias("n_leaks"))


def load_pairs(df: DataFrame, before: str, after: str, key: str, limit: int | None = None) -> DataFrame:
    """An external pair table: trimmed, both sides filled, labelled REAL."""
    rows = df if limit is None else df.orderBy(key).limit(limit)
    cleaned = rows.select(
        F.col(key).alias("pair_id"),
        strip(F.col(before).cast("string")).alias("before"),
        strip(F.col(after).cast("string")).alias("after"),
        F.array(F.lit("REAL")).alias("classes"),
        F.lit(False).alias("hard"),
    )
    return cleaned.filter((F.col("before") != "") & (F.col("after") != ""))


def signature(spark: SparkSession, n_train: int, n_val: int, n_test: int, n_hard: int, seed: int = SEED, real: str = "") -> DataFrame:
    """One row that records how splits were made."""
    return spark.range(1).select(
        F.lit("synthetic+real" if real else "synthetic").alias("source"),
        F.lit(real or None).cast("string").alias("real"),
        F.lit(n_train).alias("train"), F.lit(n_val).alias("val"), F.lit(n_test).alias("test"),
        F.lit(n_hard).alias("hard"), F.lit(seed).alias("seed"),
    )


def cycle(ids: DataFrame, sentences: list[str], id_col: str = "id") -> DataFrame:
    """Repeat a short sentence list over all ids."""
    at = (F.pmod(F.col(id_col), F.lit(len(sentences))) + 1).cast("int")
    return ids.select(F.col(id_col), F.element_at(F.array(*[F.lit(s) for s in sentences]), at).alias("text"))
