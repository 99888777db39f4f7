"""Benchmark decontamination by template windows, in DataFrame operations only.

A text becomes a sequence of tokens in which numbers, names and units are
typed placeholders, so a question with other numbers or people keeps its
template. Windows of the template are hashed and joined with those of the
benchmark. A hit counts if both windows hold the same template, enough of it is
literal, and the slots are consistent: two slots of the benchmark window are
equal exactly where the two slots of the document window are. A document
is contaminated by an item if enough of the item's windows are hit.

The documents are read twice: first only window hashes meet the benchmark, so
nothing wide is copied per window; then the few documents with a hit are
looked at with their slots. The benchmark's windows are broadcast only if their
counted rows are below ``broadcast_rows``; beyond, both joins are shuffled.

Tokens: runs of letters and digits; ``.`` and ``,`` between digits vanish;
``. ! ? :`` end a sentence. Number: begins with a digit. Unit: a listed word
after a number. Name: begins with a capital inside a sentence.

Defined cases: null and empty texts have no windows; a text shorter than a
window has none either; an item of ``least`` tokens or more but fewer than a
window is matched by a window of its own length, a shorter one never; items or
documents that repeat an id are judged together under it; empty tables give
empty results; other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_few_parts, stored

END = "\x01"
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
# Common units of measure, money and time.
UNITS = [
    "cm", "day", "days", "dollar", "dollars", "euro", "euros", "feet", "foot", "g", "gallon", "gallons", "gram", "grams", "hour", "hours",
    "inch", "inches", "kg", "kilogram", "kilograms", "kilometer", "kilometers", "km", "kmh", "lb", "lbs", "liter", "liters", "litre", "litres",
    "m", "meter", "meters", "metre", "metres", "mg", "mile", "miles", "minute", "minutes", "ml", "mm", "month", "months", "mph", "ounce",
    "ounces", "oz", "percent", "pound", "pounds", "second", "seconds", "ton", "tonne", "tonnes", "tons", "week", "weeks", "year", "years",
]
NUMBER_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen",
    "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred",
    "thousand", "million", "billion",
]


@dataclass(frozen=True)
class Windows:
    """How windows are cut and when a hit or a document counts."""

    size: int = 8
    least: int = 5
    literals: int = 4
    share: float = 0.25
    passage: int = 13


def tokens(text: Column) -> Column:
    """Letters-and-digits tokens, and a mark where a sentence ends."""
    joined = F.regexp_replace(text, "([0-9])[.,]([0-9])", "$1$2")
    marked = F.regexp_replace(joined, "[.!?:]+", f" {END} ")
    return F.filter(F.split(marked, rf"[^\p{{L}}\p{{N}}{END}]+"), lambda t: t != "")


def canonical(words: Column) -> Column:
    """Per token a struct (t, v): its template form and its value; sentence ends go."""
    first = lambda w: F.substring(w, 1, 1)
    digit = lambda w: first(w).between("0", "9")

    def kind(w: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(words, i - 1)).otherwise(F.lit(END))
        low = F.lower(w)
        form = (
            F.when(digit(w), NUM)
            .when(digit(before) & low.isin(UNITS), UNIT)
            .when((before != END) & (first(w) != first(low)), NAME)
            .otherwise(low)
        )
        return F.when(w != END, F.struct(form.alias("t"), low.alias("v")))

    return F.filter(F.transform(words, kind), lambda x: x.isNotNull())


def _with_templates(rows: DataFrame) -> DataFrame:
    """Adds ``c``: the canonical tokens."""
    return rows.withColumn("w", tokens(F.col("text"))).withColumn("c", canonical(F.col("w"))).drop("w", "text")


def _starts(n: Column, size: int | Column) -> Column:
    return F.when(n >= size, F.sequence(F.lit(1), n - size + 1))


def _all_sizes(sizes: list[int], name: str, make: Callable[[Column], Column]) -> Column:
    """``make`` of every window of each size over an array column, in one array."""

    def of(size: int) -> Column:
        n = F.size(name)
        return F.transform(F.coalesce(_starts(n, size), F.array().cast("array<int>")), lambda i: make(F.slice(name, i, size)))

    return F.concat(*map(of, sizes)) if len(sizes) > 1 else of(sizes[0])


def benchmark_windows(bench: DataFrame, rule: Windows) -> DataFrame:
    """(item_id, size, pos, key, c) of every window of the benchmark."""
    # Written first: a condition on the tokens would be computed from the text again for each of their uses.
    rows = stored(_with_templates(bench.select("item_id", "text")), "benchmark-tokens").filter(F.size("c") >= rule.least)
    size = F.least(F.size("c"), F.lit(rule.size))
    cut = F.transform(_starts(F.size("c"), size), lambda i: F.struct(i.alias("pos"), F.slice("c", i, size).alias("c")))
    out = rows.select("item_id", size.alias("size"), F.explode(cut).alias("win")).select("item_id", "size", "win.pos", "win.c")
    return out.withColumn("key", F.xxhash64(F.transform("c", lambda x: F.xxhash64(x["t"])))).filter(_literals(F.col("c")) >= rule.literals)


def _slot(x: Column) -> Column:
    return x["t"].isin(NUM, NAME, UNIT)


def _literals(c: Column) -> Column:
    return F.size(F.filter(c, lambda x: ~_slot(x)))


def _pattern(c: Column) -> Column:
    """For each slot the place of the first equal one; two windows with equal patterns map slot values one to one."""
    return F.transform(c, lambda x: F.when(_slot(x), F.array_position(c, x)).otherwise(F.lit(0)))


def contaminated(docs: DataFrame, bench: DataFrame, rule: Windows = Windows(), broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, tie, item_id, n_windows, n_matched, n_reworded): a row per document and item that leaked into it.

    ``tie`` is the hash of the text, which tells documents with one id apart;
    ``n_reworded`` counts matched windows that are met only with other slot values.
    """
    marks = stored(benchmark_windows(bench, rule), "benchmark-windows")
    small = marks.limit(broadcast_rows + 1).count() <= broadcast_rows
    side = F.broadcast if small else (lambda x: x)
    # Window lengths in use: rule.least to rule.size, so a few numbers.
    sizes = [r["size"] for r in marks.select("size").distinct().collect()] or [rule.size]
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")

    coded = _with_templates(rows).withColumn("h", F.transform("c", lambda x: F.xxhash64(x["t"]))).select("doc_id", "tie", "h")
    hashes = coded.select("doc_id", "tie", F.explode(_all_sizes(sizes, "h", F.xxhash64)).alias("key"))
    hit = hashes.join(side(marks.select("key").distinct()), "key", "left_semi").select("doc_id", "tie").distinct()
    hit = stored(hit, "window-hits").select(F.col("doc_id").alias("hit_id"), F.col("tie").alias("hit_tie"))

    few = rows.join(hit, rows["doc_id"].eqNullSafe(hit["hit_id"]) & (rows["tie"] == hit["hit_tie"]), "left_semi")
    # Rows equal in id and text repeat their hits, which are counted once per window below.
    coded = _with_templates(few)
    wide = coded.select("doc_id", "tie", F.explode(_all_sizes(sizes, "c", lambda d: F.struct(d.alias("d")))).alias("win")).select(
        "doc_id", "tie", "win.d", F.xxhash64(F.transform("win.d", lambda x: F.xxhash64(x["t"]))).alias("key")
    )
    met = wide.join(side(marks), "key").filter(
        (F.transform("c", lambda x: x["t"]) == F.transform("d", lambda x: x["t"])) & (_pattern(F.col("c")) == _pattern(F.col("d")))
    )
    by_window = met.groupBy("doc_id", "tie", "item_id", "size", "pos").agg(F.max((F.col("c") == F.col("d")).cast("int")).alias("exact"))
    found = by_window.groupBy("doc_id", "tie", "item_id").agg(F.count(F.lit(1)).alias("n_matched"), F.sum(1 - F.col("exact")).alias("n_reworded"))
    totals = marks.select("item_id", "size", "pos").distinct().groupBy("item_id").agg(F.count(F.lit(1)).alias("n_windows"))
    totals = totals.select(F.col("item_id").alias("total_id"), "n_windows")
    return (
        found.join(totals, F.col("item_id").eqNullSafe(F.col("total_id")))
        .filter(F.col("n_matched") >= rule.share * F.col("n_windows"))
        .select("doc_id", "tie", "item_id", "n_windows", "n_matched", "n_reworded")
        .transform(in_few_parts)
    )


def _forms(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``c`` with a second template ``o`` beside ``t`` that follows from the values alone, so casing and marks do not matter.

    In it number words are numbers, and a name is what the benchmark never writes in lower case. ``cap`` tells a capital.
    """
    number = lambda v: F.substring(v, 1, 1).between("0", "9") | v.isin(NUMBER_WORDS)
    first = lambda w: F.substring(w, 1, 1)
    capital = F.transform(F.filter("w", lambda w: w != END), lambda w: first(w) != first(F.lower(w)))
    marked = F.zip_with(canonical(F.col("w")), capital, lambda x, cap: F.struct(x["t"].alias("t"), x["v"].alias("v"), cap.alias("cap")))

    def form(x: Column, i: Column) -> Column:
        v = x["v"]
        before = F.when(i > 0, F.get("c", i - 1)["v"])
        other = F.when(number(v), NUM).when(number(before) & v.isin(UNITS), UNIT).when(v.isin(vocabulary), v).otherwise(NAME)
        return F.struct(x["t"].alias("t"), v.alias("v"), other.alias("o"), x["cap"].alias("cap"))

    rows = rows.withColumn("w", tokens(F.col("text"))).withColumn("c", marked)
    return rows.withColumn("c", F.transform("c", form)).drop("w", "text")


def _window_keys(c: Column) -> Column:
    key = lambda name: F.xxhash64(F.transform(c, lambda x: F.xxhash64(x[name])))
    return F.array_distinct(F.array(key("t"), key("o")))


def _same(c: Column, d: Column, literals: int) -> Column:
    """Equal values, or one of the templates equal with enough literals and slots that map one to one."""

    def by(name: str) -> Column:
        pick = lambda a: F.transform(a, lambda x: F.struct(x[name].alias("t"), x["v"].alias("v")))
        form = lambda a: F.transform(a, lambda x: x[name])
        return (form(c) == form(d)) & (_literals(pick(c)) >= literals) & (_pattern(pick(c)) == _pattern(pick(d)))

    values = lambda a: F.transform(a, lambda x: x["v"])
    return (values(c) == values(d)) | by("t") | (by("o") & F.forall(d, lambda x: (x["o"] != NAME) | x["cap"]))


def leaked(docs: DataFrame, bench: DataFrame, rule: Windows = Windows(), broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, tie): documents that a benchmark item leaked into, by a wider rule than ``contaminated``.

    Windows are compared by three readings: equal values, whatever casing, marks
    and number of literals; the template of ``contaminated``; and a template of
    values alone, see ``_forms``. A document counts if it holds ``rule.share`` of an
    item's windows, or of those with enough literals, or one passage of
    ``rule.passage`` tokens of it, however long the item is.

    The words that the benchmark writes in lower case reach the driver: its vocabulary.
    """
    w = bench.select(F.explode(tokens(F.col("text"))).alias("w"))
    small = (F.substring("w", 1, 1) == F.lower(F.substring("w", 1, 1))) & (F.col("w") != END)
    vocabulary = sorted(r["w"] for r in w.filter(small).select(F.lower("w").alias("w")).distinct().collect())

    items = stored(_forms(bench.select("item_id", "text"), vocabulary), "benchmark-tokens").filter(F.size("c") >= rule.least)
    size = F.least(F.size("c"), F.lit(rule.size))
    cut = lambda i, n: F.struct(i.alias("pos"), F.slice("c", i, n).alias("c"), F.slice("c", i, rule.passage).alias("passage"))
    marks = items.select("item_id", size.alias("size"), F.explode(F.transform(_starts(F.size("c"), size), lambda i: cut(i, size))).alias("win"))
    marks = marks.select("item_id", "size", "win.*", (_literals(F.col("win.c")) >= rule.literals).cast("int").alias("rich"))
    marks = stored(marks.select("*", F.explode(_window_keys(F.col("c"))).alias("key")), "benchmark-windows")
    side = F.broadcast if marks.limit(broadcast_rows + 1).count() <= broadcast_rows else (lambda x: x)
    sizes = [r["size"] for r in marks.select("size").distinct().collect()] or [rule.size]
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")

    codes = lambda name: F.transform("c", lambda x: F.xxhash64(x[name]))
    coded = _forms(rows, vocabulary).select("doc_id", "tie", codes("t").alias("h_t"), codes("o").alias("h_o"))
    hashes = coded.select("doc_id", "tie", F.explode(F.concat(*(_all_sizes(sizes, h, F.xxhash64) for h in ("h_t", "h_o")))).alias("key"))
    hit = hashes.join(side(marks.select("key").distinct()), "key", "left_semi").select("doc_id", "tie").distinct()
    hit = stored(hit, "window-hits").select(F.col("doc_id").alias("hit_id"), F.col("tie").alias("hit_tie"))

    few = _forms(rows.join(hit, rows["doc_id"].eqNullSafe(hit["hit_id"]) & (rows["tie"] == hit["hit_tie"]), "left_semi"), vocabulary)
    of = lambda n: F.transform(
        F.coalesce(_starts(F.size("c"), n), F.array().cast("array<int>")),
        lambda i: F.struct(F.slice("c", i, n).alias("d"), F.slice("c", i, rule.passage).alias("d_passage")),
    )
    wide = few.select("doc_id", "tie", F.explode(F.concat(*map(of, sizes))).alias("win")).select("doc_id", "tie", "win.*")
    wide = wide.select("*", F.explode(_window_keys(F.col("d"))).alias("key"))
    # A passage has literals for the same share of its tokens as a window.
    whole = (F.size("passage") == rule.passage) & (F.size("d_passage") == rule.passage)
    passage = whole & _same(F.col("passage"), F.col("d_passage"), -(-rule.passage * rule.literals // rule.size))
    met = wide.join(side(marks), "key").filter(_same(F.col("c"), F.col("d"), rule.literals) | passage)
    by_window = met.groupBy("doc_id", "tie", "item_id", "size", "pos").agg(F.max("rich").alias("rich"), F.max(passage.cast("int")).alias("passage"))
    found = by_window.groupBy("doc_id", "tie", "item_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rich").alias("n_rich"), F.max("passage").alias("passage")
    )
    totals = marks.select("item_id", "size", "pos", "rich").distinct().groupBy("item_id")
    totals = totals.agg(F.count(F.lit(1)).alias("all"), F.sum("rich").alias("all_rich")).withColumnRenamed("item_id", "total_id")
    enough = (F.col("n") >= rule.share * F.col("all")) | ((F.col("n_rich") > 0) & (F.col("n_rich") >= rule.share * F.col("all_rich")))
    held = found.join(totals, F.col("item_id").eqNullSafe(F.col("total_id"))).filter(enough | (F.col("passage") == 1))
    return held.select("doc_id", "tie").distinct()


def without_contaminated(docs: DataFrame, bench: DataFrame, rule: Windows = Windows()) -> DataFrame:
    """The documents, with their columns, that no benchmark item leaked into, see ``leaked``."""
    bad = stored(leaked(docs, bench, rule), "contaminated")
    bad = bad.select(F.col("doc_id").alias("bad_id"), F.col("tie").alias("bad_tie"))
    row = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("tie"))
    clean = row.join(bad, row["doc_id"].eqNullSafe(bad["bad_id"]) & (row["tie"] == bad["bad_tie"]), "left_anti")
    return clean.select("row.*")


_RULE = Windows()
_UNITS = ", ".join(f"'{u}'" for u in UNITS)
SQL = f"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
  SELECT side, id, list_filter(string_split_regex(
    regexp_replace(regexp_replace(text, '([0-9])[.,]([0-9])', '\\1\\2', 'g'), '[.!?:]+', ' ' || chr(1) || ' ', 'g'),
    '[^\\p{{L}}\\p{{N}}\\x01]+'), lambda x: x <> '') AS w
  FROM texts WHERE text IS NOT NULL),
flat AS (SELECT side, id, unnest(w) AS w, unnest(range(len(w))) AS i FROM words),
seen AS (SELECT *, lag(w) OVER (PARTITION BY side, id ORDER BY i) AS b FROM flat),
forms AS (
  SELECT side, id, i, lower(w) AS v,
    CASE WHEN w[1:1] BETWEEN '0' AND '9' THEN '{NUM}'
         WHEN b[1:1] BETWEEN '0' AND '9' AND lower(w) IN ({_UNITS}) THEN '{UNIT}'
         WHEN b IS NOT NULL AND b <> chr(1) AND w[1:1] <> lower(w)[1:1] THEN '{NAME}'
         ELSE lower(w) END AS t
  FROM seen WHERE w <> chr(1)),
rows_ AS (
  SELECT side, id, list(t ORDER BY i) AS t, list(v ORDER BY i) AS v FROM forms GROUP BY side, id),
bench AS (
  SELECT id AS item_id, least(len(t), {_RULE.size}) AS size, pos, t[pos:pos + size - 1] AS t, v[pos:pos + size - 1] AS v
  FROM (SELECT *, unnest(range(1, len(t) - least(len(t), {_RULE.size}) + 2)) AS pos FROM rows_ WHERE side = 'b' AND len(t) >= {_RULE.least})),
marks AS (
  SELECT * FROM bench
  WHERE len(list_filter(t, lambda x: x NOT IN ('{NUM}', '{NAME}', '{UNIT}'))) >= {_RULE.literals}),
docs AS (
  SELECT id AS doc_id, size, t[pos:pos + size - 1] AS t, v[pos:pos + size - 1] AS v
  FROM (SELECT *, unnest(range(1, len(t) - size + 2)) AS pos
        FROM rows_, (SELECT DISTINCT size FROM marks) WHERE side = 'd' AND len(t) >= size)),
met AS (
  SELECT d.doc_id, m.item_id, m.size, m.pos, max((d.v = m.v)::INT) AS exact_
  FROM docs d JOIN marks m ON d.size = m.size AND d.t = m.t
  WHERE list_transform(m.v, lambda x, k: CASE WHEN m.t[k] IN ('{NUM}', '{NAME}', '{UNIT}')
                       THEN list_position(list_transform(m.v, lambda y, j: m.t[j] || y), m.t[k] || x) ELSE 0 END)
      = list_transform(d.v, lambda x, k: CASE WHEN d.t[k] IN ('{NUM}', '{NAME}', '{UNIT}')
                       THEN list_position(list_transform(d.v, lambda y, j: d.t[j] || y), d.t[k] || x) ELSE 0 END)
  GROUP BY ALL),
found AS (SELECT doc_id, item_id, count(*) AS n_matched, sum(1 - exact_)::BIGINT AS n_reworded FROM met GROUP BY ALL)
SELECT f.doc_id, f.item_id, t.n_windows, f.n_matched, f.n_reworded
FROM found f JOIN (SELECT item_id, count(DISTINCT (size, pos)) AS n_windows FROM marks GROUP BY item_id) t ON f.item_id = t.item_id
WHERE f.n_matched >= {_RULE.share} * t.n_windows
"""
