"""Queries over number words, readings, spans and normalized text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import readings as R
from ..functions import words as W
from ..functions.scanning import normalize
from ..operators import spans as S
from . import sql as q
from .inputs import cents_text, dealt, grouped_cents, lines, number_text, receipts, table
from .registry import query
from .text import segmented

_N = q.NUMBER_CTES


def _words_sql(src: str, staged: str, out: str) -> str:
    """``src`` gives the keys and ``n``; ``staged`` names intermediate words."""
    return f"WITH {_N} SELECT id, {out} AS spoken FROM (SELECT *, {staged} FROM ({src}), ones, below)"


_BIG = "SELECT o_orderkey AS id, (o_orderkey * 7919 * (CASE WHEN o_orderkey % 3 = 0 THEN 1000003 ELSE 1 END))::BIGINT AS n FROM orders"


def _big(spark, sf):
    o = table(spark, sf, "orders")
    factor = F.when(F.col("o_orderkey") % 3 == 0, 1_000_003).otherwise(1)
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 7919 * factor).cast("string").alias("n"))


@query("words_cardinal", _words_sql(_BIG, f"{q.card('n')} AS w", "w"))
def words_cardinal(spark, sf):
    return _big(spark, sf).select("id", W.cardinal(F.col("n")).alias("spoken"))


@query("words_ordinal", _words_sql(_BIG, f"{q.card('n')} AS w", q.ordinalize("w")))
def words_ordinal(spark, sf):
    return _big(spark, sf).select("id", W.ordinal(F.col("n")).alias("spoken"))


@query("words_digits", f"SELECT id, {q.digits('n::VARCHAR')} AS spoken FROM ({_BIG})")
def words_digits(spark, sf):
    return _big(spark, sf).select("id", W.spell_digits(F.col("n")).alias("spoken"))


_YEAR = "SELECT o_orderkey AS id, (o_orderkey * 37 % 9500 + 600)::BIGINT AS n FROM orders"


def _years(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 37 % 9500 + 600).cast("string").alias("n"))


@query("words_year", _words_sql(_YEAR, f"{q.year('n')} AS w", "w"))
def words_year(spark, sf):
    return _years(spark, sf).select("id", W.year(F.col("n")).alias("spoken"))


_DECADE = "SELECT o_orderkey AS id, (year(o_orderdate) // 10 * 10 - o_orderkey % 20 * 10)::BIGINT AS n FROM orders"


@query(
    "words_decade",
    _words_sql(_DECADE, f"{q.year('n')} AS w", "CASE WHEN w LIKE '%y' THEN left(w, length(w) - 1) || 'ies' ELSE w || 's' END"),
)
def words_decade(spark, sf):
    o = table(spark, sf, "orders")
    n = F.floor(F.year("o_orderdate") / 10) * 10 - F.col("o_orderkey") % 20 * 10
    return o.select(F.col("o_orderkey").alias("id"), n.cast("string").alias("n")).select(
        "id", W.decade(F.col("n")).alias("spoken")
    )


_NUMERAL = "SELECT o_orderkey AS id, (o_orderkey % 3999 + 1)::BIGINT AS n FROM orders"


def _numerals(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3999 + 1).alias("n"))


@query("int_to_roman", f"SELECT id, {q.roman('n')} AS numeral FROM ({_NUMERAL})")
def int_to_roman(spark, sf):
    return _numerals(spark, sf).select("id", W.to_roman(F.col("n")).alias("numeral"))


@query(
    "roman_to_int",
    f"SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE n END AS value FROM ({_NUMERAL})",
)
def roman_to_int(spark, sf):
    numeral = F.lower(W.to_roman(F.col("n")))
    spoilt = F.when(F.col("id") % 5 == 0, F.concat(numeral, F.lit("iiii"))).otherwise(numeral)
    return _numerals(spark, sf).select("id", W.roman_value(spoilt).alias("value"))


@query(
    "rule_electronic",
    r"""SELECT page_id AS id, array_to_string(list_transform(regexp_extract_all(
          rtrim(regexp_replace(rtrim(url, '.,;:!?'), '^https?://', ''), '/'), '[./:@_#&=\-]|[^./:@_#&=\-]+'),
          lambda t: CASE t WHEN '.' THEN 'dot' WHEN '/' THEN 'slash' WHEN ':' THEN 'colon' WHEN '@' THEN 'at'
            WHEN '_' THEN 'underscore' WHEN '-' THEN 'dash' WHEN '#' THEN 'hash' WHEN '&' THEN 'and' WHEN '=' THEN 'equals'
            WHEN 'www' THEN 'w w w' ELSE CASE WHEN regexp_full_match(t, '[0-9]+') THEN """
    + q.digits("t")
    + r""" WHEN lower(t) IN ('com','org','net','io','gov','edu','co','uk') THEN lower(t) ELSE t END END), ' ') AS spoken FROM pages""",
)
def rule_electronic(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select(F.col("page_id").alias("id"), R.read_as("ELECTRONIC", F.col("url")).alias("spoken"))


_C = q.cents("l_extendedprice")
_MONEY = f"""SELECT l_orderkey * 8 + l_linenumber AS id, {_C} AS c, l_linenumber AS k FROM lineitem"""


@query(
    "rule_money",
    f"""WITH {_N} SELECT id, CASE k % 3
          WHEN 0 THEN {q.card('c // 100')} || ' dollars' || CASE WHEN c % 100 > 0 THEN ' and ' || b[c % 100 + 1] || ' cents' ELSE '' END
          WHEN 1 THEN {q.card('c // 100')} || ' point ' || {q.digits("lpad((c % 100)::VARCHAR, 2, '0')", 'zero')} || ' million pounds'
          ELSE {q.card('c // 100')} || ' yen' END AS spoken FROM ({_MONEY}), ones, below""",
)
def rule_money(spark, sf):
    price = F.col("l_extendedprice")
    kind = F.col("l_linenumber") % 3
    surface = (
        F.when(kind == 0, F.concat(F.lit("$"), grouped_cents(price)))
        .when(kind == 1, F.concat(F.lit("£ "), cents_text(price), F.lit("M")))
        .otherwise(F.concat(F.lit("¥"), F.regexp_replace(grouped_cents(price), r"\..*$", "")))
    )
    rows = dealt(lines(spark, sf).select("line_id", "l_extendedprice", "l_linenumber")).select(F.col("line_id").alias("id"), surface.alias("s"))
    return rows.select("id", R.read_as("MONEY", F.col("s")).alias("spoken"))


@query(
    "rule_telephone",
    f"SELECT c_custkey AS id, {q.digits('(5550000000 + c_custkey * 7919)::VARCHAR')} AS spoken FROM customer",
)
def rule_telephone(spark, sf):
    number = (F.lit(5_550_000_000) + F.col("c_custkey") * 7919).cast("string")
    # The last group takes all further digits: keys from 561,940 on make numbers of eleven.
    a, b, c = F.substring(number, 1, 3), F.substring(number, 4, 3), F.substr(number, F.lit(7))
    surface = F.when(F.col("c_custkey") % 2 == 0, F.concat_ws("-", a, b, c)).otherwise(
        F.concat(F.lit("("), a, F.lit(") "), b, F.lit("."), c)
    )
    customer = table(spark, sf, "customer")
    return customer.select(F.col("c_custkey").alias("id"), R.read_as("TELEPHONE", surface).alias("spoken"))


@query(
    "rule_time",
    f"""WITH {_N}, e AS (SELECT event_id AS id, hour(ts) AS h, minute(ts) // 5 * 5 AS m FROM events)
        SELECT id, CASE WHEN id % 4 = 3 THEN h || ':' || lpad(m::VARCHAR, 2, '0') || 'PM' ELSE
          b[h + 1] || CASE WHEN m = 0 THEN CASE WHEN id % 4 = 0 THEN ' o''clock' ELSE '' END
            WHEN m < 10 THEN ' oh ' || b[m + 1] ELSE ' ' || b[m + 1] END
          || CASE id % 4 WHEN 1 THEN ' p m' WHEN 2 THEN ' a m' ELSE '' END END AS spoken FROM e, ones, below""",
)
def rule_time(spark, sf):
    minute = (F.floor(F.minute("ts") / 5) * 5).cast("string")
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("", " PM", " a.m.", "PM")]), (F.col("event_id") % 4 + 1).cast("int"))
    surface = F.concat(F.hour("ts").cast("string"), F.lit(":"), F.lpad(minute, 2, "0"), suffix)
    events = table(spark, sf, "events")
    return events.select(F.col("event_id").alias("id"), R.read_as("TIME", surface).alias("spoken"))


_UNITS = {
    "kg": "kilograms", "%": "percent", "km/h": "kilometers per hour", "°C": "degrees celsius", "lbs": "lbs",
    "GB": "gigabytes", "min": "minutes", "MHz": "mhz",
}
_UNIT_CASE = "CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_UNITS.values())) + " END"


@query(
    "rule_measure",
    f"""WITH {_N} SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN {q.card('p_size')}
          ELSE {q.card('p_size')} || ' point ' || {q.digits("(p_partkey % 100)::VARCHAR", 'zero')} END || ' ' || {_UNIT_CASE} AS spoken
        FROM part, ones, below""",
)
def rule_measure(spark, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u in _UNITS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    size = F.col("p_size").cast("string")
    number = F.when(F.col("p_size") % 2 == 0, size).otherwise(
        F.concat(size, F.lit("."), (F.col("p_partkey") % 100).cast("string"))
    )
    surface = F.concat(number, F.when(F.col("p_size") % 3 == 0, " ").otherwise(""), unit)
    parts = table(spark, sf, "part")
    return parts.select(F.col("p_partkey").alias("id"), R.read_as("MEASURE", surface).alias("spoken"))


_CONTEXT = ["Henry", "Chapter", "king", "Act"]


@query(
    "rule_roman",
    f"""WITH {_N}, s AS (SELECT p_partkey AS id, {q.quoted(_CONTEXT)}[p_partkey % 4 + 1] AS c, p_size::BIGINT AS n FROM part),
        w AS (SELECT *, {q.card('n')} AS w FROM s, ones, below)
        SELECT id, CASE WHEN id % 7 = 0 THEN c || ' ' || {q.roman('n')} || 'IIII'
          WHEN c IN ('Henry', 'king') THEN c || ' the ' || {q.ordinalize('w')} ELSE c || ' ' || w END AS spoken FROM w""",
)
def rule_roman(spark, sf):
    word = F.element_at(F.array(*[F.lit(c) for c in _CONTEXT]), (F.col("p_partkey") % 4 + 1).cast("int"))
    spoilt = F.when(F.col("p_partkey") % 7 == 0, "IIII").otherwise("")
    surface = F.concat(word, F.lit(" "), W.to_roman(F.col("p_size")), spoilt)
    parts = table(spark, sf, "part")
    return parts.select(F.col("p_partkey").alias("id"), R.read_as("ROMAN", surface).alias("spoken"))


@query(
    "rule_fraction",
    f"""WITH {_N}, s AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_linenumber AS a, l_quantity::BIGINT AS d FROM lineitem),
        w AS (SELECT *, {q.card('d')} AS w FROM s, ones, below)
        SELECT id, b[a + 1] || ' ' || CASE d WHEN 2 THEN 'half' WHEN 4 THEN 'quarter' ELSE {q.ordinalize('w')} END
          || CASE WHEN a = 1 THEN '' ELSE 's' END AS spoken FROM w""",
)
def rule_fraction(spark, sf):
    surface = F.concat(F.col("l_linenumber").cast("string"), F.lit("/"), number_text(F.col("l_quantity")))
    rows = dealt(lines(spark, sf).select("line_id", "l_linenumber", "l_quantity")).select(F.col("line_id").alias("id"), surface.alias("s"))
    return rows.select("id", R.read_as("FRACTION", F.col("s")).alias("spoken"))


_SUFFIX = """CASE WHEN n % 100 IN (11, 12, 13) THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END"""


@query(
    "rule_ordinal",
    f"""WITH {_N}, w AS (SELECT o_orderkey AS id, {q.card('o_orderkey')} AS w FROM orders, ones, below)
        SELECT id, {q.ordinalize('w')} AS spoken FROM w""",
)
def rule_ordinal(spark, sf):
    n = F.col("o_orderkey")
    suffix = (
        F.when((n % 100).isin(11, 12, 13), "th")
        .when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    )
    rows = table(spark, sf, "orders").select(n.alias("id"), F.concat(n.cast("string"), suffix).alias("s"))
    return rows.select("id", R.read_as("ORDINAL", F.col("s")).alias("spoken"))


@query(
    "rule_decimal",
    f"""WITH {_N}, s AS (SELECT o_orderkey AS id, {q.cents('o_totalprice')} AS c FROM orders)
        SELECT id, CASE id % 3 WHEN 1 THEN 'negative ' ELSE '' END || CASE id % 3 WHEN 2 THEN 'zero' ELSE {q.card('c // 100')} END
          || ' point ' || {q.digits("lpad((c % 100)::VARCHAR, 2, '0')", 'zero')} AS spoken FROM s, ones, below""",
)
def rule_decimal(spark, sf):
    price = cents_text(F.col("o_totalprice"))
    kind = F.col("o_orderkey") % 3
    surface = (
        F.when(kind == 1, F.concat(F.lit("-"), price))
        .when(kind == 2, F.regexp_replace(price, r"^[^.]*", ""))
        .otherwise(price)
    )
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), surface.alias("s"))
    return rows.select("id", R.read_as("DECIMAL", F.col("s")).alias("spoken"))


@query(
    "rule_grouped",
    f"WITH {_N} SELECT o_orderkey AS id, {q.card('o_orderkey * 7919')} AS spoken FROM orders, ones, below",
)
def rule_grouped(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return rows.select("id", R.read_as("CARDINAL_G", F.format_number(F.col("id") * 7919, 0)).alias("spoken"))


@query(
    "rule_cardinal",
    f"WITH {_N} SELECT o_orderkey AS id, {q.number('o_orderkey')} AS spoken FROM orders, ones, below",
)
def rule_cardinal(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return rows.select("id", R.read_as("CARDINAL", F.col("id").cast("string")).alias("spoken"))


_ABBR = {
    "St.": "saint", "Dr": "doctor", "Ln.": "lane", "Mr.": "mister", "e.g.": "for example", "approx.": "approximately",
    "Blvd": "boulevard", "Xyz.": "Xyz.", "etc.": "et cetera",
}


@query(
    "rule_abbrev",
    f"SELECT c_custkey AS id, {q.quoted(list(_ABBR.values()))}[c_custkey % {len(_ABBR)} + 1] AS spoken FROM customer",
)
def rule_abbrev(spark, sf):
    surface = F.element_at(F.array(*[F.lit(a) for a in _ABBR]), (F.col("c_custkey") % len(_ABBR) + 1).cast("int"))
    customer = table(spark, sf, "customer")
    return customer.select(F.col("c_custkey").alias("id"), R.read_as("ABBREV", surface).alias("spoken"))


# The receipt sentence has a known shape, so SQL can say each span and reading directly.
_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_RECEIPT = f"""r AS (SELECT o_orderkey AS segment_id, o_orderkey AS k, day(o_orderdate) AS d, year(o_orderdate) AS y,
  {q.quoted(_MONTHS)}[month(o_orderdate)] AS mon, {q.cents('o_totalprice')} AS c, o_custkey AS cust, o_custkey % 100 AS share,
  o_orderkey % 12 + 1 AS h, o_custkey % 60 AS m, {q.grouped_cents('o_totalprice')} AS price FROM orders)"""
_DOLLARS = f"{q.card('c // 100')} || ' dollars' || CASE WHEN c % 100 > 0 THEN ' and ' || b[c % 100 + 1] || ' cents' ELSE '' END"
_CLOCK = "b[h + 1] || CASE WHEN m = 0 THEN '' WHEN m < 10 THEN ' oh ' || b[m + 1] ELSE ' ' || b[m + 1] END || ' p m'"
_SPANS = [
    ("CARDINAL", "k::VARCHAR", q.number("k"), "6"),
    ("CARDINAL", "d::VARCHAR", q.card("d"), "6 + length(k::VARCHAR) + 4 + length(mon) + 1"),
    ("CARDINAL", "y::VARCHAR", q.number("y"), "s2 + length(d::VARCHAR) + 2"),
    ("MONEY", "'$' || price", _DOLLARS, "s3 + 4 + 6"),
    ("ABBREV", "'Dr.'", "'doctor'", "s4 + 1 + length(price) + 2"),
    ("CARDINAL", "cust::VARCHAR", q.number("cust"), "s5 + 4"),
    ("MEASURE", "share || '%'", f"{q.card('share')} || ' percent'", "s6 + length(cust::VARCHAR) + 6"),
    ("TIME", "h || ':' || lpad(m::VARCHAR, 2, '0') || ' PM'", _CLOCK, "s7 + length(share::VARCHAR) + 1 + 4"),
    ("ROMAN", "'Chapter IV'", "'Chapter four'", "s8 + length(h::VARCHAR) + 6 + 2"),
]
_STARTS = ", ".join(f"({start})::BIGINT AS s{k}" for k, (_, _, _, start) in enumerate(_SPANS, 1))
_TOKENS = " UNION ALL ".join(
    f"SELECT segment_id, {k - 1}::BIGINT AS span_no, s{k} AS start, s{k} + length({surface}) AS stop, '{cls}' AS cls, {surface} AS surface, {said} AS spoken FROM st"
    for k, (cls, surface, said, _) in enumerate(_SPANS, 1)
)
_TOKEN_CTES = f"WITH {_N}, {_RECEIPT}, st AS (SELECT *, {_STARTS} FROM r, ones, below), tokens AS ({_TOKENS})"


@query("op_scan", f"{_TOKEN_CTES} SELECT segment_id, span_no, start, stop, cls, surface FROM tokens")
def scan_receipts(spark, sf):
    return S.spans(receipts(spark, sf), "text", "segment_id")


@query("op_span_tokens", f"{_TOKEN_CTES} SELECT segment_id, span_no, cls, surface, spoken FROM tokens")
def span_tokens(spark, sf):
    return S.span_tokens(receipts(spark, sf), "text", "segment_id").drop("start", "stop")


@query(
    "op_normalize",
    f"""WITH {_N}, {_RECEIPT} SELECT segment_id, 'Order ' || {q.number('k')} || ' of ' || mon || ' ' || {q.card('d')} || ', '
          || {q.number('y')} || ' cost ' || {_DOLLARS} || '; doctor ' || {q.number('cust')} || ' paid ' || {q.card('share')}
          || ' percent at ' || {_CLOCK} || ', Chapter four.' AS normalized FROM r, ones, below""",
)
def normalize_receipts(spark, sf):
    return S.normalized(receipts(spark, sf)).select("segment_id", "normalized")


@query("op_span_counts", f"{_TOKEN_CTES} SELECT cls, count(*) AS n_spans FROM tokens GROUP BY cls")
def span_counts(spark, sf):
    return S.span_counts(S.spans(receipts(spark, sf), "text", "segment_id"))


@query(
    "join_lexicon",
    f"{_TOKEN_CTES} SELECT cls, spoken, count(*) AS n FROM tokens WHERE cls IN ('TIME', 'MEASURE', 'ABBREV') GROUP BY cls, spoken",
)
def lexicon_join(spark, sf):
    found = S.spans(receipts(spark, sf), "text", "segment_id", classes=["TIME", "MEASURE", "ABBREV"])
    counts = S.surface_counts(found)
    return S.join_lexicon(counts, S.lexicon(counts)).groupBy("cls", "spoken").agg(F.sum("n").alias("n"))


@query("op_normalize_documents")
def normalize_documents(spark, sf):
    return S.normalized(segmented(spark, sf))


@query("op_span_counts_documents")
def document_span_counts(spark, sf):
    found = S.spans(segmented(spark, sf), "text", "doc_id")
    langs = table(spark, sf, "documents").select("doc_id", "lang")
    return S.span_counts(found, "doc_id").join(langs, "doc_id").groupBy("lang", "cls").agg(F.sum("n_spans").alias("n_spans"))


@query("op_normalize_conversations")
def normalize_conversations(spark, sf):
    turns = table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", normalize(F.col("text")).alias("normalized"))
