"""Fragments of oracle SQL. Written for DuckDB, from the description of each operator."""

from __future__ import annotations

# White space of one-argument trims, as SQL.
WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)"
WS = f"{WS}||chr(5760)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)" + "".join(
    f"||chr({c})" for c in range(8192, 8203)
)
S = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"

NUMBER_CTES = """
ones AS (SELECT ['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven',
  'twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen'] AS o,
  ['','','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety'] AS t),
below AS (SELECT list(w ORDER BY i) AS b FROM (
  SELECT i, CASE WHEN i = 0 THEN 'zero' ELSE concat_ws(' ',
      CASE WHEN i >= 100 THEN o[i // 100 + 1] || ' hundred' END,
      CASE WHEN i % 100 >= 20 THEN t[i % 100 // 10 + 1] || CASE WHEN i % 10 > 0 THEN ' ' || o[i % 10 + 1] ELSE '' END
           WHEN i % 100 > 0 THEN o[i % 100 + 1] END) END AS w
  FROM range(1000) r(i), ones))"""


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def squash(x: str) -> str:
    return strip(f"regexp_replace({x}, '{S}+', ' ', 'g')")


def card(n: str) -> str:
    """Cardinal words of a non-negative BIGINT expression; needs ``below``."""
    scales = ["", " thousand", " million", " billion", " trillion", " quadrillion"]
    groups = ", ".join(
        f"CASE WHEN ({n}) // {1000**k} % 1000 > 0 THEN b[({n}) // {1000**k} % 1000 + 1] || '{scales[k]}' END"
        for k in reversed(range(6))
    )
    return f"CASE WHEN ({n}) = 0 THEN 'zero' ELSE concat_ws(' ', {groups}) END"


def ordinalize(w: str) -> str:
    """Ordinal of a words expression."""
    last = f"split_part({w}, ' ', -1)"
    return f"""(left({w}, length({w}) - length({last})) || CASE {last}
      WHEN 'one' THEN 'first' WHEN 'two' THEN 'second' WHEN 'three' THEN 'third' WHEN 'five' THEN 'fifth'
      WHEN 'eight' THEN 'eighth' WHEN 'nine' THEN 'ninth' WHEN 'twelve' THEN 'twelfth'
      ELSE CASE WHEN {last} LIKE '%y' THEN left({last}, length({last}) - 1) || 'ieth' ELSE {last} || 'th' END END)"""


def year(n: str) -> str:
    """Year reading of a BIGINT expression; needs ``below``."""
    hi, lo = f"b[({n}) // 100 + 1]", f"b[({n}) % 100 + 1]"
    return f"""CASE WHEN ({n}) < 1000 OR ({n}) > 9999 THEN {card(n)}
      WHEN ({n}) = 2000 THEN 'two thousand'
      WHEN ({n}) BETWEEN 2001 AND 2009 THEN 'two thousand ' || {lo}
      WHEN ({n}) % 100 = 0 THEN {hi} || ' hundred'
      WHEN ({n}) % 100 < 10 THEN {hi} || ' oh ' || {lo}
      ELSE {hi} || ' ' || {lo} END"""


def number(n: str) -> str:
    """Reading of a plain number: a year from 1500 to 2099."""
    return f"CASE WHEN ({n}) BETWEEN 1500 AND 2099 THEN {year(n)} ELSE {card(n)} END"


def digits(x: str, zero: str = "oh") -> str:
    names = "['zero','one','two','three','four','five','six','seven','eight','nine']"
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '[0-9]'), "
        f"lambda d: CASE WHEN d = '0' THEN '{zero}' ELSE {names}[d::INT + 1] END), ' ')"
    )


def roman(n: str) -> str:
    return (
        f"(repeat('M', (({n}) // 1000)::INT)"
        f" || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][({n}) // 100 % 10 + 1]"
        f" || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][({n}) // 10 % 10 + 1]"
        f" || ['','I','II','III','IV','V','VI','VII','VIII','IX'][({n}) % 10 + 1])"
    )


def cents(x: str) -> str:
    """Whole cents of a price."""
    return f"round(abs({x}) * 100)::BIGINT"


def grouped(n: str) -> str:
    return f"format('{{:,}}', ({n})::BIGINT)"


def grouped_cents(x: str) -> str:
    return f"({grouped(cents(x) + ' // 100')} || '.' || lpad(({cents(x)} % 100)::VARCHAR, 2, '0'))"


def cents_text(x: str) -> str:
    return f"(({cents(x)} // 100)::VARCHAR || '.' || lpad(({cents(x)} % 100)::VARCHAR, 2, '0'))"


def draw(slot: int, size: int | str, seed: int = 42, id_col: str = "id") -> str:
    """The documented draw: two rounds of modular arithmetic on id, slot and seed."""
    p = 2147483647
    first = f"(({id_col} % {p} * 48271 + {slot * 69621 + seed * 16807 + 1}) % {p})"
    high = f"({id_col} // {p} % {p} * 40692 % {p})"
    return f"(((({first} * {first} + {slot + 1} + {high}) % {p}) * 16807 % {p} >> 3) % ({size}))"


def pick(slot: int, options: list[str], seed: int = 42) -> str:
    return f"{quoted(options)}[{draw(slot, len(options), seed)} + 1]"


def quoted(options: list[str]) -> str:
    return "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + "]"


# Sentence splitting without look-around: mark gaps, then undo those after abbreviations.
# The abbreviations.
_ABBR = r"Mr|Mrs|Ms|Dr|Prof|St|Jr|Sr|vs|etc|Inc|Ltd|Corp|Dept|No|Vol|Ch|Fig|Ave|Blvd|Rd|Mt|e\.g|i\.e"


def sentences(x: str, undo: int = 2) -> str:
    """List of sentences of a text expression.

    A mark after an abbreviation is also the word edge of an abbreviation right
    behind it, and one pass consumes it; the second pass undoes those left.
    """
    joined = f"regexp_replace({strip(x)}, '([.!?])[\"''\\)\\]]?{S}+([A-Z\"''(\\[])', '\\1' || chr(1) || '\\2', 'g')"
    for _ in range(undo):
        joined = f"regexp_replace({joined}, '(?i)((?:^|[^\\p{{L}}\\p{{N}}_])(?:{_ABBR})\\.)' || chr(1), '\\1 ', 'g')"
    return f"list_filter(string_split({joined}, chr(1)), lambda s: s <> '')"


def _greedy(items: str, limit: int) -> str:
    """Greedy packing of a string list with blanks; chr(1) separates the packs."""
    return (
        f"list_reduce({items}, lambda a, s: CASE WHEN a = '' THEN s"
        f" WHEN length(string_split(a, chr(1))[-1]) + 1 + length(s) <= {limit} THEN a || ' ' || s"
        f" ELSE a || chr(1) || s END, '')"
    )


def split_long(x: str, limit: int = 480) -> str:
    """Clause packing of a long sentence, then hard cuts; a list."""
    clauses = f"string_split(regexp_replace({x}, '([,;:]){S}+', '\\1' || chr(2), 'g'), chr(2))"
    packs = f"string_split({_greedy(clauses, limit)}, chr(1))"
    return (
        f"list_filter(flatten(list_transform({packs}, lambda p: list_transform(range(0, (length(p) + {limit - 1}) // {limit}),"
        f" lambda k: substr(p, (k * {limit} + 1)::BIGINT, {limit})))), lambda p: p <> '')"
    )


def chunks(x: str, limit: int = 480, small: int = 40, undo: int = 2) -> str:
    """List of chunks of a text expression.

    A long sentence arrives as pieces that end with chr(3) and never mix with
    their neighbours; small pieces join the previous one at the end.
    """
    marked = (
        f"flatten(list_transform({sentences(x, undo)}, lambda s: CASE WHEN length(s) > {limit}"
        f" THEN list_transform({split_long('s', limit)}, lambda p: p || chr(3)) ELSE [s] END))"
    )
    packed = (
        f"list_reduce({marked}, lambda a, s: CASE WHEN a = '' THEN s"
        f" WHEN right(a, 1) <> chr(3) AND right(s, 1) <> chr(3)"
        f" AND length(string_split(a, chr(1))[-1]) + 1 + length(s) <= {limit} THEN a || ' ' || s"
        f" ELSE a || chr(1) || s END, '')"
    )
    pieces = f"list_transform(string_split({packed}, chr(1)), lambda p: replace(p, chr(3), ''))"
    merged = (
        f"list_reduce({pieces}, lambda a, c: CASE WHEN length(c) < {small}"
        f" THEN array_to_string(list_append(string_split(a, chr(1))[:-2],"
        f" {strip('string_split(a, chr(1))[-1] || chr(32) || c')}), chr(1)) ELSE a || chr(1) || c END)"
    )
    return f"CASE WHEN {strip(x)} = '' THEN [] ELSE string_split({merged}, chr(1)) END"


def speech_chunks(x: str, limit: int = 480) -> str:
    """List of synthesis chunks: sentence marks packed, long ones by words on their own."""
    t = squash(x)
    marks = f"list_filter(list_transform(regexp_extract_all({t}, '[^.!?]*[.!?]+|[^ .!?][^.!?]*$'), lambda s: trim(s)), lambda s: s <> '')"
    words = f"string_split({_greedy("string_split(s, ' ')", limit)}, chr(1))"
    marked = (
        f"flatten(list_transform({marks}, lambda s: CASE WHEN length(s) > {limit}"
        f" THEN list_transform({words}, lambda p: p || chr(3)) ELSE [s] END))"
    )
    packed = (
        f"list_reduce({marked}, lambda a, s: CASE WHEN a = '' THEN s"
        f" WHEN right(a, 1) <> chr(3) AND right(s, 1) <> chr(3)"
        f" AND length(string_split(a, chr(1))[-1]) + 1 + length(s) <= {limit} THEN a || ' ' || s"
        f" ELSE a || chr(1) || s END, '')"
    )
    return (
        f"CASE WHEN {t} = '' THEN [] WHEN length({t}) <= {limit} THEN [{t}]"
        f" ELSE list_transform(string_split({packed}, chr(1)), lambda p: replace(p, chr(3), '')) END"
    )


def boilerplate(t: str) -> str:
    return (
        f"(regexp_matches({t}, '(?i)^page{S}+\\d+$') OR regexp_matches({t}, '^\\d+$')"
        f" OR lower({t}) = 'table of contents' OR regexp_matches({t}, '(?i)^copyright($|[^\\p{{L}}\\p{{N}}_])'))"
    )


def opens(t: str) -> str:
    return f"regexp_matches({t}, '(?i)^(chapter|part|book|section|prologue|epilogue)($|[^\\p{{L}}\\p{{N}}_])')"


def kind(t: str, heading: str = "FALSE") -> str:
    """Kind of a stripped text."""
    runs = f"regexp_extract_all({t}, '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+')"
    title = f"(len({runs}) > 0 AND list_bool_and(list_transform({runs}, lambda r: regexp_full_match(r, '[\\p{{Lu}}\\p{{Lt}}]\\p{{Ll}}*'))))"
    upper = f"(regexp_matches({t}, '\\p{{Lu}}') AND NOT regexp_matches({t}, '[\\p{{Ll}}\\p{{Lt}}]'))"
    marks = f"length(regexp_replace({t}, '[^\"“”]', '', 'g'))"
    return f"""CASE WHEN {t} = '' OR {boilerplate(t)} THEN 'skippable'
      WHEN {heading} THEN 'heading'
      WHEN length({t}) <= 64 AND NOT regexp_matches({t}, '[.!?]"?$') AND NOT contains({t}, chr(10))
        AND ({opens(t)} OR {upper} OR {title}) THEN 'heading'
      WHEN left({t}, 1) IN ('"', '“') AND {marks} >= 2 THEN 'dialogue' ELSE 'narration' END"""


def book_ctes(blocks: str, undo: int = 1) -> str:
    """CTEs from ``blocks(doc_id, pos, text, is_heading)`` to chapters and segments; ``undo`` as for sentences."""
    return f"""
b0 AS (SELECT doc_id, pos, {strip('text')} AS t, is_heading FROM ({blocks})),
b1 AS (SELECT *, (is_heading OR {opens('t')}) AS cand FROM b0 WHERE t <> ''),
b2 AS (SELECT *, {kind('t', 'cand')} AS kind FROM b1),
b3 AS (SELECT *, CASE WHEN kind = 'skippable' THEN [] WHEN kind = 'heading' THEN [t] ELSE {chunks('t', undo=undo)} END AS pieces FROM b2),
b4 AS (SELECT *, len(pieces) AS n, coalesce(sum(len(pieces)) OVER (PARTITION BY doc_id ORDER BY pos
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum FROM b3),
b5 AS (SELECT *, cand AND cum > coalesce(max(CASE WHEN cand THEN cum END) OVER (PARTITION BY doc_id ORDER BY pos
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS opening FROM b4),
b6 AS (SELECT *, (sum(opening::INT) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS chapter_index,
       cum - coalesce(max(CASE WHEN opening THEN cum END) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS first_order FROM b5)"""
