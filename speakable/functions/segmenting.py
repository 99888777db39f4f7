"""Sentences, size-bounded chunks and segment kinds, as column expressions.

Greedy packing looks sequential but needs no fold: once every sentence break
is a single blank that a look-around recognises, "take as many whole sentences
as fit" is one greedy bounded match, and a sentence that does not fit is the
shortest match to the next break. Both run in linear time inside one
``regexp_extract_all``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import ENDS_WORD, SPACE, STARTS_WORD, let, squash, strip

MAX_CHARS = 480
MIN_CHARS = 40

# Sentence ends, words that do not end a sentence, kinds.
_OPENERS = r"""[A-Z"'(\[]"""
_CLOSERS = r"""["')\]]"""
_ABBREVIATIONS = (
    r"Mr|Mrs|Ms|Dr|Prof|St|Jr|Sr|vs|etc|Inc|Ltd|Corp|Dept|No|Vol|Ch|Fig|Ave|Blvd|Rd|Mt|e\.g|i\.e"
)
CHAPTER_PATTERN = rf"(?iu)^(chapter|part|book|section|prologue|epilogue){ENDS_WORD}"
DROP_PATTERNS = [
    rf"(?iu)^page[{SPACE}]+\p{{Nd}}+$",
    r"^\p{Nd}+$",
    r"(?iu)^table of contents$",
    rf"(?iu)^copyright{ENDS_WORD}",
]
#: What a text that is dropped starts with, and more characters than that and ``CHAPTER_PATTERN`` look at.
_DROP_STARTS, HEAD_CHARS = r"(?iu)^(?:page|\p{Nd}|table|copyright)", 16

_GAP = rf"(?<=[.!?]){_CLOSERS}?[{SPACE}]+(?={_OPENERS})"
_BREAK = rf"(?<=[.!?])(?<!{STARTS_WORD}(?iu:{_ABBREVIATIONS})\.) (?={_OPENERS})"
_CLAUSE_GAP = rf"(?<=[,;:])[{SPACE}]+"
_CLAUSE_BREAK = "(?<=[,;:]) "


def _one_blank_breaks(text: Column) -> Column:
    """Make every sentence gap, with the quote it swallows, a single blank."""
    return F.regexp_replace(strip(text), _GAP, " ")


def sentences(text: Column) -> Column:
    """Sentences of a text; none for a blank one."""
    joined = _one_blank_breaks(text)
    return let(
        joined,
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, _BREAK, -1)),
    )


def _pack(text: Column, brk: str, limit: int) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)(.{{1,{limit}}}|.+?)(?:{brk}|\z)"), F.lit(1))


def split_long(sentence: Column, max_chars: int = MAX_CHARS) -> Column:
    """Pack the clauses of a long sentence; what still does not fit is cut hard."""
    packed = _pack(F.regexp_replace(sentence, _CLAUSE_GAP, " "), _CLAUSE_BREAK, max_chars)
    return F.flatten(
        F.transform(
            packed,
            lambda p: F.when(F.length(p) <= max_chars, F.array(p)).otherwise(
                F.regexp_extract_all(p, F.lit(rf"(?s).{{1,{max_chars}}}"), F.lit(0))
            ),
        )
    )


def _merge_small(chunks: Column, min_chars: int) -> Column:
    """Append every chunk below the minimum to the one before it."""

    def merge(pieces: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(pieces) - 1),
            lambda k: (k == 0) | (F.length(F.get(pieces, k)) >= min_chars),
        )

        def group(at: Column) -> Column:
            def join(start: Column, k: Column) -> Column:
                stop = F.coalesce(F.get(at, k + 1), F.size(pieces))
                joined = F.array_join(F.slice(pieces, start + 1, stop - start), " ")
                return F.when(stop - start > 1, strip(joined)).otherwise(joined)

            return F.transform(at, join)

        small = F.exists(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.length(p) < min_chars)
        return F.when(small, let(starts, group)).otherwise(pieces)

    return let(chunks, merge)


def chunks(text: Column, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS) -> Column:
    """Whole sentences packed to at most ``max_chars``; small leftovers join their neighbour."""
    packed = _pack(_one_blank_breaks(text), _BREAK, max_chars)
    sized = let(
        packed,
        lambda ps: F.when(
            F.exists(ps, lambda p: F.length(p) > max_chars),
            F.flatten(
                F.transform(
                    ps,
                    lambda p: F.when(F.length(p) > max_chars, split_long(p, max_chars)).otherwise(
                        F.array(p)
                    ),
                )
            ),
        ).otherwise(ps),
    )
    return _merge_small(sized, min_chars)


def speech_chunks(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """The other packer, for synthesis: by sentence marks, long ones by words.

    A single word above the limit stays whole.
    """
    word = r"(?s)(.{1,%d}|.+?)(?: |\z)" % max_chars

    def pack(t: Column) -> Column:
        marks = F.transform(
            F.regexp_extract_all(t, F.lit(r"[^.!?]*[.!?]+|[^\s.!?][^.!?]*\z"), F.lit(0)), strip
        )
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

        def keep(acc: Column) -> Column:
            return F.when(acc["cur"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"]))

        def step(acc: Column, s: Column) -> Column:
            return (
                F.when(s == "", acc)
                .when(
                    F.length(s) > max_chars,
                    F.struct(
                        F.concat(keep(acc), F.regexp_extract_all(s, F.lit(word), F.lit(1))).alias("done"),
                        F.lit("").alias("cur"),
                    ),
                )
                .when(acc["cur"] == "", F.struct(acc["done"].alias("done"), s.alias("cur")))
                .when(
                    F.length(acc["cur"]) + 1 + F.length(s) <= max_chars,
                    F.struct(acc["done"].alias("done"), F.concat(acc["cur"], F.lit(" "), s).alias("cur")),
                )
                .otherwise(F.struct(keep(acc).alias("done"), s.alias("cur")))
            )

        return (
            F.when(t == "", F.array().cast("array<string>"))
            .when(F.length(t) <= max_chars, F.array(t))
            .otherwise(F.aggregate(marks, start, step, keep))
        )

    return let(squash(text), pack)


def _head(text: Column) -> Column:
    """As much of a text as patterns that are tied to its start look at; a search in all of it tries every place."""
    return F.substr(text, F.lit(1), F.lit(HEAD_CHARS))


def is_boilerplate(text: Column) -> Column:
    """Page numbers, bare numbers, tables of contents and copyright lines."""

    def drops(trimmed: Column) -> Column:
        found = F.rlike(trimmed, F.lit(DROP_PATTERNS[0]))
        for pattern in DROP_PATTERNS[1:]:
            found = found | F.rlike(trimmed, F.lit(pattern))
        return F.rlike(_head(trimmed), F.lit(_DROP_STARTS)) & found

    return drops(strip(text))


def opens_chapter(text: Column) -> Column:
    """The text starts with a structural word."""
    return F.rlike(_head(strip(text)), F.lit(CHAPTER_PATTERN))


def is_title_case(text: Column) -> Column:
    """Upper or title letters only where no cased letter precedes, lower only where one does."""
    cased, big = r"\p{Lu}\p{Ll}\p{Lt}", r"\p{Lu}\p{Lt}"
    return F.rlike(
        text,
        F.lit(rf"(?s)^(?!.*(?<![{cased}])\p{{Ll}})(?!.*[{cased}][{big}]).*[{big}]"),
    )


def is_upper_case(text: Column) -> Column:
    return F.rlike(text, F.lit(r"(?s)^[^\p{Ll}\p{Lt}]*\p{Lu}[^\p{Ll}\p{Lt}]*\z"))


def classify(text: Column, heading: Column | bool = False) -> Column:
    """Kind of a block or chunk: skippable, heading, dialogue or narration."""
    flag = heading if isinstance(heading, Column) else F.lit(heading)

    def kind(t: Column) -> Column:
        title_like = (
            (F.length(t) <= 64)
            & ~F.rlike(t, F.lit(r"""[.!?]"?$"""))
            & ~F.contains(t, F.lit("\n"))
        )
        quotes = F.length(F.regexp_replace(t, r"""[^"“”]""", ""))
        return (
            F.when((t == "") | is_boilerplate(t), "skippable")
            .when(flag, "heading")
            .when(title_like & (opens_chapter(t) | is_upper_case(t) | is_title_case(t)), "heading")
            .when(F.substr(t, F.lit(1), F.lit(1)).isin('"', "“") & (quotes >= 2), "dialogue")
            .otherwise("narration")
        )

    return let(strip(text), kind)
