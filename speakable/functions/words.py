"""Numbers to words, as column expressions over digit strings.

Numbers stay strings: a card number of 16 digits must never meet a cast.
Everything is exact up to 18 digits; longer runs are read digit by digit.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let, lookup

# Number words.
ONES = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine",
    "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen",
]
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
SCALES = ["quadrillion", "trillion", "billion", "million", "thousand", ""]
# Names of the powers of a thousand, beyond which there are none.
ALL_SCALES = [
    "", "thousand", "million", "billion", "trillion", "quadrillion", "quintillion", "sextillion", "septillion", "octillion",
    "nonillion", "decillion", "undecillion", "duodecillion", "tredecillion", "quattuordecillion", "quindecillion",
    "sexdecillion", "septendecillion", "octodecillion", "novemdecillion", "vigintillion",
]
IRREGULAR_ORDINALS = {
    "one": "first", "two": "second", "three": "third", "five": "fifth",
    "eight": "eighth", "nine": "ninth", "twelve": "twelfth",
}
ROMAN_DIGITS = [
    ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"],
    ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"],
    ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"],
]

MAX_DIGITS = 3 * len(SCALES)


@lru_cache(maxsize=1)
def _below_thousand() -> list[str]:
    below_hundred = ONES + [
        " ".join(filter(None, [TENS[n // 10], ONES[n % 10] if n % 10 else ""]))
        for n in range(20, 100)
    ]
    return [
        " ".join(
            ([ONES[n // 100], "hundred"] if n >= 100 else [])
            + ([below_hundred[n % 100]] if n % 100 or n == 0 else [])
        )
        for n in range(1000)
    ]


def word_list(words: list[str]) -> Column:
    """A constant array: one string literal that the optimizer folds once."""
    return F.split(F.lit("|".join(words)), r"\|")


@lru_cache(maxsize=1)
def _foreign_digits() -> str:
    """The decimal digits of all other scripts, ten by ten."""
    zeros = [
        c for c in map(chr, range(128, sys.maxunicode + 1))
        if unicodedata.category(c) == "Nd" and unicodedata.digit(c) == 0
    ]
    return "".join(chr(ord(zero) + d) for zero in zeros for d in range(10))


def ascii_digits(text: Column) -> Column:
    """Map the decimal digits of every script to 0-9."""
    foreign = F.rlike(text, F.lit(r"[\p{Nd}&&[^0-9]]"))
    digits = _foreign_digits()
    ascii_ = "0123456789" * (len(digits) // 10)
    return F.when(foreign, F.translate(text, digits, ascii_)).otherwise(text)


def spell_digits(text: Column, oh: Column | bool = True) -> Column:
    """Read digit by digit; ``oh`` says "oh" for 0."""
    zero = F.when(oh if isinstance(oh, Column) else F.lit(oh), F.lit("oh")).otherwise("zero")
    names = word_list(ONES[:10])
    return F.array_join(
        F.transform(
            F.regexp_extract_all(text, F.lit("[0-9]"), F.lit(0)),
            lambda d: F.when(d == "0", zero).otherwise(F.element_at(names, d.cast("int") + 1)),
        ),
        " ",
    )


def cardinal(digits: Column) -> Column:
    """``"1234"`` -> one thousand two hundred thirty four."""
    below = word_list(_below_thousand())

    def spell(padded: Column) -> Column:
        groups = []
        for k, scale in enumerate(SCALES):
            group = F.substring(padded, 3 * k + 1, 3)
            words = F.element_at(below, group.cast("int") + 1)
            groups.append(
                F.when(group != "000", F.concat(words, F.lit(" " + scale)) if scale else words)
            )
        return F.concat_ws(" ", *groups)

    def spell_long(number: Column) -> Column:
        """Any number of groups of three; the plan above writes them out for the common lengths."""
        n = F.ceil(F.length(number) / 3).cast("int")
        padded = F.lpad(number, 3 * n, "0")
        names = word_list(ALL_SCALES)

        def group(i: Column) -> Column:
            digits = F.substr(padded, 3 * i - 2, F.lit(3))
            words = F.element_at(below, digits.cast("int") + 1)
            return F.when(digits != "000", F.trim(F.concat_ws(" ", words, F.element_at(names, n - i + 1))))

        groups = F.transform(F.sequence(F.lit(1), n), group)
        return F.when(n > len(ALL_SCALES), spell_digits(number, oh=False)).otherwise(F.array_join(groups, " "))

    def read(number: Column) -> Column:
        return (
            F.when(number == "", F.lit("zero"))
            .when(F.length(number) <= 3, F.element_at(below, number.cast("int") + 1))
            .when(F.length(number) > MAX_DIGITS, spell_long(number))
            .otherwise(let(F.lpad(number, MAX_DIGITS, "0"), spell))
        )

    return let(F.ltrim(digits, F.lit("0")), read)


def signed_cardinal(number: Column) -> Column:
    """Cardinal of a digit string with an optional minus sign."""
    plain = cardinal(F.ltrim(number, F.lit("-")))
    return F.when(F.startswith(number, F.lit("-")), F.concat(F.lit("negative "), plain)).otherwise(plain)


def to_ordinal(words: Column) -> Column:
    """Turn the last word of a cardinal into its ordinal."""

    def bend(last: Column) -> Column:
        tail = F.coalesce(
            lookup(IRREGULAR_ORDINALS, last),
            F.when(F.endswith(last, F.lit("y")), F.regexp_replace(last, "y$", "ieth")),
            F.concat(last, F.lit("th")),
        )
        return F.concat(F.substr(words, F.lit(1), F.length(words) - F.length(last)), tail)

    return let(F.substring_index(words, " ", -1), bend)


def ordinal(digits: Column) -> Column:
    """``"21"`` -> twenty first."""
    return let(cardinal(digits), to_ordinal)


def four_digit_year(digits: Column) -> Column:
    """``"1984"`` -> nineteen eighty four; for exactly four digits without a leading zero."""
    below = word_list(_below_thousand())
    low = F.substring(digits, 3, 2)

    def words(pair: Column) -> Column:
        return F.element_at(below, pair.cast("int") + 1)

    hundreds = words(F.substring(digits, 1, 2))
    return (
        F.when(digits == "2000", "two thousand")
        .when(F.startswith(digits, F.lit("200")), F.concat(F.lit("two thousand "), words(low)))
        .when(low == "00", F.concat(hundreds, F.lit(" hundred")))
        .when(low < "10", F.concat(hundreds, F.lit(" oh "), words(low)))
        .otherwise(F.concat(hundreds, F.lit(" "), words(low)))
    )


def year(digits: Column) -> Column:
    """Year reading of a number; outside 1000-9999 a plain cardinal."""
    return let(
        F.ltrim(digits, F.lit("0")),
        lambda n: F.when(F.length(n) == 4, four_digit_year(n)).otherwise(cardinal(n)),
    )


def decade(digits: Column) -> Column:
    """``"1980"`` -> nineteen eighties."""
    return let(
        year(digits),
        lambda w: F.when(F.endswith(w, F.lit("y")), F.regexp_replace(w, "y$", "ies")).otherwise(
            F.concat(w, F.lit("s"))
        ),
    )


def roman_value(numeral: Column) -> Column:
    """Value of a well-formed Roman numeral in either case, null otherwise.

    The grammar below accepts exactly the canonical spellings, so there is
    nothing to verify afterwards; each digit group is looked up by position.
    """
    grammar = (
        "^(?=.)(M*)(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
    )

    def value(upper: Column) -> Column:
        places = [
            (F.array_position(word_list(ROMAN_DIGITS[2 - k]), F.regexp_extract(upper, grammar, k + 2)) - 1)
            * (100 // 10**k)
            for k in range(3)
        ]
        thousands = F.length(F.regexp_extract(upper, grammar, 1)) * 1000
        return F.when(F.rlike(upper, F.lit(grammar)), thousands + places[0] + places[1] + places[2])

    return let(F.upper(numeral), value)


def to_roman(number: Column) -> Column:
    """Canonical Roman numeral of a positive integer."""
    n = number.cast("int")
    places = [
        F.element_at(word_list(ROMAN_DIGITS[k]), (F.floor(n / 10**k) % 10).cast("int") + 1)
        for k in (2, 1, 0)
    ]
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), *places)


def roman_words(numeral: Column, as_ordinal: bool = False) -> Column:
    """Words of a Roman numeral; an invalid one stays as it is."""
    read = ordinal if as_ordinal else cardinal
    return let(
        roman_value(numeral).cast("string"),
        lambda v: F.when(v.isNull(), numeral).otherwise(read(v)),
    )
