"""Small building blocks shared by all column expressions.

Character classes are spelled out so that they mean the same on every JVM:
letters, numbers and the underscore are word characters, and white space is
the Unicode set plus the four ASCII separators U+001C..U+001F.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, for use inside [...] in a pattern.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"

# Every white-space character, for trimming.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# A digit, letter or underscore may not stand on the outer side of these.
STARTS_WORD = f"(?<![{WORD}])"
ENDS_WORD = f"(?![{WORD}])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Inside a lambda there is no common-subexpression elimination, so an
    expression that is used twice would run twice without this.
    """
    return F.transform(F.array(value), body).getItem(0)


def strip(text: Column) -> Column:
    """Drop white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def squash(text: Column) -> Column:
    """Collapse runs of white space to one blank and trim; single blanks are left alone."""
    # What is printable ASCII is no white space; that is told first, as most of a text is.
    run = f"(?=[^!-~])(?:[{SPACE}&&[^ ]]| (?=[{SPACE}]))[{SPACE}]*"
    return strip(F.regexp_replace(text, run, " "))


def has(text: Column, *needles: str) -> Column:
    """True if any of the plain strings occurs."""
    found = F.contains(text, F.lit(needles[0]))
    for needle in needles[1:]:
        found = found | F.contains(text, F.lit(needle))
    return found


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, null when the key is missing."""
    cells = [F.lit(cell) for pair in table.items() for cell in pair]
    return F.try_element_at(F.create_map(*cells), key)


def chain(cases: list[tuple[Column, Column]], default: Column) -> Column:
    """``CASE WHEN`` over (condition, value) pairs."""
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out.otherwise(default)
