"""Spoken readings of typed surfaces.

A reading is an ordered list of *parts* ``(how, txt)``: say ``txt`` as a
cardinal, an ordinal, digits or as it stands. Each class only decides on its
parts; one shared renderer turns parts into words. The large number-word
expression therefore occurs once in a plan, however many classes there are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import ENDS_WORD, SPACE, STARTS_WORD, chain, has, let, lookup, strip
from .words import ascii_digits, cardinal, four_digit_year, roman_value, spell_digits, to_ordinal

# Ways to say a part.
LITERAL, CARDINAL, ORDINAL, ORDINALS, DIGITS, DIGITS_OH = "l", "c", "o", "s", "d", "h"

# Currencies, magnitudes, units, symbols, abbreviations.
CURRENCIES = {
    "$": "dollars", "£": "pounds", "€": "euros", "¥": "yen",
    "USD": "dollars", "GBP": "pounds", "EUR": "euros",
}
CENTS = {"$": "cents", "£": "pence", "€": "cents"}
MAGNITUDES = {
    "k": "thousand", "K": "thousand", "m": "million", "M": "million",
    "b": "billion", "B": "billion", "bn": "billion", "tr": "trillion",
}
UNITS = {
    "km": "kilometers", "m": "meters", "cm": "centimeters", "mm": "millimeters",
    "kg": "kilograms", "g": "grams", "mg": "milligrams", "lb": "pounds", "oz": "ounces",
    "ml": "milliliters", "l": "liters", "km/h": "kilometers per hour", "mph": "miles per hour",
    "%": "percent", "°c": "degrees celsius", "°f": "degrees fahrenheit", "ft": "feet",
    "in": "inches", "mi": "miles", "kb": "kilobytes", "mb": "megabytes", "gb": "gigabytes",
    "tb": "terabytes", "hz": "hertz", "khz": "kilohertz", "ghz": "gigahertz", "w": "watts",
    "kw": "kilowatts", "s": "seconds", "min": "minutes", "hr": "hours",
}
SYMBOLS = {
    ".": "dot", "/": "slash", ":": "colon", "@": "at", "_": "underscore",
    "-": "dash", "#": "hash", "&": "and", "=": "equals", "?": "question mark",
}
DOMAINS = ["com", "org", "net", "io", "gov", "edu", "co", "uk"]
ABBREVIATIONS = {
    "mr": "mister", "mrs": "missus", "ms": "miz", "prof": "professor",
    "jr": "junior", "sr": "senior", "vs": "versus", "etc": "et cetera",
    "e.g": "for example", "i.e": "that is", "approx": "approximately",
    "dept": "department", "govt": "government", "inc": "incorporated",
    "ltd": "limited", "corp": "corporation", "no": "number", "vol": "volume",
    "ch": "chapter", "fig": "figure", "p": "page", "pp": "pages", "ave": "avenue",
    "blvd": "boulevard", "rd": "road", "mt": "mount", "ft": "fort",
    "phd": "p h d", "ceo": "c e o", "usa": "u s a", "uk": "u k",
    "am": "a m", "pm": "p m", "lb": "pounds", "oz": "ounces",
}
FIRST_READINGS = {"st": "saint", "dr": "doctor", "ln": "lane", "sq": "square"}
REGNAL_WORDS = [
    "king", "queen", "pope", "louis", "henry", "george", "edward", "william",
    "elizabeth", "charles", "richard", "philip", "napoleon", "peter", "catherine",
]


def part(how: str | Column, txt: str | Column) -> Column:
    how = how if isinstance(how, Column) else F.lit(how)
    txt = txt if isinstance(txt, Column) else F.lit(txt)
    return F.struct(how.alias("how"), txt.alias("txt"))


def speak(parts: Column) -> Column:
    """Render parts to words; empty parts vanish."""

    def say(p: Column) -> Column:
        how, txt = p["how"], p["txt"]
        return (
            F.when((how == LITERAL) | (txt == ""), txt)
            .when(how.isin(DIGITS, DIGITS_OH), spell_digits(txt, oh=how == DIGITS_OH))
            .otherwise(
                let(
                    cardinal(txt),
                    lambda w: F.when(how == CARDINAL, w).otherwise(
                        F.concat(to_ordinal(w), F.when(how == ORDINALS, "s").otherwise(""))
                    ),
                )
            )
        )

    return F.array_join(F.filter(F.transform(parts, say), lambda w: w != ""), " ")


def _is_number(text: Column) -> Column:
    return F.rlike(text, F.lit("^[0-9]+$"))


def year_parts(digits: Column) -> Column:
    """Reading of a four-digit year."""
    return F.array(part(LITERAL, four_digit_year(digits)))


def number_parts(number: Column, raw: Column | None = None) -> Column:
    """Integer or decimal; anything else is said as ``raw``."""
    whole = F.regexp_extract(number, r"^[+-]*([0-9]*)\.", 1)
    sign = F.when(F.startswith(number, F.lit("-")), "negative").otherwise("")
    return (
        F.when(
            has(number, "."),
            F.array(
                part(LITERAL, sign),
                part(CARDINAL, F.when(whole == "", "0").otherwise(whole)),
                part(LITERAL, "point"),
                part(DIGITS, F.regexp_replace(number, r"^[^.]*\.|[^0-9]", "")),
            ),
        )
        .when(_is_number(number), F.array(part(CARDINAL, number)))
        .otherwise(F.array(part(LITERAL, number if raw is None else raw)))
    )


def decimal_parts(surface: Column) -> Column:
    return number_parts(F.replace(surface, F.lit(","), F.lit("")))


def money_parts(surface: Column) -> Column:
    """Amount, magnitude and unit; cents only where they are not zero."""
    scale = f"([kKmMbB]|bn|tr){ENDS_WORD}"

    def split(text: Column) -> Column:
        sign = F.substring(text, 1, 1)
        symbol = F.when(sign.isin("$", "£", "€", "¥"), sign).otherwise(
            F.regexp_extract(text, "^(USD|GBP|EUR)", 1)
        )
        return F.struct(symbol.alias("sym"), F.substr(text, F.length(symbol) + 1).alias("rest"))

    def number(money: Column) -> Column:
        rest = money["rest"]
        lettered = F.rlike(rest, F.lit("[A-Za-z]"))
        bare = F.when(lettered, F.regexp_replace(rest, f"(?s)^(.*?)(?:{scale})(.*)$", "$1$3")).otherwise(rest)
        return F.struct(
            money["sym"].alias("sym"),
            F.when(lettered, F.regexp_extract(rest, scale, 1)).otherwise("").alias("mag"),
            F.replace(strip(bare), F.lit(","), F.lit("")).alias("num"),
        )

    def build(money: Column) -> Column:
        sym, mag, num = money["sym"], money["mag"], money["num"]
        unit = F.coalesce(lookup(CURRENCIES, sym), F.lit("dollars"))
        whole = F.regexp_extract(num, r"^([0-9]*)\.", 1)
        cents = F.substring(F.concat(F.regexp_replace(num, r"^[^.]*\.", ""), F.lit("00")), 1, 2)
        with_cents = has(num, ".") & (cents != "00")
        return F.when(
            mag != "",
            F.concat(
                number_parts(num),
                F.array(part(LITERAL, lookup(MAGNITUDES, mag)), part(LITERAL, unit)),
            ),
        ).otherwise(
            F.array(
                F.when(has(num, "."), part(CARDINAL, F.when(whole == "", "0").otherwise(whole)))
                .when(_is_number(num), part(CARDINAL, num))
                .otherwise(part(LITERAL, num)),
                part(LITERAL, unit),
                part(LITERAL, F.when(with_cents, "and").otherwise("")),
                part(CARDINAL, F.when(with_cents, cents).otherwise("")),
                part(
                    LITERAL,
                    F.when(with_cents, F.coalesce(lookup(CENTS, sym), F.lit("cents"))).otherwise(""),
                ),
            )
        )

    return let(let(let(strip(surface), split), number), build)


def measure_parts(surface: Column) -> Column:
    """Number and unit; an unknown unit is said in lower case."""
    shape = rf"^([+-]?[0-9][0-9,]*\.?[0-9]*)[{SPACE}]*([a-zA-Z°%/]+)$"

    def build(m: Column) -> Column:
        text, num, unit = m["text"], m["num"], m["unit"]
        share = strip(F.regexp_replace(text, "%$", ""))
        return (
            F.when(
                num != "",
                F.concat(
                    number_parts(F.replace(num, F.lit(","), F.lit("")), raw=num),
                    F.array(part(LITERAL, F.coalesce(lookup(UNITS, unit), unit))),
                ),
            )
            .when(
                F.endswith(text, F.lit("%")),
                F.concat(number_parts(share), F.array(part(LITERAL, "percent"))),
            )
            .otherwise(F.array(part(LITERAL, text)))
        )

    text = strip(surface)
    return let(
        F.struct(
            text.alias("text"),
            F.regexp_extract(text, shape, 1).alias("num"),
            F.lower(F.regexp_extract(text, shape, 2)).alias("unit"),
        ),
        build,
    )


def time_parts(surface: Column) -> Column:
    """Clock time; a suffix glued to the minutes leaves the text unchanged."""
    suffix = rf"(?i){STARTS_WORD}([ap])\.?m\.?$"
    clock = r"^([0-9]{1,2}):([0-9]{2})$"
    text = strip(surface)
    body = strip(F.regexp_replace(text, suffix, ""))

    def build(t: Column) -> Column:
        half, hour, minute = t["half"], t["hour"], t["minute"]
        return F.when(hour == "", F.array(part(LITERAL, surface))).otherwise(
            F.array(
                part(CARDINAL, hour),
                part(
                    LITERAL,
                    F.when(minute == "00", F.when(half == "", "o'clock").otherwise(""))
                    .when(minute < "10", "oh")
                    .otherwise(""),
                ),
                part(CARDINAL, F.when(minute == "00", "").otherwise(minute)),
                part(LITERAL, F.when(half == "", "").otherwise(F.concat(half, F.lit(" m")))),
            )
        )

    return let(
        F.struct(
            F.lower(F.regexp_extract(text, suffix, 1)).alias("half"),
            F.regexp_extract(body, clock, 1).alias("hour"),
            F.regexp_extract(body, clock, 2).alias("minute"),
        ),
        build,
    )


def fraction_parts(surface: Column) -> Column:
    shape = rf"^([0-9]+)[{SPACE}]*/[{SPACE}]*([0-9]+)$"
    text = strip(surface)

    def build(f: Column) -> Column:
        top, below = f["top"], f["below"]
        one = F.ltrim(top, F.lit("0")) == "1"
        value = F.ltrim(below, F.lit("0"))
        named = F.when(value == "2", "half").when(value == "4", "quarter")
        return F.when(top == "", F.array(part(LITERAL, surface))).otherwise(
            F.array(
                part(CARDINAL, top),
                F.when(
                    named.isNotNull(), part(LITERAL, F.concat(named, F.when(one, "").otherwise("s")))
                ).otherwise(part(F.when(one, ORDINAL).otherwise(ORDINALS), below)),
            )
        )

    return let(
        F.struct(
            F.regexp_extract(text, shape, 1).alias("top"),
            F.regexp_extract(text, shape, 2).alias("below"),
        ),
        build,
    )


def ordinal_parts(surface: Column) -> Column:
    return F.array(part(ORDINAL, F.regexp_extract(surface, "^([0-9]+)", 1)))


def grouped_parts(surface: Column) -> Column:
    return F.array(part(CARDINAL, F.replace(surface, F.lit(","), F.lit(""))))


def cardinal_parts(surface: Column) -> Column:
    """A four-digit number from 1500 to 2099 is read as a year."""
    return F.when(_is_year(surface), year_parts(surface)).otherwise(F.array(part(CARDINAL, surface)))


def _is_year(surface: Column) -> Column:
    return (F.length(surface) == 4) & surface.between("1500", "2099")


def telephone_parts(surface: Column) -> Column:
    return F.array(part(DIGITS_OH, F.regexp_replace(surface, "[^0-9]", "")))


def electronic_parts(surface: Column) -> Column:
    """Symbols by name, digit runs digit by digit, short domains in lower case."""
    text = F.rtrim(
        F.regexp_replace(F.rtrim(strip(surface), F.lit(".,;:!?")), "^https?://", ""), F.lit("/")
    )

    def token(tok: Column) -> Column:
        return chain(
            [
                (lookup(SYMBOLS, tok).isNotNull(), part(LITERAL, lookup(SYMBOLS, tok))),
                (F.rlike(tok, F.lit(r"^\p{Nd}+$")), part(DIGITS_OH, ascii_digits(tok))),
                (tok == "www", part(LITERAL, "w w w")),
                (F.lower(tok).isin(DOMAINS), part(LITERAL, F.lower(tok))),
            ],
            part(LITERAL, tok),
        )

    pieces = F.regexp_extract_all(text, F.lit(r"[./:@_#&=\-]|[^./:@_#&=\-]+"), F.lit(0))
    return F.transform(pieces, token)


def roman_parts(surface: Column) -> Column:
    """Regnal words take an ordinal, structural words a cardinal."""
    shape = rf"^([^{SPACE}]+)[{SPACE}]+([^{SPACE}]+)$"

    def build(r: Column) -> Column:
        word, value = r["word"], r["value"].cast("string")
        regnal = F.lower(word).isin(REGNAL_WORDS)
        return F.when(value.isNull(), F.array(part(LITERAL, surface))).otherwise(
            F.array(
                part(LITERAL, word),
                part(LITERAL, F.when(regnal, "the").otherwise("")),
                part(F.when(regnal, ORDINAL).otherwise(CARDINAL), value),
            )
        )

    return let(
        F.struct(
            F.regexp_extract(surface, shape, 1).alias("word"),
            roman_value(F.regexp_extract(surface, shape, 2)).alias("value"),
        ),
        build,
    )


def abbreviation_parts(surface: Column) -> Column:
    key = F.rtrim(F.lower(surface), F.lit("."))
    return F.array(
        part(LITERAL, F.coalesce(lookup(FIRST_READINGS, key), lookup(ABBREVIATIONS, key), surface))
    )


def abbreviation(token: Column) -> Column:
    """Unambiguous abbreviations only; others stay."""
    return F.coalesce(lookup(ABBREVIATIONS, F.rtrim(F.lower(token), F.lit("."))), token)


# Which parts each span class is read with.
PARTS = {
    "ELECTRONIC": electronic_parts,
    "MONEY": money_parts,
    "TELEPHONE": telephone_parts,
    "TIME": time_parts,
    "MEASURE": measure_parts,
    "ROMAN": roman_parts,
    "FRACTION": fraction_parts,
    "ORDINAL": ordinal_parts,
    "DECIMAL": decimal_parts,
    "CARDINAL_G": grouped_parts,
    "CARDINAL": cardinal_parts,
    "ABBREV": abbreviation_parts,
}


def spoken(cls: Column, surface: Column) -> Column:
    """Reading of a surface of the given class."""
    text = F.when(cls.isin("ELECTRONIC", "ABBREV"), surface).otherwise(ascii_digits(surface))

    def read(txt: Column) -> Column:
        cases = [(cls == name, build(txt)) for name, build in PARTS.items() if name != "CARDINAL"]
        # Plain numbers are by far the most frequent spans and need no parts.
        number = F.when(_is_year(txt), four_digit_year(txt)).otherwise(cardinal(txt))
        return F.when(cls == "CARDINAL", number).otherwise(speak(chain(cases, F.array(part(LITERAL, txt)))))

    return let(text, read)


def read_as(cls: str, surface: Column) -> Column:
    """Reading under one fixed class."""
    return let(surface, lambda s: speak(PARTS[cls](s)))
