"""Number words and readings: fixed values, and agreement of the number table with itself."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from speakable.functions import readings as R
from speakable.functions import words as W
from speakable.plans.numbers import rule_telephone

READINGS = [
    ("MONEY", "$5.2M", "five point two million dollars"),
    ("MONEY", "$1,234.50", "one thousand two hundred thirty four dollars and fifty cents"),
    ("MONEY", "$1", "one dollars"),
    ("MONEY", "£2.05", "two pounds and five pence"),
    ("MONEY", "¥7.5", "seven yen and fifty cents"),
    ("MONEY", "$7.00", "seven dollars"),
    ("MONEY", "€3bn", "three billion euros"),
    ("MONEY", "USD 5", "five dollars"),
    ("MEASURE", "5km", "five kilometers"),
    ("MEASURE", "20%", "twenty percent"),
    ("MEASURE", "3.5 kg", "three point five kilograms"),
    ("MEASURE", "5 lbs", "five lbs"),
    ("MEASURE", "20 °C", "twenty degrees celsius"),
    ("MEASURE", "-5%", "-5 percent"),
    ("TIME", "3:30 PM", "three thirty p m"),
    ("TIME", "3:30PM", "3:30PM"),
    ("TIME", "9:00", "nine o'clock"),
    ("TIME", "9:00 am", "nine a m"),
    ("TIME", "12:05", "twelve oh five"),
    ("TIME", "13:00", "thirteen o'clock"),
    ("FRACTION", "3/4", "three quarters"),
    ("FRACTION", "1/2", "one half"),
    ("FRACTION", "2/2", "two halfs"),
    ("FRACTION", "5/12", "five twelfths"),
    ("ORDINAL", "21st", "twenty first"),
    ("ORDINAL", "120th", "one hundred twentieth"),
    ("DECIMAL", "3.14", "three point one four"),
    ("DECIMAL", ".5", "zero point five"),
    ("DECIMAL", "-0.50", "negative zero point five zero"),
    ("CARDINAL_G", "1,204", "one thousand two hundred four"),
    ("CARDINAL", "007", "seven"),
    ("CARDINAL", "1984", "nineteen eighty four"),
    ("CARDINAL", "2100", "two thousand one hundred"),
    ("TELEPHONE", "(800) 273-8255", "eight oh oh two seven three eight two five five"),
    ("ELECTRONIC", "https://www.example.com/", "w w w dot example dot com"),
    ("ELECTRONIC", "info@harrow.org", "info at harrow dot org"),
    ("ELECTRONIC", "http://a.b/x?p=20", "a dot b slash x?p equals two oh"),
    ("ROMAN", "Henry VIII", "Henry the eighth"),
    ("ROMAN", "Chapter IV", "Chapter four"),
    ("ROMAN", "act did", "act did"),
    ("ABBREV", "St.", "saint"),
    ("ABBREV", "Dr", "doctor"),
    ("ABBREV", "e.g.", "for example"),
]


def test_readings(spark):
    df = spark.createDataFrame([(c, s, e) for c, s, e in READINGS], "cls string, surface string, expected string")
    rows = df.select("*", R.spoken(F.col("cls"), F.col("surface")).alias("got")).collect()
    assert [(r.cls, r.surface, r.got) for r in rows] == [(r.cls, r.surface, r.expected) for r in rows]


@pytest.mark.parametrize(
    "fn, value, expected",
    [
        (W.cardinal, "0", "zero"),
        (W.cardinal, "1234", "one thousand two hundred thirty four"),
        (W.cardinal, "1000000000000000", "one quadrillion"),
        (W.cardinal, "1234567890123456789", "one quintillion two hundred thirty four quadrillion five hundred sixty seven trillion eight hundred ninety billion one hundred twenty three million four hundred fifty six thousand seven hundred eighty nine"),
        (W.signed_cardinal, "-12", "negative twelve"),
        (W.ordinal, "21", "twenty first"),
        (W.ordinal, "1000", "one thousandth"),
        (W.year, "1984", "nineteen eighty four"),
        (W.year, "2000", "two thousand"),
        (W.year, "2007", "two thousand seven"),
        (W.year, "1905", "nineteen oh five"),
        (W.year, "1900", "nineteen hundred"),
        (W.year, "1000", "ten hundred"),
        (W.year, "999", "nine hundred ninety nine"),
        (W.year, "10000", "ten thousand"),
        (W.decade, "1980", "nineteen eighties"),
        (W.decade, "1900", "nineteen hundreds"),
        (W.decade, "2000", "two thousands"),
        (W.decade, "2010", "twenty tens"),
        (W.spell_digits, "007", "oh oh seven"),
        (W.roman_words, "XIV", "fourteen"),
        (W.roman_words, "IIII", "IIII"),
    ],
)
def test_words(spark, fn, value, expected):
    assert spark.range(1).select(fn(F.lit(value)).alias("w")).first()["w"] == expected


def test_roman_round_trip(spark):
    df = spark.range(1, 4000).withColumn("r", W.to_roman(F.col("id")))
    assert df.filter(W.roman_value(F.col("r")) != F.col("id")).count() == 0
    assert df.select("r").distinct().count() == 3999


def test_foreign_digits(spark):
    got = spark.range(1).select(R.read_as("CARDINAL", W.ascii_digits(F.lit("٤٢"))).alias("w")).first()["w"]
    assert got == "forty two"


def test_long_numbers(spark):
    """Groups of three with the names of the powers of a thousand, against a plain loop."""
    import random

    def plain(text):
        small = lambda n: W._below_thousand()[n]
        text = text.lstrip("0") or "0"
        groups, rest = [], text
        while rest:
            groups.append(int(rest[-3:]))
            rest = rest[:-3]
        if len(groups) > 22:
            return " ".join(W.ONES[int(c)] for c in text)
        said = [f"{small(g)} {W.ALL_SCALES[k]}".strip() for k, g in reversed(list(enumerate(groups))) if g]
        return " ".join(said) or "zero"

    rng = random.Random(9)
    numbers = ["1" + "0" * k for k in (17, 18, 19, 30, 63, 65, 66, 70)] + [str(rng.randrange(10**k)) for k in range(15, 66, 3)]
    df = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", W.cardinal(F.col("n")).alias("said"))
    assert {r.n: r.said for r in df.collect()} == {n: plain(n) for n in numbers}


def test_telephone_says_every_digit(spark, tmp_path):
    """Numbers of ten and, with large keys, of eleven digits."""
    keys = [7, 561_938, 900_000, 900_001]
    spark.createDataFrame([(k,) for k in keys], "c_custkey bigint").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    names = ["oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    got = {r.id: r.spoken for r in rule_telephone(spark, str(tmp_path)).collect()}
    assert got == {k: " ".join(names[int(d)] for d in str(5_550_000_000 + k * 7919)) for k in keys}
