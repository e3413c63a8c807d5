"""Column expressions that read numbers and unit words from short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words as they are written out in reports.
NUMBER_WORDS = {
    "half": "0.5", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17",
    "eighteen": "18", "nineteen": "19", "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90",
}

NUMBER = r"[+-]?(?:\d[\d,]*(?:\.\d+)?|\.\d+)(?:e[+-]?\d+)?"
SCALE = r"(?:[x×*]\s*10(?:\^|\*\*)?[-⁻−+]?[\d⁰¹²³⁴⁵⁶⁷⁸⁹]*|10\^[-−+]?\d+|[x×*]\s*\d+|hundred|thousand|million)"
_SUPERS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁻−"
_PLAIN = "0123456789--"


def plain_text(c: Column) -> Column:
    """Lower case, one kind of micro sign, single spaces, trimmed."""
    t = F.translate(F.lower(c), "µμ  \t\r\n", "uu     ")
    return F.trim(F.regexp_replace(t, r" {2,}", " "))


def number_value(c: Column) -> Column:
    """A number as a double; a comma before exactly three digits separates thousands, any other is a decimal one.

    Text that is no number gives null.
    """
    t = F.regexp_replace(c, r",(?=\d{3}(?!\d))", "")
    return F.replace(t, F.lit(","), F.lit(".")).try_cast("double")


def plain_scale(c: Column) -> Column:
    """A multiplier without spaces and signs of times, raised digits as ``10^n``."""
    t = F.regexp_replace(c, r"[\s+]", "")
    t = F.regexp_replace(t, r"10(?=[⁻−⁰¹²³⁴⁵⁶⁷⁸⁹])", "10^")
    return F.regexp_replace(F.translate(t, _SUPERS, _PLAIN), r"^[x×*]|\*\*", "")


def scale_value(t: Column) -> Column:
    """The factor of a multiplier from :func:`plain_scale` (``1000``, ``10^-2``, ``hundred``); none is 1, an unknown one null."""
    power = F.regexp_extract(t, r"^10\^?(-?\d+)$", 1).try_cast("double")
    return (
        F.when(t.isNull() | (t == ""), F.lit(1.0))
        .when(t == "hundred", F.lit(100.0))
        .when(t == "thousand", F.lit(1e3))
        .when(t == "million", F.lit(1e6))
        .when(t.rlike(r"^\d+$"), t.try_cast("double"))
        .otherwise(F.pow(F.lit(10.0), power))
    )


def unit_words(c: Column) -> Column:
    """One spelling for writing habits that say nothing: dots, spaces at a slash, ``per``, negative powers."""
    t = F.regexp_replace(c, r"[·*⋅]\s*([a-z]+)\s*(?:⁻¹|\^-1|-1)$", "/$1")
    t = F.regexp_replace(t, r"\s*(?:/|\bper\b)\s*", "/")
    return F.trim(F.regexp_replace(t, r"[.\s]+$", ""))


def digits_for_words(c: Column) -> Column:
    """A leading number word as digits."""
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    first = F.regexp_extract(c, r"^[a-z]*", 0)
    return F.concat(F.coalesce(F.try_element_at(words, first), first), F.regexp_replace(c, r"^[a-z]+", ""))
