"""Roman numerals as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols of a numeral and their values, largest first.
PLACES = [("m", 1000), ("cm", 900), ("d", 500), ("cd", 400), ("c", 100), ("xc", 90), ("l", 50), ("xl", 40), ("x", 10), ("ix", 9), ("v", 5), ("iv", 4), ("i", 1)]
LETTERS = {s: v for s, v in PLACES if len(s) == 1}
STRICT = r"^m{0,4}(cm|cd|d?c{0,4})(xc|xl|l?x{0,4})(ix|iv|v?i{0,4})$"


def roman_is_strict(text: Column) -> Column:
    """Whether a lower-case text is a well-formed numeral: up to four repeats of a place."""
    return (F.length(text) > 0) & text.rlike(STRICT)


def roman_value(text: Column) -> Column:
    """The subtractive sum from right to left: a smaller letter before a larger one counts against.
    Null for a text with other letters or none."""
    values = F.transform(F.split(F.reverse(text), ""), lambda c: F.coalesce(*[F.when(c == s, v) for s, v in LETTERS.items()]))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("most"))
    step = lambda s, v: F.struct(
        F.when(v < s["most"], s["sum"] - v).otherwise(s["sum"] + v).alias("sum"), F.greatest(s["most"], v).alias("most")
    )
    return F.when(text.rlike("^[mdclxvi]+$"), F.aggregate(values, start, step)["sum"]).cast("long")


def roman_numeral(number: Column) -> Column:
    """The numeral of a number from 1 to 4999."""
    n, parts = number, []
    for symbol, value in PLACES:
        times = F.floor(n / value).cast("int")
        parts.append(F.repeat(F.lit(symbol), times))
        n = n % value
    return F.concat(*parts)
