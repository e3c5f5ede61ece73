"""Numbers in text: which text is one, on the driver and in columns."""

from __future__ import annotations

import re
from math import isfinite

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The decimal numbers of the language, and the whole ones among them.
_DECIMAL = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
_INTEGER = r"[+-]?[0-9]+"
#: For columns. (Java's ``$`` would let a line feed follow.)
DECIMAL, INTEGER = rf"^(?:{_DECIMAL})\z", rf"^(?:{_INTEGER})\z"
#: Decimal digits of a step, and bits of one: a remainder of so many bits times 10**DIGITS stays within 63 bits.
DIGITS, BITS = 9, 29


def parse_number(text: str) -> int | float | None:
    """The number that ``text`` spells exactly: integers that a double can't hold are none."""
    if not re.fullmatch(_DECIMAL, text):
        return None
    value = float(text)
    if not isfinite(value):
        return None
    if re.fullmatch(_INTEGER, text):
        digits = text.lstrip("+-").lstrip("0") or "0"  # a finite double has no more than 309
        return int(value) if int(digits) == int(abs(value)) else None
    return int(value) if value.is_integer() and abs(value) < 2**63 else value


def number_column(text: Column) -> Column:
    """The number that each text spells, as a double; null for any other text."""
    value = F.when(text.rlike(DECIMAL), text.try_cast("double"))
    short = F.length(text) <= 15  # so many digits are always exact
    digits = F.regexp_replace(text, "^[+-]?0*", "")
    exact = F.when(short | ~text.rlike(INTEGER) | (F.length(digits) <= 15), F.lit(True)).otherwise(_is_exact(digits, F.abs(value)))
    return F.when((F.abs(value) < float("inf")) & exact, value)


def _is_exact(digits: Column, value: Column) -> Column:
    """Whether the whole number of so many digits, without zeros before them, is the double next to it.

    It is if all its bits below the 53 highest are zero, that is, if a power of two divides it. The division is done by
    hand, BITS bits at a time, on groups of DIGITS digits.
    """
    about = F.floor(F.log2(value)).cast("int")
    power = lambda n: F.pow(F.lit(2.0), n)
    top = F.when(power(about) > value, about - 1).when(power(about + 1) <= value, about + 1).otherwise(about)
    spare = top - 52
    groups = F.ceil(F.length(digits) / DIGITS).cast("int")
    padded = F.lpad(digits, groups * DIGITS, "0")
    number = F.transform(F.sequence(F.lit(0), groups - 1), lambda i: F.substring(padded, i * DIGITS + 1, F.lit(DIGITS)).cast("long"))
    # In steps of BITS bits, the last one of what is left.
    steps = F.transform(F.sequence(F.lit(0), F.ceil(spare / BITS).cast("int") - 1), lambda i: F.least(F.lit(BITS), spare - i * BITS))
    none = F.array().cast("array<bigint>")

    def divided(number: Column, bits: Column) -> Column:
        whole = lambda done, group: done["rest"] * 10**DIGITS + group
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        step = lambda done, group: F.struct(F.concat(done["number"], F.array(F.call_function("shiftright", whole(done, group), bits))).alias("number"), whole(done, group).bitwiseAND(mask).alias("rest"))
        return F.aggregate(number, F.struct(none.alias("number"), F.lit(0).cast("long").alias("rest")), step)

    start = F.struct(number.alias("number"), F.lit(0).cast("long").alias("rest"))
    # Where a remainder is left, the number stays undivided and the remainder is carried to the end.
    left = F.aggregate(steps, start, lambda done, bits: F.when(done["rest"] > 0, done).otherwise(divided(done["number"], bits)), lambda done: done["rest"])
    return F.when(spare <= 0, F.lit(True)).otherwise(left == 0)
