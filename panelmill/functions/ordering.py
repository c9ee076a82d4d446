"""Doubles as whole numbers of the same order, cut into digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A key has four digits of sixteen bits, so a group of equal leading digits has at most 65,536 next ones.
DIGITS, DIGIT_BITS = 4, 16


def sort_key(x: Column) -> Column:
    """A long that orders as the double does; NULL for NULL, equal for both zeros, NaN above all numbers.

    The bits of a double order as whole numbers do if its sign bit is clear;
    otherwise all other bits are turned over.  The bits come from the Java
    class, which makes the expression non-deterministic for the planner: select
    it into a column before grouping by it.
    """
    # Adding zero makes the negative zero positive.
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x + F.lit(0.0)).cast("long")
    turned = F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)
    return F.when(x.isNotNull(), turned)


def leading(key: Column, digits: int) -> Column:
    """The first ``digits`` digits of a key, in the order of keys."""
    return F.shiftright(key, DIGIT_BITS * (DIGITS - digits))
