"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dekker's constant: splits a double into two halves that multiply exactly.
_SPLIT = float(2**27 + 1)
# A power of two that cuts a large whole number into two that fit a bigint.
_CUT = 2.0**40


def _whole(size: Column) -> Column:
    """All digits of a whole, non-negative double below 2**100."""
    high = F.floor(size / _CUT)
    low = size - high * _CUT
    exact = high.cast("decimal(19,0)") * F.lit(int(_CUT)).cast("decimal(13,0)")
    return exact.cast("decimal(37,0)") + low.cast("bigint").cast("decimal(37,0)")


def format_metric(c: Column) -> Column:
    """A double with four decimals, rounded from its exact binary value.

    ``format_string`` rounds the shortest decimal form half up, which differs
    where that form ends in a 5. Whole part and fraction are both exact in a
    double; the fraction's product with 10**4 is taken together with its
    rounding error, so ties are seen as what they are, and true ties go to the
    even digit. Sizes from 2**100 on are an error.
    """
    c = c.cast("double")
    special = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(
        c == float("-inf"), "-inf"
    )
    too_large = F.raise_error(F.lit("A metric of 2**100 or more")).cast("string")
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(special.isNotNull(), special)
        .when(F.abs(c) >= 2.0**100, too_large)
        .otherwise(_four_decimals(c))
    )


def _four_decimals(c: Column) -> Column:
    size = F.abs(c)
    rest = size % 1.0
    product = rest * 10_000.0
    high = rest * _SPLIT - (rest * _SPLIT - rest)
    low = rest - high
    error = (high * 10_000.0 - product) + low * 10_000.0
    units = F.floor(product)
    fraction = product - units
    up = (fraction > 0.5) | (
        (fraction == 0.5) & ((error > 0) | ((error == 0) & (units % 2 == 1)))
    )
    units = units + F.when(up, 1).otherwise(0)
    whole = _whole(size - rest) + F.when(units == 10_000, 1).otherwise(0).cast("decimal(1,0)")
    return F.concat(
        F.when((c < 0) | (c.cast("string") == "-0.0"), "-").otherwise(""),
        whole.cast("string"),
        F.lit("."),
        F.lpad((units % 10_000).cast("string"), 4, "0"),
    )


def format_hms(seconds: Column) -> Column:
    """Seconds as HH:MM:SS; fractions are dropped and hours are not bounded."""
    s = seconds.cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    )
