"""Numbers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves of 26 bits.
_SPLIT = 134_217_729.0
#: A product with the power of ten from here on: what is rounded off is less than the double can tell.
_LARGE = 2.0**52


def rounded(value: Column, digits: int) -> Column:
    """A double rounded to at most six decimals by its exact binary value, halves to even, as Python's `round` does.

    2.675 is a little less than it reads and becomes 2.67; 0.125 is exact and becomes 0.12. The product with the power of
    ten is held as a sum of two doubles without any error. Null, NaN, infinite and very large values stay as they are.
    """
    if not 0 <= digits <= 6:
        raise ValueError("from none to six decimals")
    x, power = value.cast("double"), F.lit(10.0**digits)
    high = x * _SPLIT - (x * _SPLIT - x)
    product = x * power
    error = (high * power - product) + (x - high) * power
    whole = F.floor(product).cast("double")
    # how far the exact product lies beyond the half, by sign
    beyond = (product - whole - 0.5) + error
    up = (beyond > 0) | ((beyond == 0) & (F.pmod(whole, F.lit(2.0)) == 1))
    near = F.when(up, whole + 1).otherwise(whole) / power
    return F.when(F.abs(x) < _LARGE / 10.0**digits, near).otherwise(x)
