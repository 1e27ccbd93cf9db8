"""Rounding of the exact value of a double, as some languages' round() does it, and not of its shortest decimal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import bound

#: Splits a double into halves of 26 bits.
SPLITTER = float((1 << 27) + 1)


def _halves(x: Column) -> tuple[Column, Column]:
    c = x * SPLITTER
    high = c - (c - x)
    return high, x - high


def exact_round(x: Column, places: int) -> Column:
    """x rounded to so many places (0 to 9), half to even, by its exact binary value: 2.675 is below its text, so 2.67.

    bround() rounds the shortest decimal text. That differs only where the text ends in a 5 behind the last place: there the
    sign of x - text decides, which is found without error from the product of x and a power of ten, split in halves.
    """
    scale = 10.0 ** (places + 1)

    def made(v: Column) -> Column:
        text = v.cast(f"decimal(38,{places + 9})")
        tie = F.abs(text * int(scale)) % 10 == 5
        p = v * scale
        (a, b), (c, d) = _halves(v), _halves(F.lit(scale))
        # p and the error of p are v * scale exactly, and text * scale is a whole number
        error = ((a * c - p) + a * d + b * c) + b * d
        over = (p - F.bround(p, 0)) + error
        step = F.lit(10.0 ** -(places + 2)).cast(f"decimal(38,{places + 9})")
        near = F.when(over > 0, F.bround(text + step, places)).when(over < 0, F.bround(text - step, places)).otherwise(F.bround(text, places))
        # beyond 2 ** 46 doubles are further apart than what could be a tie at these places
        return F.when(F.isnan(v) | (F.abs(v) >= float(1 << 46)), F.bround(v, places)).when(tie, near.cast("double")).otherwise(F.bround(v, places))

    return bound(x.cast("double"), made)
