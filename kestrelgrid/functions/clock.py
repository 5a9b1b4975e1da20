"""Seconds on a clock, as whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds beyond which a clock reading has no millisecond count in a BIGINT that later sums can't overflow.
CLOCK_LIMIT_S = 9.0e12


def millis(seconds: Column) -> Column:
    """Whole milliseconds of a DOUBLE in seconds, rounded half up.

    NULL for NULL, NaN, the infinities and readings beyond ``CLOCK_LIMIT_S``, under ANSI mode too: NaN and +inf sort
    above every number in Spark, so the range test turns them away before the cast.
    """
    return F.when(seconds.between(-CLOCK_LIMIT_S, CLOCK_LIMIT_S), F.floor(seconds * 1000 + F.lit(0.5)))


def floor_div(a: Column, b: Column) -> Column:
    """Floor of a / b for BIGINT a and positive BIGINT b, exact for negative a; NULL where b is NULL or not positive."""
    return F.when(b > 0, (a - F.pmod(a, b)) / b).cast("bigint")
