"""Flags, numbers and times as logs write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What logs write for true.
TRUE_WORDS = ("1", "true", "yes", "y")


def flag(text: Column) -> Column:
    """Whether a text says yes; NULL for NULL."""
    return F.lower(F.trim(text)).isin(*TRUE_WORDS)


def number_or_fraction(text: Column) -> Column:
    """A number, or one divided by another (1/250); NULL where it is neither or the divisor is 0."""
    parts = F.split(F.trim(text), "/")
    a, b = (F.get(parts, F.lit(k)).try_cast("double") for k in (0, 1))
    return F.when(F.size(parts) == 1, a).when(F.size(parts) == 2, F.try_divide(a, b))


def epoch_seconds(text: Column) -> Column:
    """Seconds since 1970 of an ISO 8601 time, UTC where no zone is stated; NULL where it is none."""
    zoned = F.when(F.trim(text).rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.trim(text)).otherwise(F.concat(F.trim(text), F.lit("Z")))
    return F.unix_micros(F.try_to_timestamp(zoned)) / 1_000_000


def byte_of_share(value: Column) -> Column:
    """A share of 0 to 1 as a byte, halves to even; shares beyond are cut off."""
    return F.when(value.isNotNull(), F.rint(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))
