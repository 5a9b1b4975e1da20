"""Rounding that two engines agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def steady(value: Column, digits: int) -> Column:
    """Rounded to ``digits``; what lies within a millionth of a half goes up, so that the last bits of a double decide nothing."""
    return F.floor(value * 10**digits + F.lit(0.500001)) / 10**digits


def steady_sql(value: str, digits: int) -> str:
    return f"floor(({value}) * {10**digits} + 0.500001) / {10**digits}"
