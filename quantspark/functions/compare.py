"""Comparisons that do not hold where a side is not a number, as IEEE 754 has it; Spark orders NaN above all numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gt(a: Column, b: Column | float) -> Column:
    return (a > b) & ~F.isnan(a)


def ge(a: Column, b: Column | float) -> Column:
    return (a >= b) & ~F.isnan(a)


def lt(a: Column, b: Column) -> Column:
    return (a < b) & ~F.isnan(b)


def le(a: Column, b: Column) -> Column:
    return (a <= b) & ~F.isnan(b)


def number(c: Column) -> Column:
    """c, null where it is not a number."""
    return F.when(~F.isnan(c), c)
