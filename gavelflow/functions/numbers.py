"""Rounding and bounds. Money is BIGINT cents; halves round up, also below zero."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(x: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(x.cast("double") + F.lit(0.5)).cast("long")


def clamped(x: Column, low, high) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.least(F.greatest(x, low), high)


def to_places(x: Column, n: int) -> Column:
    """Rounded to n decimal places, halves up; what binary fractions add beyond n + 6 places doesn't count."""
    return F.floor(F.round(x * F.lit(10.0**n), 6) + F.lit(0.5)) / F.lit(10.0**n)


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that later ones read often: the generator keeps the optimizer from
    writing their expressions into each reader."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once however often ``of`` writes it."""
    return F.transform(F.array(value), of)[0]
