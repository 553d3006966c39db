"""Columns on vectors that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A component is turned into floor(SCALE * x).
SCALE = 256


def finite(v: Column) -> Column:
    """Whether an array of doubles is there, without null, NaN or infinite components."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole(v: Column) -> Column:
    """The components as integers, floor(SCALE * x)."""
    return F.transform(v, lambda x: F.floor(x * SCALE))


def within(v: Column, most: int) -> Column:
    """Whether no component of an array of doubles is further from 0 than most, in units of 1 / SCALE."""
    return F.forall(v, lambda x: F.abs(x * SCALE) <= most)
