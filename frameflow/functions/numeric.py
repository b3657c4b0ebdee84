"""Rounding and clamping with the document's conventions: halves go up, absent stays null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 4) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits: halves go toward plus infinity, on negatives too."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def share(x: Column) -> Column:
    """A fraction: null, NaN, infinite and negative values are 0, values above 1 are 1."""
    finite = x.isNotNull() & ~F.isnan(x) & (x < float("inf")) & (x >= 0)
    return F.when(finite, F.least(x, F.lit(1.0))).otherwise(0.0)


def finite_or_null(x: Column) -> Column:
    """NaN and infinities are null, -0 is 0."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x + F.lit(0.0))


def number_or(x: Column, otherwise: float) -> Column:
    """A finite number, or what holds where there is none; texts count as the numbers they spell."""
    return F.coalesce(finite_or_null(x.try_cast("double")), F.lit(float(otherwise)))


def clamped_or(x: Column, otherwise: float, least: float) -> Column:
    """number_or, and never below ``least``."""
    return F.greatest(F.lit(float(least)), number_or(x, otherwise))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once for a row, however often body reads it."""
    return F.transform(F.array(value), body)[0]
