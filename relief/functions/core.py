"""Finite tests, rounding and clamps used by every operator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS32 = 1.1920928955078125e-07
EPS64 = 2.220446049250313e-16


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: Column | str) -> Column:
    return as_col(c).cast("double")


def is_finite(c: Column | str) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    c = as_col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite_or_null(c: Column | str) -> Column:
    """Only finite numbers leave the engine."""
    c = as_col(c)
    return F.when(is_finite(c), c)


def half_even(c: Column | str, digits: int = 0) -> Column:
    """Round half to even; Spark's `round` rounds half up."""
    c = dbl(c)
    if digits == 0:
        return F.rint(c)
    scale = float(10**digits)
    # the added zero turns -0.0 into 0.0
    return F.rint(c * scale) / scale + F.lit(0.0)


def half_up(c: Column | str) -> Column:
    """Round half towards +infinity, the rule browsers use."""
    return F.floor(dbl(c) + 0.5)


def clamp(c: Column | str, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(high, F.greatest(low, as_col(c)))


def valid_cell(value: Column | str, *masks: Column | str, nodata: Column | None = None) -> Column:
    """P10: every mask holds, the value is finite and is not the no-data marker."""
    test = is_finite(value)
    for mask in masks:
        test = test & F.coalesce(as_col(mask), F.lit(False))
    if nodata is not None:
        # compared as 32-bit: that is how the band is stored
        hit = as_col(value).cast("float") == nodata.cast("float")
        test = test & ~F.coalesce(hit, F.lit(False))
    return test
