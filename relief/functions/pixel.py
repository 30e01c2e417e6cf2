"""Scalar pixel math that needs at most a scene's own statistics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from relief.functions.core import EPS32, as_col, clamp, dbl, is_finite


def stretch_band(value: Column | str, ok: Column, low: Column, high: Column, minimum: Column, maximum: Column) -> Column:
    """Percentile stretch of a band to 0..255.

    Falls back to the full range, then to mid-grey; invalid cells are 0.
    """
    flat = ~F.coalesce(is_finite(low) & is_finite(high) & (high > low), F.lit(False))
    a = F.when(flat, minimum).otherwise(low)
    b = F.when(flat, maximum).otherwise(high)
    scaled = clamp(F.try_divide(dbl(value) - a, b - a), 0.0, 1.0)
    return (
        F.when(~ok, F.lit(0.0)).when(b <= a, F.lit(127.0)).otherwise(F.rint(scaled * 255.0)).cast("int")
    )


def preview_unit(value: Column | str, ok: Column, low: Column, high: Column, minimum: Column, maximum: Column) -> Column:
    """[0, 1] preview value; constant scenes give 0.5, invalid cells 0."""
    flat = ~F.coalesce(is_finite(low) & is_finite(high) & (high > low), F.lit(False))
    a = F.when(flat, minimum).otherwise(low)
    b = F.when(flat, maximum).otherwise(high)
    return (
        F.when(~ok, F.lit(0.0))
        .when(b <= a, F.lit(0.5))
        .otherwise(clamp(F.try_divide(dbl(value) - a, b - a), 0.0, 1.0))
    )


def quantise16(value: Column | str, low: Column, high: Column) -> Column:
    """16-bit code over the scene's own range, ties to even."""
    span = high - low
    unit = clamp(F.try_divide(dbl(value) - low, span), 0.0, 1.0)
    return F.when(span <= EPS32, F.lit(0)).otherwise(F.rint(unit * 65535.0)).cast("int")


def dequantise(code: Column | str, low: Column, high: Column, levels: float = 255.0) -> Column:
    """Value of a quantised cell; 255 levels for 8-bit readers, 65535 for 16-bit."""
    return low + dbl(code) / levels * (high - low)


def high_byte(code16: Column | str) -> Column:
    """The byte an 8-bit reader sees of a 16-bit grey value."""
    return F.shiftright(as_col(code16).cast("int"), 8)


def mask_bit(byte: Column | str) -> Column:
    return as_col(byte) > 127


def normal_bytes(dx: Column, dy: Column, strength: float = 1.0) -> dict[str, Column]:
    """Surface normal as three truncated bytes, green with the row axis up."""
    s = max(float(strength), 1e-3)
    nx, ny = -dx * s, -dy * s
    length = F.sqrt(nx * nx + ny * ny + 1.0)
    code = lambda c: F.floor((c * 0.5 + 0.5) * 255.0).cast("int")
    return {"nr": code(nx / length), "ng": code(-(ny / length)), "nb": code(F.lit(1.0) / length)}


def vegetation(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """Green excess of a foliage cell."""
    r, g, b = dbl(r), dbl(g), dbl(b)
    return (g - 0.5 * (r + b) > 12.0) & (g > 45.0)


def water(r: Column | str, g: Column | str, b: Column | str) -> Column:
    r, g, b = dbl(r), dbl(g), dbl(b)
    # products are compared as 32-bit, the type the bytes are widened to
    return (b - r > 14.0) & (b >= (g * F.lit(0.92)).cast("float").cast("double")) & (g < 165.0)


def decoded_size_problem(width: Column, height: Column, limit: int | None = None) -> Column:
    """Why a raster of this size is refused, or NULL; any size passes without a limit."""
    pixels = width.cast("long") * height.cast("long")
    empty = F.when((width < 1) | (height < 1), F.lit("contains no raster pixels"))
    if limit is None:
        return empty
    return empty.when(
        pixels > limit, F.format_string("has %,d decoded pixels; the configured limit is %,d", pixels, F.lit(limit).cast("long"))
    )


def domain_unit(value: Column, minimum: Column, maximum: Column) -> Column:
    """P25: height on [0, 1]; a domain that already is [0, 1] is only clamped."""
    span = maximum - minimum
    # `||` in the viewer: a zero or missing range counts as 1
    span = F.when(F.coalesce(span, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(span)
    unit = already_unit(minimum, maximum)
    return clamp(F.when(unit, value).otherwise((value - minimum) / span), 0.0, 1.0)


def already_unit(minimum: Column, maximum: Column) -> Column:
    span = F.when(maximum - minimum == 0, F.lit(1.0)).otherwise(maximum - minimum)
    return (minimum >= -0.01) & (maximum <= 1.01) & (span <= 1.02)


def shadow_height(length: Column, pixel_size: Column, elevation_degrees: Column) -> Column:
    """P20: object height from shadow length and sun elevation."""
    return length * pixel_size * F.tan(F.radians(elevation_degrees))
