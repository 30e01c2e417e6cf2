"""Colour ramps as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from relief.functions.core import clamp, dbl, half_up

# Ramp stops (position, red, green, blue) and the invalid colour.
PREVIEW_RAMP = (
    (0.0, 24, 35, 82),
    (0.22, 31, 104, 165),
    (0.48, 37, 184, 164),
    (0.72, 221, 213, 83),
    (1.0, 249, 134, 38),
)
PREVIEW_INVALID = (15, 20, 31)
CANVAS_RAMP = (
    (0.0, 9, 20, 38),
    (0.24, 26, 63, 102),
    (0.48, 24, 139, 141),
    (0.72, 91, 201, 147),
    (1.0, 246, 211, 112),
)
TERRAIN_RAMP = (
    (0.0, "#0c2033"),
    (0.22, "#15536e"),
    (0.48, "#2a8c88"),
    (0.74, "#6ad19f"),
    (1.0, "#fae28c"),
)
WALL_COLOUR = "#8d9199"


def hex_to_linear(text: str) -> tuple[float, float, float]:
    """sRGB hex to linear light, the working space of vertex colours."""
    out = []
    for i in (1, 3, 5):
        c = int(text[i : i + 2], 16) / 255.0
        out.append(c / 12.92 if c < 0.04045 else ((c + 0.055) / 1.055) ** 2.4)
    return tuple(out)


def _stop(position: float) -> Column:
    # stop positions are held as 32-bit floats
    return F.lit(position).cast("float").cast("double")


def preview_colour(unit: Column, valid: Column, ramp: Sequence = PREVIEW_RAMP) -> dict[str, Column]:
    """Piecewise linear colour truncated to a byte."""
    x = clamp(dbl(unit), 0.0, 1.0)
    out = {}
    for channel, name in enumerate(("red", "green", "blue"), start=1):
        value = F.lit(float(ramp[-1][channel]))
        for lower, upper in reversed(list(zip(ramp, ramp[1:]))):
            slope = F.lit(float(upper[channel] - lower[channel])) / (_stop(upper[0]) - _stop(lower[0]))
            value = F.when(x < _stop(upper[0]), slope * (x - _stop(lower[0])) + float(lower[channel])).otherwise(value)
        out[name] = F.when(valid, F.floor(value)).otherwise(F.lit(PREVIEW_INVALID[channel - 1])).cast("int")
    return out


def ramp_between(unit: Column, ramp: Sequence, rounded: bool) -> dict[str, Column]:
    """Colour between the first stop not below the value and its predecessor."""
    colours = [c[1:] if not isinstance(c[1], str) else hex_to_linear(c[1]) for c in ramp]
    out = {}
    for channel, name in enumerate(("red", "green", "blue")):
        value = F.lit(float(colours[0][channel]))
        for k in range(len(ramp) - 1, 0, -1):
            low, high = float(colours[k - 1][channel]), float(colours[k][channel])
            amount = (unit - ramp[k - 1][0]) / (ramp[k][0] - ramp[k - 1][0])
            piece = F.lit(low) + F.lit(high - low) * amount
            value = F.when((unit <= ramp[k][0]) & (unit > ramp[k - 1][0]), piece).otherwise(value)
        out[name] = half_up(value).cast("int") if rounded else value
    return out


def facade_shade(verticality: Column) -> dict[str, Column]:
    """Blend from white towards the wall colour on steep faces."""
    amount = clamp((verticality - 0.35) / 0.45, 0.0, 1.0) * 0.85
    wall = hex_to_linear(WALL_COLOUR)
    return {n: F.lit(1.0) + (F.lit(w) - 1.0) * amount for n, w in zip(("red", "green", "blue"), wall)}
