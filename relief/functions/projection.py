"""Affine transforms, Web Mercator and raster headers.

A transform is ARRAY<DOUBLE> [a, b, c, d, e, f]: x = a*col + b*row + c and
y = d*col + e*row + f.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from relief.functions.core import as_col, clamp

# Sphere radius of EPSG:3857, angular pixel threshold.
EARTH_RADIUS = 6378137.0
ORIGIN_SHIFT = math.pi * EARTH_RADIUS
ANGULAR_PIXEL = 1e-4


def forward(transform: Column, col: Column, row: Column) -> tuple[Column, Column]:
    t = [transform[i] for i in range(6)]
    return t[0] * col + t[1] * row + t[2], t[3] * col + t[4] * row + t[5]


def inverse(transform: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Map coordinate to (col, row); NULL for a singular transform."""
    a, b, c, d, e, f = (transform[i] for i in range(6))
    det = a * e - b * d
    dx, dy = x - c, y - f
    return F.try_divide(e * dx - b * dy, det), F.try_divide(a * dy - d * dx, det)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to EPSG:3857 metres."""
    x = lon * ORIGIN_SHIFT / 180.0
    y = F.ln(F.tan((lat + 90.0) * math.pi / 360.0)) / (math.pi / 180.0)
    return x, y * ORIGIN_SHIFT / 180.0


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    lon = x / ORIGIN_SHIFT * 180.0
    lat = F.degrees(2.0 * F.atan(F.exp(y / EARTH_RADIUS)) - math.pi / 2.0)
    return lon, lat


def is_code(crs: Column, code: str) -> Column:
    return F.upper(F.trim(crs)) == f"EPSG:{code}"


def geographic(crs: Column) -> Column:
    """Coordinate kind by CRS text."""
    text = F.lower(crs)
    return text.contains("4326") | text.contains("wgs 84")


def reproject_point(x: Column, y: Column, source: Column, target: Column) -> tuple[Column, Column]:
    """Equal CRS, or EPSG:4326 to and from EPSG:3857; other pairs give NULL."""
    mx, my = to_mercator(x, y)
    lon, lat = from_mercator(x, y)
    same = F.upper(F.trim(source)) == F.upper(F.trim(target))
    up = is_code(source, "4326") & is_code(target, "3857")
    down = is_code(source, "3857") & is_code(target, "4326")
    return (
        F.when(same, x).when(up, mx).when(down, lon),
        F.when(same, y).when(up, my).when(down, lat),
    )


def scene_centre(crs: Column, transform: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Longitude and latitude of the scene centre, NULL when unresolvable."""
    x, y = forward(transform, width / 2.0, height / 2.0)
    return reproject_point(x, y, crs, F.lit("EPSG:4326"))


def pixel_size(transform: Column) -> Column:
    """Mean of the two pixel sides in CRS units, NULL unless both are positive."""
    a, b, d, e = transform[0], transform[1], transform[3], transform[4]
    side_x, side_y = F.sqrt(a * a + d * d), F.sqrt(b * b + e * e)
    return F.when((side_x > 0) & (side_y > 0), (side_x + side_y) / 2.0)


def pixel_size_problem(size: Column, crs: Column) -> Column:
    """Why a scene has no metric pixel size, or NULL."""
    angular = (size < ANGULAR_PIXEL) | F.coalesce(geographic(crs), F.lit(False))
    return F.when(
        size.isNull(), F.lit("Image has no usable pixel size; a projected CRS is required")
    ).when(
        angular,
        F.lit(
            "Pixel size looks angular, not metric. Reproject to a metric CRS such as UTM "
            "before shadow calibration"
        ),
    )


def transforms_match(first: Column, second: Column, tolerance: float = 1e-8) -> Column:
    """All six terms within absolute plus relative tolerance."""
    close = F.zip_with(first, second, lambda a, b: F.abs(a - b) <= tolerance + tolerance * F.abs(b))
    return F.coalesce(F.forall(close, lambda ok: ok), F.lit(False))


def pixel_to_map(
    x: Column, y: Column, transform: Column, bounds: Column, width: Column, height: Column
) -> tuple[Column, Column]:
    """By the transform when complete, else by position inside the bounds."""
    usable = transform.isNotNull() & (F.size(transform) >= 6)
    tx, ty = forward(transform, x, y)
    bx = bounds["left"] + x / F.greatest(F.lit(1), width - 1) * (bounds["right"] - bounds["left"])
    by = bounds["top"] + y / F.greatest(F.lit(1), height - 1) * (bounds["bottom"] - bounds["top"])
    return F.when(usable, tx).otherwise(bx), F.when(usable, ty).otherwise(by)


def map_to_unit(
    x: Column, y: Column, transform: Column, width: Column, height: Column
) -> tuple[Column, Column]:
    """Map point to the scene's [0, 1] square through whole pixels, clipped."""
    col, row = inverse(transform, x, y)
    u = clamp(F.floor(col) / F.greatest(F.lit(1), width - 1), 0.0, 1.0)
    v = clamp(F.floor(row) / F.greatest(F.lit(1), height - 1), 0.0, 1.0)
    return u, v


def transform_from_bounds(
    left: Column, bottom: Column, right: Column, top: Column, width: Column, height: Column
) -> Column:
    return F.array(
        (right - left) / width, F.lit(0.0), left, F.lit(0.0), -(top - bottom) / height, top
    )


def square_bounds(lat: Column | str, lon: Column | str, span: Column) -> Column:
    """Web Mercator square around a centre."""
    x, y = to_mercator(as_col(lon), as_col(lat))
    half = span / 2.0
    return F.struct(
        (x - half).alias("left"), (y - half).alias("bottom"), (x + half).alias("right"), (y + half).alias("top")
    )
