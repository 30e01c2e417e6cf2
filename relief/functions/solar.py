"""Position of the sun, NOAA's low-precision equations as column math."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from relief.functions.core import clamp

# Polynomial coefficients in Julian centuries since J2000.0,
# lowest order first, in degrees unless noted.
MEAN_LONGITUDE = (280.46646, 36000.76983, 0.0003032)
MEAN_ANOMALY = (357.52911, 35999.05029, -0.0001537)
ECCENTRICITY = (0.016708634, -0.000042037, -0.0000001267)  # no unit
CENTRE_1 = (1.914602, -0.004817, -0.000014)
CENTRE_2 = (0.019993, -0.000101)
CENTRE_3 = (0.000289,)
NODE = (125.04, -1934.136)
OBLIQUITY_SECONDS = (21.448, -46.815, -0.00059, 0.001813)
ABERRATION = (-0.00569, -0.00478)
NUTATION = 0.00256
EPOCH_DAYS = 2440587.5 - 2451545.0  # Unix epoch in days from J2000.0
MIN_ELEVATION, MAX_ELEVATION = 10.0, 80.0


def _poly(t: Column, terms: tuple[float, ...]) -> Column:
    return reduce(lambda acc, c: acc * t + c, reversed(terms[:-1]), F.lit(terms[-1]))


def as_utc(local: Column) -> Column:
    """Instant of a timestamp without zone, read as UTC whatever the session zone."""
    return F.from_utc_timestamp(local.cast("timestamp"), F.current_timezone())


def solar_position(when: Column, lat: Column, lon: Column) -> Column:
    """STRUCT<elevation, azimuth, usable> for an instant and a place in degrees."""
    seconds = F.unix_seconds(when).cast("double")
    t = (seconds / 86400.0 + EPOCH_DAYS) / 36525.0
    longitude = F.radians(F.pmod(_poly(t, MEAN_LONGITUDE), F.lit(360.0)))
    anomaly = F.radians(_poly(t, MEAN_ANOMALY))
    centre = (
        F.sin(anomaly) * _poly(t, CENTRE_1)
        + F.sin(2.0 * anomaly) * _poly(t, CENTRE_2)
        + F.sin(3.0 * anomaly) * _poly(t, CENTRE_3)
    )
    node = F.radians(_poly(t, NODE))
    apparent = longitude + F.radians(centre + ABERRATION[0] + ABERRATION[1] * F.sin(node))
    obliquity = F.radians(
        23.0 + (26.0 + _poly(t, OBLIQUITY_SECONDS) / 60.0) / 60.0 + NUTATION * F.cos(node)
    )
    declination = F.asin(F.sin(obliquity) * F.sin(apparent))

    y = F.pow(F.tan(obliquity / 2.0), F.lit(2.0))
    e = _poly(t, ECCENTRICITY)
    equation = 4.0 * F.degrees(
        y * F.sin(2.0 * longitude)
        - 2.0 * e * F.sin(anomaly)
        + 4.0 * e * y * F.sin(anomaly) * F.cos(2.0 * longitude)
        - 0.5 * y * y * F.sin(4.0 * longitude)
        - 1.25 * e * e * F.sin(2.0 * anomaly)
    )
    minutes = F.pmod(seconds, F.lit(86400.0)) / 60.0
    hour = F.pmod(minutes + equation + 4.0 * lon, F.lit(1440.0)) / 4.0 - 180.0

    phi = F.radians(lat)
    cos_zenith = clamp(
        F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(F.radians(hour)), -1.0, 1.0
    )
    zenith = F.acos(cos_zenith)
    elevation = 90.0 - F.degrees(zenith)
    level = F.cos(phi) * F.sin(zenith)
    bearing = F.degrees(
        F.acos(clamp(F.try_divide(F.sin(phi) * F.cos(zenith) - F.sin(declination), level), -1.0, 1.0))
    )
    # the arc cosine is measured from south; turn it into a bearing from north
    azimuth = F.when(F.abs(level) < 1e-9, F.lit(180.0)).otherwise(
        F.when(hour > 0, F.pmod(bearing + 180.0, F.lit(360.0))).otherwise(F.pmod(540.0 - bearing, F.lit(360.0)))
    )
    usable = (elevation >= MIN_ELEVATION) & (elevation <= MAX_ELEVATION)
    return F.struct(elevation.alias("elevation"), azimuth.alias("azimuth"), usable.alias("usable"))


def elevation_problem(elevation: Column) -> Column:
    return F.when(
        ~elevation.between(MIN_ELEVATION, MAX_ELEVATION),
        F.format_string(
            "Solar elevation %.1f degrees is outside the 10-80 degree band where shadow length "
            "is a reliable height cue",
            elevation,
        ),
    )
