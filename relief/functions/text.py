"""Text columns: settings, timestamps, file roles and run labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from relief.functions.core import as_col
from relief.functions.solar import as_utc

# Acquisition tags, most specific first.
TIME_TAGS = (
    "TIFFTAG_DATETIME",
    "ACQUISITIONDATETIME",
    "ACQUISITION_DATE",
    "DATETIME",
    "DATE_ACQUIRED",
    "NITF_IDATIM",
)
# Accepted layouts in order, and whether they carry a clock.
TIME_LAYOUTS = (
    ("yyyy:M:d H:m:s", True),
    ("yyyy-M-d'T'H:m:s", True),
    ("yyyy-M-d H:m:s", True),
    ("yyyy-M-d'T'H:m:s'Z'", True),
    ("yyyyMMddHHmmss", True),
    ("yyyy-M-d", False),
    ("yyyy:M:d", False),
)
SAMPLING = ("nearest", "bilinear")
QUALITY = ("fast", "quality")
TIFF_SUFFIX = r"\.(?:tif|tiff|geotiff)$"
IMAGE_SUFFIX = r"\.(?:jpe?g|png|tiff?)$"
CALIBRATION_SUFFIX = r"\.(?:tiff?|npy|csv|json)$"
DATA_SUFFIXES = (
    "csv", "dem", "hgt", "jp2", "json", "las", "laz", "npy", "npz", "pdf", "png", "jpg", "jpeg",
    "tif", "tiff", "xml", "zip",
)


def parse_time(text: Column) -> Column:
    """First layout that fits, as UTC; a date without a clock means midday."""
    out = []
    for layout, clock in TIME_LAYOUTS:
        moment = as_utc(F.try_to_timestamp(text, F.lit(layout)))
        out.append(moment if clock else moment + F.expr("INTERVAL 12 HOURS"))
    return F.coalesce(*out)


def acquisition_time(tags: Column | str) -> Column:
    """Time from the first acquisition tag, in priority order, that parses."""
    entries = F.map_entries(as_col(tags))

    def named(tag: str) -> Column:
        hits = F.filter(entries, lambda e: F.upper(e["key"]) == tag)
        times = F.transform(hits, lambda e: parse_time(F.trim(e["value"])))
        return F.try_element_at(F.array_compact(times), F.lit(1))

    return F.coalesce(*[named(t) for t in TIME_TAGS])


def iso_time(text: Column | str) -> Column:
    """ISO 8601 with or without a zone; without one it is UTC."""
    t = as_col(text)
    zoned = t.rlike(r"[T ].*(?:Z|[+-]\d\d:?\d\d)$")
    dated = t.rlike(r"^\d{4}-\d\d-\d\d$")
    full = F.when(zoned, t).when(dated, F.concat(t, F.lit("T00:00:00Z"))).otherwise(F.concat(t, F.lit("Z")))
    return full.try_cast("timestamp")


def setting(text: Column | str) -> Column:
    return F.lower(F.trim(as_col(text)))


def settings_problem(sampling: Column | str, quality: Column | str) -> Column:
    """Why a request's settings are refused, or NULL."""
    return F.when(
        ~setting(sampling).isin(*SAMPLING), F.lit("GCP sampling must be 'nearest' or 'bilinear'")
    ).when(
        ~setting(quality).isin(*QUALITY),
        F.concat(F.lit("quality_mode must be one of fast, quality, got '"), as_col(quality), F.lit("'")),
    )


def file_role(path: Column | str) -> Column:
    """Whether a calibration file holds control points or a reference grid."""
    return F.when(F.lower(as_col(path)).rlike(r"\.(?:csv|json)$"), "gcps").otherwise("reference_dem")


def accepted_image(path: Column | str) -> Column:
    return F.lower(as_col(path)).rlike(IMAGE_SUFFIX)


def accepted_calibration(path: Column | str) -> Column:
    return F.lower(as_col(path)).rlike(CALIBRATION_SUFFIX)


def looks_like_tiff(path: Column | str, content: Column | None = None) -> Column:
    """By suffix, or by the byte-order mark of the container."""
    by_name = F.lower(as_col(path)).rlike(TIFF_SUFFIX)
    if content is None:
        return by_name
    magic = F.hex(F.substring(content, 1, 4))
    return by_name | F.coalesce(magic.isin("49492A00", "4D4D002A"), F.lit(False))


def likely_data(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(as_col(path), r"\.([^./]+)$", 1)).isin(*DATA_SUFFIXES)


def output_basis(mode: Column | str, calibrated: Column, has_truth: Column) -> Column:
    """What a run's heights rest on. Shadow scale never saw the truth."""
    m = as_col(mode)
    return (
        F.when(m == "reference_dem_calibrated_dsm", "deployment-dem")
        .when(m == "gcp_calibrated_dsm", "deployment-gcp")
        .when(m == "shadow_calibrated_dsm", "deployment-shadow")
        .when(F.lower(m).contains("benchmark") | (calibrated & has_truth), "benchmark-fit")
        .otherwise("relative")
    )


def held_out(holdout_points: Column, scope: Column, metric_names: Column) -> Column:
    """Whether a run has an evaluation its calibration did not use."""
    text = F.lower(F.coalesce(scope, F.lit("")))
    named = F.exists(
        F.coalesce(metric_names, F.array().cast("array<string>")), lambda n: F.lower(n).contains("holdout")
    )
    return (
        (F.coalesce(holdout_points, F.lit(0)) > 0) | named | text.contains("holdout") | text.contains("validation")
    )
