"""S3: ground control points from CSV or JSON, or from tables of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from relief.functions.core import is_finite
from relief.session import materialise

# Accepted field names in order of preference, accepted spaces.
ALIASES = {
    "x": ("x", "pixel_x", "col"),
    "y": ("y", "pixel_y", "row"),
    "elevation": ("elevation", "z", "height"),
}
PIXEL_SPACES = ("pixel", "pixels", "image_pixel", "image_pixels")
# what each coordinate is called when it is missing
MISSING = {"x": "x coordinate", "y": "y coordinate", "elevation": "elevation"}


def _name(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), "-", "_")


def points_from_records(records: DataFrame, space: str | None = None, empty: str | None = None) -> DataFrame:
    """Points from (scene_id, idx, fields MAP<STRING,STRING>) rows.

    Field names are trimmed, lower-cased, with hyphens as underscores; of equal
    names the last wins. `space` names a column with the document-level coordinate
    space, `empty` one that marks documents without points. A point that cannot be
    used keeps NULL coordinates and an `error` naming its index.
    """
    # one step after the other, so that no text is looked up and cast again
    named = records.withColumns(
        {
            "_names": F.reverse(F.transform(F.map_keys("fields"), _name)),
            "_texts": F.reverse(F.transform(F.map_values("fields"), lambda v: F.nullif(F.trim(v), F.lit("")))),
        }
    )

    def last(name: str) -> Column:
        return F.get("_texts", (F.array_position("_names", name) - 1).cast("int"))

    texts = {f"_t_{target}": F.coalesce(*map(last, aliases)) for target, aliases in ALIASES.items()}
    read = named.withColumns({**texts, "_declared": last("coordinate_space")}).drop("_names", "_texts")
    suffixed = {t: F.lower(f"_t_{t}").rlike("[0-9.][df]$") for t in ALIASES}
    read = read.withColumns({f"_n_{t}": F.when(~suffixed[t], F.col(f"_t_{t}").try_cast("double")) for t in ALIASES})
    start = F.concat(F.lit("GCP point "), F.col("idx"))
    problem = F.when(
        ~_name(F.col("_declared")).isin(*PIXEL_SPACES),
        F.concat(start, F.lit(" declares unsupported coordinate_space; only zero-based image pixels are accepted")),
    )
    if space is not None:
        outer = F.col(space)
        problem = F.when(
            outer.isNotNull() & ~_name(outer).isin(*PIXEL_SPACES),
            F.lit("GCP JSON coordinate_space must describe zero-based image pixels"),
        ).otherwise(problem)
    if empty is not None:
        problem = F.when(F.col(empty), F.lit("GCP JSON object must contain a 'points' list")).otherwise(problem)
    for target, aliases in ALIASES.items():
        text, number = F.col(f"_t_{target}"), F.col(f"_n_{target}")
        why = (
            F.when(
                text.isNull(),
                F.concat(start, F.lit(f" is missing {MISSING[target]}; accepted field names are {', '.join(aliases)}")),
            )
            .when(number.isNull(), F.concat(start, F.lit(f" has a non-numeric {target}")))
            .when(~is_finite(number), F.concat(start, F.lit(f" has a non-finite {target}")))
        )
        problem = F.coalesce(problem, why)
    out = read.withColumn("error", problem)
    usable = F.col("error").isNull()
    return out.select(
        "scene_id", "idx", *[F.when(usable, F.col(f"_n_{t}")).alias(t) for t in ALIASES], "error"
    )


def check_points(points: DataFrame) -> DataFrame:
    """Per scene counts and the reason the set is refused, if any."""
    counts = points.groupBy("scene_id").agg(
        F.count("x").alias("points"),
        F.countDistinct(F.struct("x", "y")).alias("distinct_points"),
    )
    reason = (
        F.when(F.col("points") < 3, "At least three GCP points are required for calibration")
        .when(F.col("distinct_points") < 3, "At least three distinct GCP pixel locations are required")
        .when(
            F.col("distinct_points") != F.col("points"), "Duplicate GCP pixel locations are not allowed"
        )
    )
    return counts.withColumn("reason", reason)


# a comma outside double quotes
_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def read_gcp_csv(spark: SparkSession, path: str) -> DataFrame:
    """Points of every CSV file under `path`; the scene is the file's stem.

    Files may have different headers. Blank rows are dropped before numbering.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    lines = lines.withColumn("value", F.regexp_replace("value", "^﻿", ""))
    cells = F.transform(
        F.split("value", _COMMA), lambda c: F.regexp_replace(F.trim(c), '^"|"$', "")
    )
    filled = lines.withColumn("_cells", cells).where(F.exists("_cells", lambda c: c != ""))
    # numbered inside input splits and shifted by the splits before: a file is
    # never sorted as a whole
    counts = filled.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_file", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_file", "_start").orderBy("_id"))
    numbered = filled.withColumn("_rn", inside).join(offsets, ["_file", "_start"]).withColumn(
        "idx", (F.col("_offset") + F.col("_rn") - 1).cast("int")
    )
    headers = materialise(numbered.where("idx = 0").select("_file", F.col("_cells").alias("_header")))
    body = numbered.where("idx > 0").join(headers, "_file")
    fields = F.map_from_entries(F.arrays_zip(F.col("_header").alias("key"), F.col("_cells").alias("value")))
    records = body.select(
        scene_of_path("_file").alias("scene_id"),
        "idx",
        F.map_filter(fields, lambda k, v: v.isNotNull() & k.isNotNull()).alias("fields"),
    )
    return points_from_records(records)


def points_from_json(documents: DataFrame, text: str = "json") -> DataFrame:
    """Points from (scene_id, text): a list of points, or an object with `points`."""
    stripped = F.regexp_replace(text, "^[﻿\\s]+", "")
    listed = F.from_json("_text", "array<map<string,string>>")
    whole = F.from_json("_text", "struct<coordinate_space:string,points:array<map<string,string>>>")
    is_list = F.startswith("_text", F.lit("["))
    # each text is parsed once, as a list or as an object
    opened = documents.select("scene_id", stripped.alias("_text")).select(
        "scene_id", F.when(is_list, listed).alias("_list"), F.when(~is_list, whole).alias("_whole")
    )
    records = opened.select(
        "scene_id",
        F.col("_whole.coordinate_space").alias("_space"),
        F.posexplode_outer(F.coalesce("_list", "_whole.points")).alias("_pos", "fields"),
    ).select("scene_id", "_space", (F.col("_pos") + 1).alias("idx"), "fields", F.col("_pos").isNull().alias("_empty"))
    return points_from_records(records, "_space", "_empty")


def read_gcp_json(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(
        scene_of_path("_metadata.file_path").alias("scene_id"), F.col("value").alias("json")
    )
    return points_from_json(files)


def scene_of_path(path: str) -> Column:
    return F.regexp_extract(F.col(path), r"([^/]+?)(?:\.[^./]*)?$", 1)
