"""Tables written for each run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from relief.functions.core import is_finite, valid_cell
from relief.functions.pixel import preview_unit
from relief.functions.ramps import preview_colour
from relief.operators.grid import attach
from relief.operators.sketches import percentiles
from relief.session import materialise
from relief.stores import replace_rows

NODATA = -9999.0
# Tag written with a calibrated grid, by calibration source.
CALIBRATION_TAGS = {
    "ground_truth_dsm": "benchmark_only_affine",
    "reference_dem": "reference_dem_affine",
    "gcps": "gcp_affine",
}


def depth_export(cells: DataFrame, valid: str | None = "valid") -> DataFrame:
    """K1: raw depth, NaN where the source mask is false."""
    ok = F.lit(True) if valid is None else F.coalesce(F.col(valid), F.lit(False))
    value = F.when(ok, F.col("depth")).otherwise(F.lit(float("nan"))).cast("float")
    return cells.select("scene_id", "row", "col", value.alias("depth"))


def preview_table(cells: DataFrame, value: str, valid: str | None = "valid", sketch: int | None = None) -> DataFrame:
    """K4: colours of a grid between its p0.5 and p99.5; invalid cells are dark.

    The bounds are exact, or taken from quantile sketches of a given size.
    """
    ok = is_finite(value) if valid is None else valid_cell(value, valid)
    stats = percentiles(cells, value, {"_p_low": 0.005, "_p_high": 0.995}, where=ok, sketch=sketch).drop("n")
    bounds = [F.col(c) for c in ("_p_low", "_p_high", "low", "high")]
    unit = attach(cells, stats, how="left").withColumn("_ok", ok).withColumn("_unit", preview_unit(value, F.col("_ok"), *bounds))
    colours = preview_colour(F.col("_unit").cast("float"), F.col("_ok"))
    return unit.select("scene_id", "row", "col", *[c.alias(n) for n, c in colours.items()])


def write_run(tables: dict[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """Store every table of an analysis under its name, and the runs as JSON too.

    With `overwrite` the rows of the scenes of this analysis, accepted or not,
    take the place of their earlier ones in every table; other scenes stay.
    """
    judged = [tables[name].select("scene_id") for name in ("runs", "rejects") if name in tables]
    scenes = materialise(reduce(DataFrame.unionByName, judged).distinct()) if judged else None
    for name, table in tables.items():
        write_scene_table(table, f"{path}/{name}", overwrite, scenes)
    if judged:
        # one document for each scene: its run, or why there is none
        documents = [strict_json(tables[name]) for name in ("rejects", "runs") if name in tables]
        writer = reduce(DataFrame.unionByName, documents).write.mode("overwrite" if overwrite else "errorifexists")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("scene_id").text(f"{path}/runs_json")


def calibrated_export(
    cells: DataFrame, scenes: DataFrame, calibrations: DataFrame, height: str = "height", valid: str = "valid"
) -> tuple[DataFrame, DataFrame]:
    """K3: (cells, headers) of calibrated grids of scenes with CRS and transform.

    Invalid cells hold -9999 with mask 0; headers keep the source tags and add
    what the heights are and where their calibration came from.
    """
    source = F.col("source")
    tag = F.lit("affine")
    for name, text in CALIBRATION_TAGS.items():
        tag = F.when(source == name, text).otherwise(tag)
    added = F.create_map(
        F.lit("RELIEF_OUTPUT"), F.lit("calibrated_predicted_dsm"),
        F.lit("RELIEF_CALIBRATION"), tag,
        F.lit("RELIEF_CALIBRATION_SOURCE"), source,
    )
    kept = F.map_filter(
        F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda k, _: ~k.startswith("RELIEF_")
    )
    headers = (
        scenes.where("crs IS NOT NULL AND transform IS NOT NULL")
        .join(calibrations.where("status = 'ok'").select("scene_id", "source"), "scene_id")
        .select(
            "scene_id", "width", "height", "crs", "transform", F.lit(NODATA).alias("nodata"), F.map_concat(kept, added).alias("tags")
        )
    )
    ok = valid_cell(height, valid)
    grid = cells.join(headers.select("scene_id"), "scene_id", "left_semi").select(
        "scene_id",
        "row",
        "col",
        F.when(ok, F.col(height)).otherwise(F.lit(NODATA)).cast("float").alias("value"),
        F.when(ok, 255).otherwise(0).cast("short").alias("mask"),
    )
    return grid, headers


def strict_json(df: DataFrame) -> DataFrame:
    """K2: one JSON document per row without NaN or infinite numbers."""
    return df.select("scene_id", F.to_json(F.struct(*[_clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])).alias("json"))


def _clean(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(is_finite(c), c)
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_clean(c[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda e: _clean(e, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _clean(v, kind.valueType))
    return c


def write_scene_table(df: DataFrame, path: str, overwrite: bool = False, scenes: DataFrame | None = None) -> None:
    """Parquet by scene, refusing to replace a table unless told to.

    When told to, the scenes of `df` and of `scenes` are replaced and the others
    stay. Rows are spread by row band, so a large scene is many files.
    """
    band = [F.expr("row div 4096")] if "row" in df.columns else []
    replace_rows(df, path, "scene_id", scenes, band, overwrite)


def height16_tables(grid: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K5: codes of every scene, and masks of the scenes that have an invalid cell."""
    masked = headers.where("masked").select("scene_id")
    masks = grid.join(masked, "scene_id", "left_semi").select("scene_id", "row", "col", "valid")
    return grid.select("scene_id", "row", "col", "q"), masks


def run_summary(runs: DataFrame) -> DataFrame:
    """The fields the command-line tools print."""
    wanted = ["job_id", "scene_id", "mode", "model", "device", "output_basis", "calibration", "metrics", "reference", "notices"]
    return runs.select(*[c for c in wanted if c in runs.columns])


def provenance(scenes: DataFrame, licence: str, attribution: str) -> DataFrame:
    """Where each scene came from, with its header."""
    return scenes.select(
        "scene_id",
        F.lit(licence).alias("license"),
        F.lit(attribution).alias("attribution"),
        "crs",
        "bounds",
        F.struct("width", "height", "transform").alias("raster"),
    )
