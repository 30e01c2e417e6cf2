"""Decoded band rows, elevation grids and their headers."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relief.functions.core import is_finite, valid_cell
from relief.operators.grid import attach
from relief.operators.stats import exact_percentiles
from relief.functions.pixel import stretch_band
from relief.sources.gcps import scene_of_path

_BATCH = 1 << 16


def rgb_from_bands(bands: DataFrame, eight_bit: bool) -> DataFrame:
    """Decoded bands to display colours.

    `bands` has scene_id, row, col, valid and either b1, b2, b3 or b1 alone,
    which is repeated. Bands that are not 8-bit are stretched per scene (P1);
    invalid cells are black.
    """
    names = [c for c in ("b1", "b2", "b3") if c in bands.columns]
    if len(names) < 3:
        names = names[:1]
    ok = F.coalesce(F.col("valid"), F.lit(False))
    out = bands
    levels: dict[str, Column] = {}
    for name in names:
        good = ok & is_finite(name)
        if eight_bit:
            levels[name] = F.when(good, F.col(name)).otherwise(F.lit(0)).cast("smallint")
            continue
        stats = exact_percentiles(bands, name, {f"_{name}_p2": 0.02, f"_{name}_p98": 0.98}, where=ok).select(
            "scene_id",
            f"_{name}_p2",
            f"_{name}_p98",
            F.col("low").alias(f"_{name}_low"),
            F.col("high").alias(f"_{name}_high"),
            "n_rows",
            "n_cols",
        )
        out = attach(out, stats, how="left")
        levels[name] = stretch_band(
            name, good, *[F.col(f"_{name}_{k}") for k in ("p2", "p98", "low", "high")]
        ).cast("smallint")
    picked = names if len(names) == 3 else names * 3
    return out.select(
        "scene_id", "row", "col", *[levels[n].alias(c) for n, c in zip(picked, ("r", "g", "b"))], ok.alias("valid")
    )


def elevation_cells(
    cells: DataFrame, value: str = "value", mask: str | None = None, nodata: Column | None = None, role: str = "elevation"
) -> DataFrame:
    """A decoded elevation band as 32-bit values with their validity."""
    masks = [] if mask is None else [mask]
    return cells.select(
        "scene_id",
        F.lit(role).alias("role"),
        "row",
        "col",
        F.col(value).cast("float").alias("value"),
        valid_cell(value, *masks, nodata=nodata).alias("valid"),
    )


def _decode_npy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One array file after another, sent on in row blocks of bounded size."""
    for batch in batches:
        for scene, content in zip(batch["scene_id"], batch["content"]):
            problem, grid = None, np.empty((0, 0), dtype=np.float32)
            try:
                grid = np.squeeze(np.load(io.BytesIO(content), allow_pickle=False))
            except Exception as error:  # the file's own damage is data, not a failure
                problem = f"Could not decode NumPy elevation raster: {error}"
            if problem is None and grid.ndim != 2:
                problem = "A NumPy elevation raster must be a two-dimensional array"
            if problem is None and not grid.size:
                problem = "A NumPy elevation raster must hold at least one pixel"
            if problem is not None:
                yield pd.DataFrame({"scene_id": [scene], "row": [-1], "col": [-1], "value": [np.float32(np.nan)], "problem": [problem]})
                continue
            height, width = grid.shape
            step = max(1, _BATCH // width)
            for top in range(0, height, step):
                part = grid[top : top + step].astype(np.float32)
                rows, cols = np.indices(part.shape)
                yield pd.DataFrame(
                    {
                        "scene_id": scene,
                        "row": (rows.ravel() + top).astype(np.int32),
                        "col": cols.ravel().astype(np.int32),
                        "value": part.ravel(),
                        "problem": None,
                    }
                )


def read_npy(spark: SparkSession, path: str, role: str = "elevation") -> tuple[DataFrame, DataFrame]:
    """Every array file under a folder; the scene is the file's stem.

    Returns (cells, problems). Files are spread over tasks, one array at a time.
    """
    files = spark.read.format("binaryFile").load(path).select(scene_of_path("path").alias("scene_id"), "content")
    decoded = files.mapInPandas(_decode_npy, "scene_id string, row int, col int, value float, problem string")
    cells = elevation_cells(decoded.where("problem IS NULL"), role=role)
    return cells, decoded.where("problem IS NOT NULL").select("scene_id", "problem")


def header_summary(cells: DataFrame, bands: int, crs: Column, transform: Column) -> DataFrame:
    """Size, band count, CRS, transform and bounds of each scene's grid."""
    sized = cells.groupBy("scene_id").agg(
        (F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height")
    )
    placed = sized.withColumn("bands", F.lit(bands)).withColumn("crs", crs).withColumn("transform", transform)
    t = F.col("transform")
    return placed.withColumn(
        "bounds",
        F.struct(
            t[2].alias("left"),
            (t[5] + t[4] * F.col("height")).alias("bottom"),
            (t[2] + t[0] * F.col("width")).alias("right"),
            t[5].alias("top"),
        ),
    )


def inconsistent_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Scenes whose two headers differ in size or bounds, and how."""
    a, b = first.alias("a"), second.alias("b")
    reason = F.when(
        (F.col("a.width") != F.col("b.width")) | (F.col("a.height") != F.col("b.height")),
        "dimensions do not match",
    ).when(F.col("a.bounds") != F.col("b.bounds"), "bounds do not match")
    return (
        a.join(b, F.col("a.scene_id") == F.col("b.scene_id"))
        .select(F.col("a.scene_id").alias("scene_id"), reason.alias("reason"))
        .where("reason IS NOT NULL")
    )
