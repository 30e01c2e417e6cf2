"""Scoring of heights against ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from relief.functions.core import dbl, is_finite, valid_cell
from relief.operators.calibrate import apply_affine, centred_sums, fit_affine, with_pearson
from relief.operators.grid import SCENE, extent
from relief.operators.stats import exact_percentiles


def score(
    cells: DataFrame,
    height: str = "height",
    truth: str = "value",
    valid: Column | str = "valid",
    keys: Sequence[str] = SCENE,
    refit: bool = False,
) -> DataFrame:
    """A3: errors of fixed heights; keys without a valid cell get no metrics."""
    ok = valid_cell(height, valid) & is_finite(truth)
    h, t = F.when(ok, dbl(height)), F.when(ok, dbl(truth))
    residual = h - t
    moments = with_pearson(
        cells.groupBy(*keys).agg(
            *centred_sums(h, t),
            F.count(F.lit(1)).alias("total_pixels"),
            F.avg(F.abs(residual)).alias("mae"),
            F.sqrt(F.avg(residual * residual)).alias("rmse"),
        )
    )
    scope = "same_scene_benchmark_refit" if refit else "holdout_fixed_calibration"
    return moments.select(
        *keys,
        F.lit(scope).alias("evaluation_scope"),
        F.lit(refit).alias("calibration_refit"),
        F.col("n").alias("valid_pixels"),
        "total_pixels",
        (F.col("n") / F.col("total_pixels")).alias("valid_fraction"),
        "pearson",
        "mae",
        "rmse",
    )


def benchmark_refit(
    cells: DataFrame,
    depth: str = "depth",
    truth: str = "value",
    valid: Column | str = "valid",
    keys: Sequence[str] = SCENE,
) -> tuple[DataFrame, DataFrame]:
    """A4: fit on the truth itself, then score. Returns (calibrations, metrics)."""
    ok = valid_cell(depth, valid) & is_finite(truth)
    samples = cells.select(*keys, F.when(ok, F.col(depth)).alias(depth), F.col(truth).alias("elevation"))
    fits = fit_affine(samples, depth, "elevation", keys, "ground_truth_dsm", True)
    heights = apply_affine(cells, fits, extent(cells, keys), keys, depth)
    metrics = score(heights, "height", truth, valid, keys, refit=True).join(
        fits.select(*keys, "raw_pearson", "negative_pearson", "relative_pearson"), list(keys)
    )
    return fits, metrics


def datum_offset(
    cells: DataFrame,
    height: str = "height",
    truth: str = "value",
    valid: Column | str = "valid",
    keys: Sequence[str] = SCENE,
    minimum: int = 64,
) -> DataFrame:
    """A5: median of truth - height where at least `minimum` cells compare."""
    ok = valid_cell(height, valid)
    # both grids are 32-bit, and so is their difference
    difference = (F.col(truth).cast("float") - F.col(height).cast("float")).cast("float")
    offsets = exact_percentiles(cells, difference, {"datum_offset": 0.5}, keys, ok)
    return offsets.where(F.col("n") >= minimum).select(*keys, "datum_offset", "n")
