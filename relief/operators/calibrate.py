"""Affine calibration of relative depth and its application to a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from relief.functions.core import EPS64, clamp, dbl, finite_or_null, is_finite
from relief.operators.grid import SCENE, attach


def pearson(n: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """A1: guarded correlation from centred sums; NULL when undefined."""
    size = F.sqrt(sxx * syy)
    return F.when(
        (n >= 2) & is_finite(size) & (size > EPS64),
        clamp(F.try_divide(sxy, size), -1.0, 1.0),
    )


def centred_sums(x: Column, y: Column) -> list[Column]:
    """Single-pass mergeable sums; Spark's population moments are centred."""
    pair = is_finite(x) & is_finite(y)
    x, y = F.when(pair, dbl(x)), F.when(pair, dbl(y))
    return [
        F.count(x).alias("n"),
        F.avg(x).alias("_mx"),
        F.avg(y).alias("_my"),
        F.var_pop(x).alias("_vx"),
        F.var_pop(y).alias("_vy"),
        F.covar_pop(x, y).alias("_cxy"),
    ]


def with_pearson(moments: DataFrame, alias: str = "pearson") -> DataFrame:
    n = F.col("n")
    return moments.withColumn(
        alias, pearson(n, n * F.col("_vx"), n * F.col("_vy"), n * F.col("_cxy"))
    )


def correlation(df: DataFrame, x: Column, y: Column, keys: Sequence[str] = SCENE) -> DataFrame:
    return with_pearson(df.groupBy(*keys).agg(*centred_sums(x, y))).select(*keys, "n", "pearson")


def fit_affine(
    samples: DataFrame,
    x: str = "depth",
    y: str = "elevation",
    keys: Sequence[str] = SCENE,
    source: str = "ground_truth_dsm",
    benchmark_only: bool = False,
) -> DataFrame:
    """A2: oriented least squares, one row per key.

    The depth is negated when that correlates better with the elevation. Keys
    that cannot be fitted carry a status and no coefficients.
    """
    moments = with_pearson(samples.groupBy(*keys).agg(*centred_sums(F.col(x), F.col(y))), "raw_r")
    n, sxx = F.col("n"), F.col("n") * F.col("_vx")
    # negating x flips the sign of r exactly
    negative = F.coalesce(-F.col("raw_r") > F.col("raw_r"), F.lit(False))
    sign = F.when(negative, -1.0).otherwise(1.0)
    slope = F.try_divide(F.col("orientation_sign") * F.col("_cxy"), F.col("_vx"))
    shift = F.col("_my") - F.col("_slope") * F.col("orientation_sign") * F.col("_mx")
    fitted = (
        moments.withColumn("orientation_sign", sign)
        .withColumn("_slope", slope)
        .withColumn("_shift", shift)
        .withColumn(
            "status",
            F.when(n < 3, "too_few_samples")
            .when(~is_finite(sxx) | (sxx <= EPS64), "constant_depth")
            .when(~is_finite("_slope") | ~is_finite("_shift"), "non_finite")
            .otherwise("ok"),
        )
    )
    good = F.col("status") == "ok"
    return fitted.select(
        *keys,
        F.lit(source).alias("source"),
        F.lit("affine_least_squares").alias("method"),
        F.when(good, F.col("_slope")).alias("scale"),
        F.when(good, F.col("_shift")).alias("shift"),
        F.when(F.col("orientation_sign") < 0, "negative_depth").otherwise("depth").alias("orientation"),
        "orientation_sign",
        n.alias("reference_samples"),
        F.lit(benchmark_only).alias("benchmark_only"),
        "status",
        F.col("raw_r").alias("raw_pearson"),
        (-F.col("raw_r")).alias("negative_pearson"),
        (F.col("orientation_sign") * F.col("raw_r")).alias("relative_pearson"),
    )


def apply_affine(
    cells: DataFrame,
    calibrations: DataFrame,
    sizes: DataFrame,
    keys: Sequence[str] = SCENE,
    depth: str = "depth",
    alias: str = "height",
) -> DataFrame:
    """height = scale * (sign * depth) + shift, stored as 32-bit float.

    `sizes` is `grid.extent(cells)`; cells of unfitted scenes get NULL.
    """
    coefficients = calibrations.where("status = 'ok'").select(
        *keys,
        F.col("scale").alias("_a"),
        F.col("shift").alias("_b"),
        F.col("orientation_sign").alias("_s"),
    )
    joined = attach(cells, coefficients.join(sizes, list(keys)), keys, how="left")
    height = F.col("_a") * (dbl(depth) * F.col("_s")) + F.col("_b")
    return joined.withColumn(alias, height.cast("float")).drop("_a", "_b", "_s")


def shadow_scale(
    depth_percentiles: DataFrame, shadow_heights: DataFrame, keys: Sequence[str] = SCENE
) -> DataFrame:
    """Scale from p5/p99 of depth and the p99 shadow height, or a reason.

    `depth_percentiles` has p05, p99 and n; `shadow_heights` has usable, reason,
    samples and height_p99.
    """
    joined = shadow_heights.join(
        depth_percentiles.select(*keys, "p05", "p99", F.col("n").alias("_n")), list(keys), "left"
    )
    reason = (
        F.when(~F.col("usable"), F.col("reason"))
        .when(F.coalesce(F.col("_n"), F.lit(0)) < 64, "Too few valid depth pixels to fit a scale")
        .when(F.col("p99") - F.col("p05") <= 1e-9, "Predicted depth has no usable range")
        .when(
            F.col("height_p99") <= 0.5,
            "Shadow-derived heights are too small to calibrate against",
        )
    )
    raw = F.try_divide(F.col("height_p99"), F.col("p99") - F.col("p05"))
    good = F.col("reason").isNull()
    return (
        joined.withColumn("reason", reason)
        .withColumn("_scale", raw)
        .select(
            *keys,
            F.lit("scene_shadows").alias("source"),
            F.lit("shadow_solar_geometry").alias("method"),
            F.when(good, F.rint(F.col("_scale") * 1e6) / 1e6).alias("scale"),
            F.when(good, F.rint(-F.col("_scale") * F.col("p05") * 1e4) / 1e4).alias("shift"),
            F.lit("depth").alias("orientation"),
            F.lit(1.0).alias("orientation_sign"),
            F.col("samples").cast("long").alias("reference_samples"),
            F.lit(False).alias("benchmark_only"),
            F.when(good, "ok").otherwise("refused").alias("status"),
            "reason",
        )
    )


def residual_columns(height: Column, truth: Column, ok: Column) -> tuple[Column, Column]:
    """Signed residual in double and absolute error, NaN outside the mask."""
    residual = F.when(ok, dbl(height) - dbl(truth))
    error = F.when(ok, F.abs(residual).cast("float")).otherwise(F.lit(float("nan")).cast("float"))
    return residual, error


__all__ = [
    "apply_affine",
    "centred_sums",
    "correlation",
    "finite_or_null",
    "fit_affine",
    "pearson",
    "residual_columns",
    "shadow_scale",
    "with_pearson",
]
