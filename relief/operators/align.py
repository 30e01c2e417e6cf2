"""Bringing elevation rasters onto a scene's grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relief.functions.core import dbl, is_finite
from relief.functions.projection import forward, inverse, reproject_point, transforms_match
from relief.operators.grid import attach, extent
from relief.operators.sample import CELL, patch_weights, with_patch
from relief.operators.stats import exact_percentiles
from relief.session import materialise


def alignment_mode(
    src: Column, dst: Column, label: str = "Elevation raster"
) -> tuple[Column, Column]:
    """Which alignment a pair of headers needs, and the notice that goes with it.

    Headers are structs with width, height, crs and transform.
    """
    same_shape = (src["width"] == dst["width"]) & (src["height"] == dst["height"])
    located = (
        src["crs"].isNotNull()
        & dst["crs"].isNotNull()
        & src["transform"].isNotNull()
        & dst["transform"].isNotNull()
    )
    same_place = located & (src["crs"] == dst["crs"]) & transforms_match(src["transform"], dst["transform"])
    mode = (
        F.when(same_shape & F.coalesce(same_place, F.lit(False)), "same_grid")
        .when(located, "georeferenced")
        .when(same_shape, "assumed")
        .otherwise("resized")
    )
    partly = src["crs"].isNotNull() | dst["crs"].isNotNull()
    notice = (
        F.when(
            mode == "georeferenced",
            F.lit(
                f"{label} was geospatially reprojected/resampled to the source image grid because "
                "its CRS, transform, or dimensions differed."
            ),
        )
        .when(
            (mode == "assumed") & partly,
            F.lit(
                f"{label} and source have matching dimensions but incomplete georeferencing; "
                "pixel-for-pixel alignment was assumed."
            ),
        )
        .when(
            mode == "resized",
            F.format_string(
                f"{label} was resized from %dx%d to %dx%d because usable geospatial alignment "
                "metadata was unavailable. Bilinear values and a nearest-neighbor validity mask were used.",
                src["width"],
                src["height"],
                dst["width"],
                dst["height"],
            ),
        )
    )
    return mode, notice


def align_same_grid(cells: DataFrame, elevation: DataFrame) -> DataFrame:
    """Pixel for pixel."""
    return cells.join(elevation.select(*CELL, "value", "valid"), list(CELL))


def _axis_taps(index: Column, src: Column, dst: Column) -> Column:
    """Targets along one axis that a source line contributes to, with weights.

    Triangle filter with half-pixel centres; when shrinking, its support grows
    with the scale so every source line counts.
    """
    scale = src / dst
    support = F.greatest(F.lit(1.0), scale)
    centre = index + 0.5
    first = F.greatest(F.lit(0), F.ceil((centre - support) / scale - 0.5).cast("int"))
    last = F.least(dst - 1, F.floor((centre + support) / scale - 0.5).cast("int"))
    candidates = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    taps = F.transform(
        candidates,
        lambda t: F.struct(
            t.alias("at"),
            F.greatest(F.lit(0.0), 1.0 - F.abs(centre - (t + 0.5) * scale) / support).alias("w"),
        ),
    )
    return F.filter(taps, lambda t: t["w"] > 0)


def resize_bilinear(cells: DataFrame, sizes: DataFrame, value: str, alias: str = "value") -> DataFrame:
    """Numeric resize, columns first and then rows, each pass stored as float.

    `sizes` has scene_id, n_rows, n_cols (source) and t_rows, t_cols (target).
    Source values must be finite. Returns (scene_id, row, col, alias).
    """
    sized = attach(cells.select(*CELL, dbl(value).alias("_v")), sizes, keep_extent=True)

    def one_axis(df: DataFrame, axis: str, src: str, dst: str, other: list[str]) -> DataFrame:
        spread = df.withColumn("_tap", F.explode(_axis_taps(F.col(axis), F.col(src), F.col(dst))))
        weight = F.col("_tap.w")
        return spread.groupBy("scene_id", *other, F.col("_tap.at").alias(axis)).agg(
            F.sum(weight * F.col("_v")).alias("_s"),
            F.sum(weight).alias("_ws"),
            *[F.max(c).alias(c) for c in ("n_rows", "n_cols", "t_rows", "t_cols")],
        ).withColumn("_v", (F.col("_s") / F.col("_ws")).cast("float").cast("double")).drop("_s", "_ws")

    wide = one_axis(sized, "col", "n_cols", "t_cols", ["row"])
    tall = one_axis(wide, "row", "n_rows", "t_rows", ["col"])
    return tall.select(*CELL, F.col("_v").cast("float").alias(alias))


def _nearest_taps(index: Column, src: Column, dst: Column) -> Column:
    """Targets whose nearest source line is `index`: floor((t + 0.5) * src / dst)."""
    scale = src / dst
    first = F.greatest(F.lit(0), F.floor(index / scale - 0.5).cast("int"))
    last = F.least(dst - 1, F.ceil((index + 1) / scale - 0.5).cast("int"))
    candidates = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.filter(candidates, lambda t: F.floor((t + 0.5) * scale) == index)


def resize_nearest(cells: DataFrame, sizes: DataFrame, value: str, alias: str = "valid") -> DataFrame:
    """Nearest resize: each source cell is copied to the targets that pick it; no shuffle."""
    sized = attach(cells.select(*CELL, F.col(value).alias("_v")), sizes, keep_extent=True)
    return sized.select(
        "scene_id",
        F.explode(_nearest_taps(F.col("row"), F.col("n_rows"), F.col("t_rows"))).alias("row"),
        "col",
        "_v",
        "n_cols",
        "t_cols",
    ).select(
        "scene_id",
        "row",
        F.explode(_nearest_taps(F.col("col"), F.col("n_cols"), F.col("t_cols"))).alias("col"),
        F.col("_v").alias(alias),
    )


def resize_elevation(elevation: DataFrame, targets: DataFrame) -> DataFrame:
    """Resized values and mask. `targets` has scene_id, t_rows, t_cols."""
    sizes = materialise(extent(elevation).join(targets, "scene_id"))
    ok = F.coalesce(F.col("valid"), F.lit(False))
    stats = exact_percentiles(elevation, "value", {"_median": 0.5}, where=ok).select(
        "scene_id", "_median", "n_rows", "n_cols"
    )
    filled = attach(elevation, stats, how="left").withColumn(
        "_f", F.when(ok, dbl("value")).otherwise(F.coalesce("_median", F.lit(0.0))).cast("float")
    )
    values = resize_bilinear(filled, sizes, "_f")
    masks = resize_nearest(elevation.withColumn("_ok", ok), sizes, "_ok")
    return values.join(masks, list(CELL)).withColumn("valid", F.col("valid") & is_finite("value"))


def reproject_elevation(elevation: DataFrame, headers: DataFrame) -> DataFrame:
    """Bilinear values and nearest mask on the destination grid.

    `headers` has one row per scene: src and dst structs with crs, transform,
    width, height. Weights are renormalised over valid taps; a destination
    centre outside the source raster is invalid.
    """
    per_scene = materialise(headers)
    lines = per_scene.withColumn("t_row", F.explode(F.sequence(F.lit(0), F.col("dst.height") - 1)))
    # a stated number, as lines are few bytes that Spark would merge into one task
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    targets = lines.repartition(parts, "scene_id", "t_row").withColumn(
        "t_col", F.explode(F.sequence(F.lit(0), F.col("dst.width") - 1))
    )
    x, y = forward(F.col("dst.transform"), F.col("t_col") + 0.5, F.col("t_row") + 0.5)
    sx, sy = reproject_point(x, y, F.col("dst.crs"), F.col("src.crs"))
    u, v = inverse(F.col("src.transform"), sx, sy)
    placed = targets.withColumns({"_u": u, "_v": v, "_h": F.col("src.height"), "_w": F.col("src.width")})
    row, col, weights = patch_weights(F.col("_u") - 0.5, F.col("_v") - 0.5)
    inside = (
        (F.col("_u") >= 0) & (F.col("_v") >= 0) & (F.col("_u") < F.col("_w")) & (F.col("_v") < F.col("_h"))
    )
    wanted = placed.select(
        "scene_id",
        "t_row",
        "t_col",
        F.coalesce(inside, F.lit(False)).alias("_in"),
        row.alias("row"),
        col.alias("col"),
        # which patch tap is the nearest cell
        F.concat(
            (F.floor("_u") - F.greatest(F.lit(0), F.floor(F.col("_u") - 0.5))).cast("string"),
            (F.floor("_v") - F.greatest(F.lit(0), F.floor(F.col("_v") - 0.5))).cast("string"),
        ).alias("_near"),
        *[w.alias(f"_w{k}") for k, w in weights.items()],
    )
    ok = F.coalesce(F.col("valid"), F.lit(False)) & is_finite("value")
    joined = wanted.join(with_patch(elevation, "value", ok), list(CELL), "left")
    top, bottom, nearest = F.lit(0.0), F.lit(0.0), F.lit(False)
    for k in ("00", "10", "01", "11"):
        usable = F.col(f"v{k}").isNotNull()
        top = top + F.when(usable, F.col(f"_w{k}") * F.col(f"v{k}")).otherwise(0.0)
        bottom = bottom + F.when(usable, F.col(f"_w{k}")).otherwise(0.0)
        nearest = nearest | ((F.col("_near") == k) & usable)
    value = F.when(F.col("_in") & (bottom > 0), F.try_divide(top, bottom)).cast("float")
    return joined.select(
        "scene_id",
        F.col("t_row").alias("row"),
        F.col("t_col").alias("col"),
        value.alias("value"),
        (F.col("_in") & nearest & value.isNotNull()).alias("valid"),
    )


def align_elevation(
    elevation: DataFrame, src_headers: DataFrame, dst_headers: DataFrame, label: str = "Elevation raster"
) -> tuple[DataFrame, DataFrame]:
    """Route each scene to its alignment. Returns (aligned cells, modes).

    Headers have scene_id, width, height, crs, transform. Scenes without an
    elevation header are absent from both results.
    """
    fields = [F.col(c) for c in ("width", "height", "crs", "transform")]
    pairs = src_headers.select("scene_id", F.struct(*fields).alias("src")).join(
        dst_headers.select("scene_id", F.struct(*fields).alias("dst")), "scene_id"
    )
    mode, notice = alignment_mode(F.col("src"), F.col("dst"), label)
    pairs = materialise(pairs.withColumn("mode", mode).withColumn("notice", notice))
    routed = attach(
        elevation.select(*CELL, "value", "valid"),
        pairs.select(
            "scene_id", "mode", F.col("src.height").alias("n_rows"), F.col("src.width").alias("n_cols")
        ),
    )
    same = routed.where(F.col("mode").isin("same_grid", "assumed")).drop("mode")
    parts = [same]
    present = {r["mode"] for r in pairs.select("mode").distinct().collect()}
    if "georeferenced" in present:
        geo = pairs.where("mode = 'georeferenced'").select("scene_id", "src", "dst")
        parts.append(reproject_elevation(routed.where("mode = 'georeferenced'").drop("mode"), geo))
    if "resized" in present:
        targets = pairs.where("mode = 'resized'").select(
            "scene_id", F.col("dst.height").alias("t_rows"), F.col("dst.width").alias("t_cols")
        )
        parts.append(resize_elevation(routed.where("mode = 'resized'").drop("mode"), targets))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, pairs.select("scene_id", "mode", "notice")


__all__ = [
    "align_elevation",
    "align_same_grid",
    "alignment_mode",
    "reproject_elevation",
    "resize_bilinear",
    "resize_elevation",
    "resize_nearest",
]
