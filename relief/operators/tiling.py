"""Overlapping prediction tiles: user estimators, matching and blending."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from relief.functions.core import EPS32, dbl, half_even, is_finite
from relief.operators.align import resize_bilinear
from relief.operators.grid import attach, extent
from relief.operators.stats import exact_percentiles
from relief.session import materialise

Estimator = Callable[[np.ndarray], np.ndarray]

# Overlap share and the share kept from the whole-scene pass.
OVERLAP_SHARE = 0.25
GLOBAL_SHARE = 0.15
MIN_WEIGHT = 0.05
MIN_MATCHED = 32
PATCH = 14
TILE_KEY = ("scene_id", "tile_y", "tile_x")


def overlap_of(size: int, patch: int = PATCH) -> int:
    return min(size - 1, max(4 * patch, int(size * OVERLAP_SHARE)))


def tile_starts(length: Column, size: int, overlap: int) -> Column:
    """Starts covering an axis, the last tile flush with its end."""
    stride = max(1, size - overlap)
    last = (length - size).cast("int")
    regular = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))
    return F.when(length <= size, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(regular, F.array(last))))


def _covering(position: str, length: Column, size: int, overlap: int) -> Column:
    """Starts of the tiles that contain a position, by arithmetic rather than search."""
    stride = max(1, size - overlap)
    at, last = F.col(position), (length - size).cast("int")
    first = F.greatest(F.lit(0), F.ceil((at - size + 1) / stride).cast("int"))
    final = F.floor(F.least(at, last) / stride).cast("int")
    regular = F.when(
        first <= final, F.transform(F.sequence(first, final), lambda k: (k * stride).cast("int"))
    ).otherwise(F.array().cast("array<int>"))
    flush = F.when(at >= last, F.array(last)).otherwise(F.array().cast("array<int>"))
    return F.when(length <= size, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(regular, flush)))


def explode_tiles(cells: DataFrame, size: int, overlap: int) -> DataFrame:
    """Copy each cell to every tile that covers it. Needs n_rows and n_cols."""
    return cells.withColumn("tile_y", F.explode(_covering("row", F.col("n_rows"), size, overlap))).withColumn(
        "tile_x", F.explode(_covering("col", F.col("n_cols"), size, overlap))
    )


def blend_weight(size: int) -> Column:
    """Feather weight of a cell in its tile; tiles at a short axis are shorter."""

    def axis(position: str, start: str, length: str) -> Column:
        span = F.least(F.lit(size), F.col(length))
        phase = (F.col(position) - F.col(start)) * math.pi / (span - 1)
        return F.when(span <= 2, F.lit(1.0)).otherwise(F.greatest(F.sin(phase), F.lit(MIN_WEIGHT)))

    return axis("row", "tile_y", "n_rows") * axis("col", "tile_x", "n_cols")


def match_scale(predicted: DataFrame, value: str, reference: str, keys: tuple[str, ...]) -> DataFrame:
    """Scale and offset that bring a tile's p5/p50/p95 onto the reference's.

    Keys are bounded groups: tiles. Fewer than 32 comparable cells leave the
    prediction as it is.
    """
    pair = is_finite(value) & is_finite(reference)
    probs = F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))
    stats = predicted.groupBy(*keys).agg(
        F.count_if(pair).alias("_n"),
        F.percentile(F.when(pair, dbl(value)), probs).alias("_p"),
        F.percentile(F.when(pair, dbl(reference)), probs).alias("_q"),
    )
    return _with_scale(stats).select(*keys, "scale", "offset")


def _with_scale(stats: DataFrame) -> DataFrame:
    """Add scale and offset from the count `_n` and the p5/p50/p95 of both sides."""
    span_p, span_q = F.col("_p")[2] - F.col("_p")[0], F.col("_q")[2] - F.col("_q")[0]
    scale = F.when((span_p <= EPS32) | (span_q <= EPS32), F.lit(1.0)).otherwise(F.try_divide(span_q, span_p))
    enough = F.col("_n") >= MIN_MATCHED
    offset = F.when(enough, F.col("_q")[1] - F.col("scale") * F.col("_p")[1]).otherwise(F.lit(0.0))
    return stats.withColumn("scale", F.when(enough, scale).otherwise(F.lit(1.0))).withColumn("offset", offset)


def match_scene(cells: DataFrame, value: str, reference: str) -> DataFrame:
    """A21 for whole scenes of any size: the percentiles are counted, not collected."""
    pair = is_finite(value) & is_finite(reference)
    probs = {"_5": 0.05, "_50": 0.5, "_95": 0.95}

    def triple(column: str, alias: str) -> DataFrame:
        found = exact_percentiles(cells, column, probs, where=pair)
        return found.withColumn(alias, F.array(*probs)).drop(*probs, "low", "high")

    both = triple(value, "_p").withColumnRenamed("n", "_n").join(triple(reference, "_q").select("scene_id", "_q"), "scene_id")
    return _with_scale(both).drop("_p", "_q", "_n")


def blend_tiles(tiles: DataFrame, size: int, global_share: float = GLOBAL_SHARE) -> DataFrame:
    """Match every tile to the whole-scene depth, feather, and blend.

    `tiles` has the tile key, row, col, n_rows, n_cols, local (the tile's own
    prediction) and depth (the whole-scene prediction).
    """
    tiles = materialise(tiles)
    matched = tiles.join(match_scale(tiles, "local", "depth", TILE_KEY), list(TILE_KEY))
    weight = blend_weight(size)
    local = dbl("local") * F.col("scale") + F.col("offset")
    summed = matched.groupBy("scene_id", "row", "col").agg(
        F.sum(local * weight).alias("_s"), F.sum(weight).alias("_w"), F.first("depth").alias("_global")
    )
    blended = F.col("_s") / F.col("_w") * (1.0 - global_share) + dbl("_global") * global_share
    return summed.select("scene_id", "row", "col", blended.cast("float").alias("depth"))


def flip_average(cells: DataFrame, value: str = "depth", flipped: str = "flipped") -> DataFrame:
    """Mean of a prediction and its matched mirrored twin.

    `cells` has both on the mirrored image's own columns and n_cols.
    """
    mirrored = cells.select(
        "scene_id", "row", (F.col("n_cols") - 1 - F.col("col")).cast("int").alias("col"), F.col(flipped).alias("_m")
    )
    pairs = materialise(cells.drop(flipped).join(mirrored, ["scene_id", "row", "col"]))
    matched = attach(pairs.drop("n_cols"), match_scene(pairs, "_m", value), how="left")
    twin = dbl("_m") * F.coalesce("scale", F.lit(1.0)) + F.coalesce("offset", F.lit(0.0))
    return matched.select("scene_id", "row", "col", ((dbl(value) + twin) / 2.0).cast("float").alias("depth"))


def _estimate(fn: Estimator, keys: tuple[str, ...], mirror: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Run a user estimator on one bounded image and check what it returns."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = (group["row"] - group["row"].min()).to_numpy()
        cols = (group["col"] - group["col"].min()).to_numpy()
        image = np.zeros((rows.max() + 1, cols.max() + 1, 3), dtype=np.uint8)
        image[rows, cols] = group[["r", "g", "b"]].to_numpy(dtype=np.uint8)
        answer = fn(image[:, ::-1] if mirror else image)
        depth = np.asarray(answer[0] if isinstance(answer, tuple) else answer, dtype=np.float32)
        problem = None
        if depth.shape != image.shape[:2]:
            problem = f"Depth estimator returned {depth.shape}, expected {image.shape[:2]}"
        elif not np.isfinite(depth).any():
            problem = "Depth estimator returned no finite pixels"
        out = group[[*keys, "row", "col"]].copy()
        out["depth"] = np.float32(np.nan) if problem else depth[rows, cols]
        out["problem"] = problem
        return out

    return run


def _apply(cells: DataFrame, fn: Estimator, keys: tuple[str, ...], mirror: bool = False) -> DataFrame:
    types = "".join(f"{k} {'string' if k == 'scene_id' else 'int'}, " for k in keys)
    return cells.select(*keys, "row", "col", "r", "g", "b").groupBy(*keys).applyInPandas(
        _estimate(fn, keys, mirror), f"{types}row int, col int, depth float, problem string"
    )


def predict_whole(cells: DataFrame, fn: Estimator, max_side: int = 1024) -> DataFrame:
    """One pass over each scene at no more than max_side on its longer side.

    Larger scenes are resized down for the estimator and its depth is resized
    back, so one task never holds more than a bounded image.
    """
    sizes = extent(cells)
    longer = F.greatest("n_rows", "n_cols")
    scale = F.least(F.lit(1.0), F.lit(float(max_side)) / longer)
    sizes = materialise(
        sizes.withColumns(
            {
                "t_rows": F.greatest(F.lit(1.0), half_even(F.col("n_rows") * scale)).cast("int"),
                "t_cols": F.greatest(F.lit(1.0), half_even(F.col("n_cols") * scale)).cast("int"),
            }
        )
    )
    sized = attach(cells, sizes, keep_extent=True, stored=True)
    small = _apply(sized.where(longer <= max_side), fn, ("scene_id",))
    big_sizes = sizes.where(longer > max_side)
    if big_sizes.isEmpty():
        return small
    bands = F.array(*[F.struct(F.lit(c).alias("band"), F.col(c).alias("v")) for c in "rgb"])
    joined = F.concat_ws("\u0001", "scene_id", "band")
    long = cells.join(big_sizes.select("scene_id"), "scene_id", "left_semi").select(
        "scene_id", "row", "col", F.inline(bands)
    )
    named_sizes = big_sizes.withColumn("band", F.explode(F.array(*map(F.lit, "rgb")))).withColumn("scene_id", joined)
    shrunk = resize_bilinear(long.withColumn("scene_id", joined), named_sizes, "v")
    parts = F.split("scene_id", "\u0001")
    images = (
        shrunk.withColumn("band", parts[1])
        .withColumn("scene_id", parts[0])
        .groupBy("scene_id", "row", "col")
        .agg(*[F.max(F.when(F.col("band") == c, half_even("value"))).cast("smallint").alias(c) for c in "rgb"])
    )
    coarse = materialise(_apply(images, fn, ("scene_id",)))
    back = big_sizes.select(
        "scene_id",
        F.col("t_rows").alias("n_rows"),
        F.col("t_cols").alias("n_cols"),
        F.col("n_rows").alias("t_rows"),
        F.col("n_cols").alias("t_cols"),
    )
    grown = resize_bilinear(coarse.where("problem IS NULL"), back, "depth", "depth")
    failed = coarse.where("problem IS NOT NULL")
    return small.unionByName(grown.withColumn("problem", F.lit(None).cast("string"))).unionByName(failed)


def predict(
    cells: DataFrame,
    fn: Estimator,
    quality_mode: str = "fast",
    max_side: int = 1024,
    tile_size: int | None = None,
    patch: int = PATCH,
) -> tuple[DataFrame, DataFrame]:
    """Depth of every scene, and one record per scene of how it was made.

    Quality mode averages small scenes with their mirrored prediction and blends
    overlapping tiles over large ones. `cells` has r, g, b.
    """
    quality = quality_mode.strip().lower()
    if quality not in ("fast", "quality"):
        raise ValueError(f"quality_mode must be one of fast, quality, got {quality_mode!r}")
    size = tile_size or max_side
    overlap = overlap_of(size, patch)
    sizes = materialise(extent(cells))
    whole = materialise(predict_whole(cells, fn, max_side))
    problems = whole.where("problem IS NOT NULL").groupBy("scene_id").agg(F.first("problem").alias("problem"))
    longer = F.greatest("n_rows", "n_cols")
    tiled = (longer > size) & (F.lit(quality) == "quality")
    tiles = F.size(tile_starts(F.col("n_rows"), size, overlap)) * F.size(tile_starts(F.col("n_cols"), size, overlap))
    count = F.when(tiled, tiles).otherwise(F.lit(0))
    scale = F.least(F.lit(1.0), F.lit(float(max_side)) / longer)
    passes = F.when(tiled, tiles + 1).otherwise(F.lit(2 if quality == "quality" else 1))
    records = sizes.join(problems, "scene_id", "left").select(
        "scene_id",
        F.lit(quality).alias("quality_mode"),
        passes.alias("passes"),
        tiled.alias("tiled"),
        count.alias("tile_count"),
        # what one call of the estimator saw of the whole scene
        F.greatest(F.lit(1.0), half_even(F.col("n_cols") * scale)).cast("int").alias("bounded_width"),
        F.greatest(F.lit(1.0), half_even(F.col("n_rows") * scale)).cast("int").alias("bounded_height"),
        "problem",
    )
    depth = whole.where("problem IS NULL").drop("problem")
    if quality == "fast":
        return depth, records
    sized = attach(cells, sizes, keep_extent=True, stored=True).join(depth, ["scene_id", "row", "col"])
    flipped = _apply(sized.where(longer <= size), fn, ("scene_id",), mirror=True).select(
        "scene_id", "row", "col", F.col("depth").alias("flipped")
    )
    averaged = flip_average(
        sized.where(longer <= size).select("scene_id", "row", "col", "n_cols", "depth").join(
            flipped, ["scene_id", "row", "col"]
        )
    )
    large = explode_tiles(sized.where(longer > size), size, overlap)
    local = _apply(large, fn, TILE_KEY).select(*TILE_KEY, "row", "col", F.col("depth").alias("local"))
    blended = blend_tiles(
        large.select(*TILE_KEY, "row", "col", "n_rows", "n_cols", "depth").join(local, [*TILE_KEY, "row", "col"]), size
    )
    return averaged.unionByName(blended), records
