"""Point and lattice sampling of grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from relief.functions.core import clamp, dbl, half_up, is_finite
from relief.operators.focal import along_col, along_row, into_tiles, owned
from relief.operators.grid import attach, extent
from relief.session import materialise

CELL = ("scene_id", "row", "col")


def _sized(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Give each point the size of its scene; NULL for points off the grid."""
    cell = points.withColumn("row", F.greatest(F.lit(0), F.floor("y")).cast("int")).withColumn(
        "col", F.greatest(F.lit(0), F.floor("x")).cast("int")
    )
    return attach(cell, extent(grid), how="left", keep_extent=True).drop("row", "col")


def sample_points(
    points: DataFrame,
    grid: DataFrame,
    value: str = "depth",
    valid: str | None = None,
    method: str = "bilinear",
    point_id: Sequence[str] = ("scene_id", "x", "y"),
) -> DataFrame:
    """Sample a grid at zero-based pixel coordinates.

    Every point comes back once with `sampled` and a `status`: ok, outside, or
    invalid_pixel when a pixel with weight is masked, missing or not finite.
    """
    if method not in ("nearest", "bilinear"):
        raise ValueError("sampling must be 'nearest' or 'bilinear'")
    x, y = F.col("x"), F.col("y")
    sized = _sized(points, grid)
    last_col, last_row = F.col("n_cols") - 1, F.col("n_rows") - 1
    inside = F.coalesce((x >= 0) & (x <= last_col) & (y >= 0) & (y <= last_row), F.lit(False))
    if method == "nearest":
        taps = F.array(
            F.struct(
                F.least(half_up(y), last_row).cast("int").alias("row"),
                F.least(half_up(x), last_col).cast("int").alias("col"),
                F.lit(1.0).alias("w"),
            )
        )
    else:
        x0, y0 = F.floor(x), F.floor(y)
        tx, ty = x - x0, y - y0
        corner = [
            (y0, x0, (1.0 - tx) * (1.0 - ty)),
            (y0, F.least(x0 + 1, last_col), tx * (1.0 - ty)),
            (F.least(y0 + 1, last_row), x0, (1.0 - tx) * ty),
            (F.least(y0 + 1, last_row), F.least(x0 + 1, last_col), tx * ty),
        ]
        taps = F.filter(
            F.array(
                *[
                    F.struct(r.cast("int").alias("row"), c.cast("int").alias("col"), w.alias("w"))
                    for r, c, w in corner
                ]
            ),
            lambda t: t["w"] > 0,
        )
    taken = sized.withColumn("_inside", inside).withColumn(
        "_tap", F.explode_outer(F.when(F.col("_inside"), taps))
    )
    taken = taken.withColumns({c: F.col(f"_tap.{c}") for c in ("row", "col", "w")})
    ok = is_finite(value) if valid is None else is_finite(value) & F.coalesce(F.col(valid), F.lit(False))
    known = grid.select(*CELL, F.when(ok, dbl(value)).alias("_value"))
    kept = [c for c in points.columns if c not in point_id]
    out = (
        taken.join(known, list(CELL), "left")
        .groupBy(*point_id)
        .agg(
            *[F.first(c).alias(c) for c in kept],
            F.sum(F.col("w") * F.col("_value")).alias("_sum"),
            F.bool_and("_inside").alias("_in"),
            F.bool_or(F.col("_value").isNull()).alias("_bad"),
        )
    )
    status = F.when(~F.col("_in"), "outside").when(F.col("_bad"), "invalid_pixel").otherwise("ok")
    return out.withColumn("status", status).withColumn(
        "sampled", F.when(F.col("status") == "ok", F.col("_sum"))
    ).drop("_sum", "_in", "_bad")


def with_patch(cells: DataFrame, value: str, ok: Column) -> DataFrame:
    """Give each cell its right, lower and diagonal neighbour, NULL where unusable.

    Dense targets then need one equi-join on the cell under them instead of four
    rows per target and a regrouping.
    """
    tiles = into_tiles(cells.select(*CELL, F.when(ok, dbl(value)).alias("v00")), 1)
    tiles = tiles.withColumn("v10", F.lead("v00").over(along_row()))
    tiles = tiles.withColumn("v01", F.lead("v00").over(along_col())).withColumn(
        "v11", F.lead("v10").over(along_col())
    )
    return owned(tiles, 1)


def patch_weights(px: Column, py: Column) -> tuple[Column, Column, dict[str, Column]]:
    """Base cell and the four bilinear weights at (px, py) in cell-centre units.

    Left of or above the first centre the base is cell 0 and only real
    neighbours keep weight.
    """
    col, row = F.greatest(F.lit(0), F.floor(px)), F.greatest(F.lit(0), F.floor(py))

    def share(position: Column, index: Column) -> Column:
        return F.greatest(F.lit(0.0), 1.0 - F.abs(position - index))

    wx = (share(px, col), share(px, col + 1))
    wy = (share(py, row), share(py, row + 1))
    return row.cast("int"), col.cast("int"), {f"{i}{j}": wx[i] * wy[j] for i in (0, 1) for j in (0, 1)}


def lattice_targets(sizes: DataFrame, rows: Column, cols: Column) -> DataFrame:
    """Target cells of a new grid per scene, built where the data is.

    Row blocks first, so a large scene's targets are generated by many tasks.
    """
    blocks = sizes.withColumn("t_rows", rows.cast("int")).withColumn("t_cols", cols.cast("int"))
    blocks = blocks.withColumn("t_row", F.explode(F.sequence(F.lit(0), F.col("t_rows") - 1)))
    return blocks.repartition("scene_id", "t_row").withColumn(
        "t_col", F.explode(F.sequence(F.lit(0), F.col("t_cols") - 1))
    )


def sample_lattice(
    targets: DataFrame, cells: DataFrame, value: str, ok: Column, px: Column, py: Column, alias: str = "value"
) -> DataFrame:
    """Bilinear value at (px, py) of each target; NULL if a weighted tap is unusable."""
    row, col, weights = patch_weights(px, py)
    wanted = targets.withColumns({"row": row, "col": col, **{f"_w{k}": w for k, w in weights.items()}})
    joined = wanted.join(with_patch(cells, value, ok), list(CELL), "left")
    total, unusable = F.lit(0.0), F.lit(False)
    for k in ("00", "10", "01", "11"):
        w, v = F.col(f"_w{k}"), F.col(f"v{k}")
        total = total + F.when(w > 0, w * v).otherwise(0.0)
        unusable = unusable | ((w > 0) & v.isNull())
    return joined.withColumn(alias, F.when(~unusable, total)).drop(
        "row", "col", "v00", "v10", "v01", "v11", *[f"_w{k}" for k in weights]
    )


def pick_points(points: DataFrame, grid: DataFrame, value: str, width: Column, height: Column) -> DataFrame:
    """Texture coordinate (v upwards) to grid cell, source pixel and value."""
    sizes = extent(grid).withColumnRenamed("n_rows", "_h").withColumnRenamed("n_cols", "_w")
    sized = points.join(materialise(sizes), "scene_id")
    last_col, last_row = F.col("_w") - 1, F.col("_h") - 1
    gx = clamp(half_up(F.col("u") * last_col), F.lit(0), last_col).cast("int")
    gy = clamp(half_up((1.0 - F.col("v")) * last_row), F.lit(0), last_row).cast("int")
    placed = sized.withColumn("col", gx).withColumn("row", gy).withColumns(
        {
            "pixel_x": half_up(F.col("col") / F.greatest(F.lit(1), last_col) * F.greatest(F.lit(0), width - 1)).cast("int"),
            "pixel_y": half_up(F.col("row") / F.greatest(F.lit(1), last_row) * F.greatest(F.lit(0), height - 1)).cast("int"),
        }
    )
    return placed.drop("_h", "_w").join(
        grid.select(*CELL, F.col(value).alias("value")), list(CELL), "left"
    )
