"""Display grids, normals, triangles and walls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relief.functions.core import EPS32, clamp, dbl, half_even, half_up, is_finite
from relief.functions.pixel import already_unit, domain_unit, normal_bytes, quantise16
from relief.functions.ramps import CANVAS_RAMP, ramp_between
from relief.functions.ring import RING_GAP, next_point, tidy_ring
from relief.operators import focal
from relief.operators.align import resize_bilinear, resize_nearest
from relief.operators.grid import attach, extent
from relief.operators.sample import lattice_targets, sample_lattice
from relief.operators.stats import exact_percentiles, range_stats
from relief.operators.vector import highest_roof
from relief.session import materialise, shuffled

# Fixed values of the viewer: plane edge and vertical scale in scene units,
# relief a building must show, depth a wall is sunk below the terrain.
PLANE_EDGE = 5.6
HEIGHT_SCALE = 0.55
MIN_ROOF_STEP = 0.006
WALL_SINK = 0.025


def fill_invalid(cells: DataFrame, value: str, valid: Column | None, alias: str = "filled") -> DataFrame:
    """Invalid cells take the median of the valid ones, or 0 without any.

    Also leaves `low`/`high` of the valid cells and `_ok` on every cell.
    """
    ok = is_finite(value) if valid is None else is_finite(value) & F.coalesce(valid, F.lit(False))
    stats = exact_percentiles(cells, value, {"_median": 0.5}, where=valid).select(
        "scene_id", "_median", "low", "high", "n_rows", "n_cols"
    )
    filled = F.when(F.col("_ok"), dbl(value)).otherwise(F.coalesce("_median", F.lit(0.0))).cast("float")
    return (
        attach(cells, stats, how="left").withColumn("_ok", ok).withColumn(alias, filled).drop("_median")
    )


def normal_map(cells: DataFrame, value: str, valid: Column | None = None, strength: float = 24.0) -> DataFrame:
    """Tangent-space normals of the scaled surface.

    Filling with the median leaves the range of the valid cells unchanged.
    """
    filled = fill_invalid(cells, value, valid, "_z")
    span = F.col("high") - F.col("low")
    unit = F.when(span > EPS32, (dbl("_z") - F.col("low")) / span).otherwise(dbl("_z"))
    grads = focal.gradient(filled.withColumn("_u", unit).drop("_z", "low", "high", "_ok"), "_u")
    return grads.withColumns(normal_bytes(F.col("dx"), F.col("dy"), strength)).drop("_u", "dx", "dy")


def plane_size(n_cols: Column, n_rows: Column) -> tuple[Column, Column]:
    """Width and depth of the display plane: the longer side is the plane edge."""
    aspect = n_cols / F.greatest(F.lit(1), n_rows)
    wide = aspect >= 1
    return (
        F.when(wide, F.lit(PLANE_EDGE)).otherwise(F.lit(PLANE_EDGE) * aspect),
        F.when(wide, F.lit(PLANE_EDGE) / aspect).otherwise(F.lit(PLANE_EDGE)),
    )


def verticality(cells: DataFrame, value: str, minimum: Column, maximum: Column, alias: str = "verticality") -> DataFrame:
    """Slope of the display surface, capped at 1. Needs n_rows and n_cols."""
    tiles = focal.into_tiles(cells, 1)
    v = dbl(value)

    def step(window) -> Column:
        return F.coalesce(F.lead(v).over(window), v) - F.coalesce(F.lag(v).over(window), v)

    tiles = tiles.withColumn("_dh", step(focal.along_row())).withColumn("_dv", step(focal.along_col()))
    width, depth = plane_size(F.col("n_cols"), F.col("n_rows"))
    span = F.when(maximum - minimum == 0, F.lit(1.0)).otherwise(maximum - minimum)
    scale = F.when(already_unit(minimum, maximum), F.lit(1.0)).otherwise(1.0 / span)
    step_x = width / F.greatest(F.lit(1), F.col("n_cols") - 1)
    step_z = depth / F.greatest(F.lit(1), F.col("n_rows") - 1)
    slope_x = F.col("_dh") * scale * HEIGHT_SCALE / (2.0 * step_x)
    slope_z = F.col("_dv") * scale * HEIGHT_SCALE / (2.0 * step_z)
    return focal.owned(tiles.withColumn(alias, F.least(F.lit(1.0), F.hypot(slope_x, slope_z))), 1).drop("_dh", "_dv")


MESH_LONG_EDGE = 192
HEIGHT16_LONG_EDGE = 512
VIEWER_LIMIT = 512
CANVAS_LIMIT = 900


def _target_sizes(cells: DataFrame, long_edge: int) -> DataFrame:
    sizes = extent(cells)
    scale = F.lit(float(long_edge)) / F.greatest("n_cols", "n_rows")
    return materialise(
        sizes.withColumns(
            {
                "t_cols": F.greatest(F.lit(2.0), half_even(F.col("n_cols") * scale)).cast("int"),
                "t_rows": F.greatest(F.lit(2.0), half_even(F.col("n_rows") * scale)).cast("int"),
            }
        )
    )


def _resized(cells: DataFrame, value: str, valid: Column | None, long_edge: int) -> tuple[DataFrame, DataFrame]:
    sizes = _target_sizes(cells, long_edge)
    filled = fill_invalid(cells, value, valid, "_f")
    values = resize_bilinear(filled, sizes, "_f")
    masks = resize_nearest(filled, sizes, "_ok")
    return materialise(values.join(masks, ["scene_id", "row", "col"])), sizes


def mesh_grid(
    cells: DataFrame, value: str, valid: Column | None = None, long_edge: int = MESH_LONG_EDGE
) -> tuple[DataFrame, DataFrame]:
    """(grid, headers). Values have six decimals; a header says whether any
    source cell was invalid, in which case the grid's `valid` matters."""
    if not 64 <= long_edge <= 2048:
        raise ValueError("Mesh target long edge must be between 64 and 2048")
    grid, sizes = _resized(cells, value, valid, long_edge)
    ok = is_finite(value) if valid is None else is_finite(value) & F.coalesce(valid, F.lit(False))
    masked = cells.groupBy("scene_id").agg((~F.bool_and(ok)).alias("masked"))
    headers = (
        grid.groupBy("scene_id")
        .agg(F.min(dbl("value")).alias("minimum"), F.max(dbl("value")).alias("maximum"))
        .join(sizes.select("scene_id", F.col("t_cols").alias("width"), F.col("t_rows").alias("height")), "scene_id")
        .join(masked, "scene_id")
    )
    return grid.withColumn("value", half_even("value", 6)), headers


def height_grid16(
    cells: DataFrame, value: str, valid: Column | None = None, long_edge: int = HEIGHT16_LONG_EDGE
) -> tuple[DataFrame, DataFrame]:
    """(16-bit grid with mask, headers with the value range)."""
    grid, sizes = _resized(cells, value, valid, long_edge)
    stats = range_stats(grid, "value")
    coded = attach(grid, stats.drop("n")).withColumn("q", quantise16("value", F.col("low"), F.col("high")))
    headers = stats.select("scene_id", F.col("low").alias("minimum"), F.col("high").alias("maximum")).join(
        sizes.select("scene_id", F.col("t_cols").alias("width"), F.col("t_rows").alias("height")), "scene_id"
    ).join(grid.groupBy("scene_id").agg((~F.bool_and("valid")).alias("masked")), "scene_id")
    return coded.select("scene_id", "row", "col", "q", "valid"), headers


def viewer_grid(cells: DataFrame, value: str, valid: Column | None = None, limit: int = VIEWER_LIMIT) -> DataFrame:
    """Grid of at most `limit` cells a side with a display value and validity."""
    sizes = extent(cells)
    targets = lattice_targets(
        sizes, F.least(F.lit(limit), F.col("n_rows")), F.least(F.lit(limit), F.col("n_cols"))
    )
    u = F.col("t_col") / F.greatest(F.lit(1), F.col("t_cols") - 1)
    v = F.col("t_row") / F.greatest(F.lit(1), F.col("t_rows") - 1)
    px, py = u * (F.col("n_cols") - 1), v * (F.col("n_rows") - 1)
    sampled = sample_lattice(targets, cells, value, is_finite(value), px, py, "_value")
    at = sampled.withColumn("_r", half_up(py).cast("int")).withColumn("_c", half_up(px).cast("int"))
    mask = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    masks = cells.select("scene_id", F.col("row").alias("_r"), F.col("col").alias("_c"), mask.alias("_m"))
    joined = at.join(masks, ["scene_id", "_r", "_c"], "left")
    finite = F.col("_value").isNotNull()
    return joined.select(
        "scene_id",
        F.col("t_row").alias("row"),
        F.col("t_col").alias("col"),
        F.coalesce("_value", F.lit(0.0)).cast("float").alias("value"),
        (finite & F.coalesce("_m", F.lit(False))).alias("valid"),
    )


def view_domain(grid: DataFrame) -> DataFrame:
    """Height domain of a display grid: the valid range, or [0, 1] without one."""
    stats = range_stats(grid, "value", where=F.col("valid"))
    return stats.select(
        "scene_id",
        F.coalesce("low", F.lit(0.0)).alias("minimum"),
        F.coalesce("high", F.lit(1.0)).alias("maximum"),
        "n_rows",
        "n_cols",
    )


def triangles(grid: DataFrame, valid: str = "valid") -> DataFrame:
    """Two triangles per cell, each only when its three corners are valid.

    Corners are row-major vertex numbers of the display grid.
    """
    sized = attach(grid.select("scene_id", "row", "col", valid), extent(grid), keep_extent=True)
    tiles = focal.into_tiles(sized, 1)
    tiles = tiles.withColumn("_tr", F.lead(valid).over(focal.along_row()))
    tiles = tiles.withColumn("_bl", F.lead(valid).over(focal.along_col())).withColumn(
        "_br", F.lead("_tr").over(focal.along_col())
    )
    index = F.col("row").cast("long") * F.col("n_cols") + F.col("col")
    below = index + F.col("n_cols")
    corner = lambda a, b, c: F.struct(a.alias("a"), b.alias("b"), c.alias("c"))
    both = F.array_compact(
        F.array(
            F.when(F.col(valid) & F.col("_bl") & F.col("_tr"), corner(index, below, index + 1)),
            F.when(F.col("_tr") & F.col("_bl") & F.col("_br"), corner(index + 1, below, below + 1)),
        )
    )
    # a cell needs a right and a lower neighbour
    whole = focal.owned(tiles, 1).where(F.col("_tr").isNotNull() & F.col("_bl").isNotNull())
    return whole.select("scene_id", "row", "col", F.posexplode(both).alias("part", "t")).select(
        "scene_id", "row", "col", "t.a", "t.b", "t.c"
    )


def surface_heights(points: DataFrame, terrain: DataFrame, unit: str, footprints: DataFrame, roof: str, point_id: list[str]) -> DataFrame:
    """Display height at (u, v): the terrain or the highest roof over it.

    `terrain` has the normalised height `unit` on every cell.
    """
    sizes = extent(terrain)
    sized = points.join(materialise(sizes), "scene_id")
    px = clamp(F.col("u") * (F.col("n_cols") - 1), F.lit(0.0), (F.col("n_cols") - 1).cast("double"))
    py = clamp(F.col("v") * (F.col("n_rows") - 1), F.lit(0.0), (F.col("n_rows") - 1).cast("double"))
    ground = sample_lattice(sized, terrain, unit, is_finite(unit), px, py, "_ground").drop("n_rows", "n_cols")
    roofs = highest_roof(points, footprints, roof, point_id)
    out = shuffled(ground).join(roofs, point_id, "left")
    best = F.greatest(F.col("_ground"), F.coalesce("roof", F.col("_ground")))
    return out.withColumn("surface", (best - 0.5) * HEIGHT_SCALE).drop("_ground", "roof")


def wall_quads(footprints: DataFrame, terrain: DataFrame, unit: str, domain: DataFrame) -> DataFrame:
    """One wall per footprint edge, standing in the terrain.

    `footprints` has points, roof_height and base_height; `domain` the scene's
    minimum and maximum. Buildings without a visible step are skipped.
    """
    # stored, so that the test on a ring does not tidy it again
    shaped = materialise(footprints.withColumn("points", tidy_ring("points", RING_GAP, open_above=3))).where(
        F.col("points").isNotNull()
    )
    scaled = shaped.join(materialise(domain.select("scene_id", "minimum", "maximum")), "scene_id")
    units = scaled.withColumns(
        {
            "roof_unit": domain_unit(F.col("roof_height"), F.col("minimum"), F.col("maximum")),
            "base_unit": domain_unit(F.col("base_height"), F.col("minimum"), F.col("maximum")),
        }
    )
    seen = materialise(
        units.where(F.col("roof_unit") > F.col("base_unit") + MIN_ROOF_STEP).select(
            "scene_id", "footprint_id", "points", "roof_unit", "base_unit"
        )
    )
    edges = seen.select(
        "scene_id", "footprint_id", "roof_unit", "base_unit", "points", F.posexplode("points").alias("edge", "p")
    ).withColumn("q", next_point("points", F.col("edge")))
    vertices = edges.select("scene_id", "footprint_id", "edge", F.col("p.u").alias("u"), F.col("p.v").alias("v"))
    grounded = surface_heights(
        vertices, terrain, unit, seen, "roof_unit", ["scene_id", "footprint_id", "edge"]
    ).select("scene_id", "footprint_id", "edge", "surface")
    base = (F.col("base_unit") - 0.5) * HEIGHT_SCALE
    count = F.size("points")
    far = grounded.select("scene_id", "footprint_id", F.col("edge").alias("_next"), F.col("surface").alias("_far"))
    joined = (
        shuffled(edges.withColumn("_next", (F.col("edge") + 1) % count))
        .join(grounded, ["scene_id", "footprint_id", "edge"])
        .join(far, ["scene_id", "footprint_id", "_next"])
    )
    return joined.select(
        "scene_id",
        "footprint_id",
        "edge",
        F.col("p.u").alias("u0"),
        F.col("p.v").alias("v0"),
        F.col("q.u").alias("u1"),
        F.col("q.v").alias("v1"),
        ((F.col("roof_unit") - 0.5) * HEIGHT_SCALE + 0.003).alias("top"),
        F.least(base, F.col("surface") - WALL_SINK).alias("foot0"),
        F.least(base, F.col("_far") - WALL_SINK).alias("foot1"),
    )


def canvas_grid(cells: DataFrame, value: str, limit: int = CANVAS_LIMIT) -> DataFrame:
    """Nearest resample to at most `limit` a side, coloured with the canvas ramp."""
    stats = range_stats(cells, value)
    scale = F.least(F.lit(1.0), F.lit(float(limit)) / F.greatest("n_cols", "n_rows"))
    targets = lattice_targets(
        stats,
        F.greatest(F.lit(1), half_up(F.col("n_rows") * scale).cast("int")),
        F.greatest(F.lit(1), half_up(F.col("n_cols") * scale).cast("int")),
    )
    at = targets.withColumns(
        {
            "row": half_up(F.col("t_row") / F.greatest(F.lit(1), F.col("t_rows") - 1) * (F.col("n_rows") - 1)).cast("int"),
            "col": half_up(F.col("t_col") / F.greatest(F.lit(1), F.col("t_cols") - 1) * (F.col("n_cols") - 1)).cast("int"),
        }
    )
    joined = at.join(cells.select("scene_id", "row", "col", dbl(value).alias("_v")), ["scene_id", "row", "col"], "left")
    span = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(F.lit(1.0))
    unit = F.when(is_finite("_v"), clamp((F.col("_v") - F.col("low")) / span, 0.0, 1.0)).otherwise(F.lit(0.0))
    coloured = joined.withColumn("unit", unit)
    colours = ramp_between(F.col("unit"), CANVAS_RAMP, rounded=True)
    return coloured.select(
        "scene_id",
        F.col("t_row").alias("row"),
        F.col("t_col").alias("col"),
        *[c.alias(n) for n, c in colours.items()],
    )


def unpack_grid(grids: DataFrame, values: str = "values") -> DataFrame:
    """Flat value lists with an optional width to cells.

    Without a width the grid is taken as square; rows that would be incomplete
    are those the list does not reach.
    """
    width = F.greatest(
        F.lit(1), F.coalesce(F.nullif(F.col("width"), F.lit(0)), half_up(F.sqrt(F.size(values))).cast("int"), F.lit(1))
    ).cast("int")
    return grids.withColumn("_w", width).select(
        "scene_id", "_w", F.posexplode(values).alias("_i", "value")
    ).select(
        "scene_id",
        F.expr("cast(_i div _w as int)").alias("row"),
        F.expr("cast(_i % _w as int)").alias("col"),
        "value",
    )


def unpack_nested(grids: DataFrame, values: str = "values") -> DataFrame:
    """Nested rows of values to cells."""
    return grids.select("scene_id", F.posexplode(values).alias("row", "_row")).select(
        "scene_id", "row", F.posexplode("_row").alias("col", "value")
    )
