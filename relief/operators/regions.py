"""Per-region measures, roof planes, rejection rules and footprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from relief.functions.core import EPS32, clamp, dbl
from relief.functions.pixel import vegetation, water
from relief.operators import components, focal
from relief.operators.grid import attach, extent_aggs
from relief.operators.mesh import fill_invalid
from relief.operators.stats import exact_percentiles_of
from relief.session import materialise

REGION = ("scene_id", "label")

# Segmentation and acceptance thresholds.
GROUND_RADIUS = 32
HEIGHT_THRESHOLD = 0.035
MIN_AREA = 16
PLANE_SHARE = 0.94
MIN_FILL = 0.28
MAX_ASPECT = 6.5
MIN_SPAN = 3.5
MAX_GREEN = 0.65
LARGE_SHARE = 0.02
LARGE_GREEN = 0.48
LARGE_WATER = 0.50
HUGE_SHARE = 0.40
HUGE_FILL = 0.22
RELIEF_SHARE = 0.012
# variances whose product falls below this share of the trace are one line
_LINE = 1e-13


def plane_fit(cells: DataFrame, value: str) -> DataFrame:
    """z = a*x + b*y + c per region from centred sums, minimum-norm when the
    cells lie on a line. One row per region, with its extent."""
    x, y, z = dbl("col"), dbl("row"), dbl(value)
    m = cells.groupBy(*REGION).agg(
        F.count(F.lit(1)).alias("area"),
        F.avg(x).alias("_mx"),
        F.avg(y).alias("_my"),
        F.avg(z).alias("_mz"),
        F.var_pop(x).alias("_xx"),
        F.var_pop(y).alias("_yy"),
        F.covar_pop(x, y).alias("_xy"),
        F.covar_pop(x, z).alias("_xz"),
        F.covar_pop(y, z).alias("_yz"),
        *extent_aggs(),
    )
    xx, yy, xy, xz, yz = map(F.col, ("_xx", "_yy", "_xy", "_xz", "_yz"))
    det, trace2 = xx * yy - xy * xy, (xx + yy) * (xx + yy)
    line = det <= trace2 * _LINE
    a = F.when(line, F.try_divide(xx * xz + xy * yz, trace2)).otherwise(F.try_divide(yy * xz - xy * yz, det))
    b = F.when(line, F.try_divide(xy * xz + yy * yz, trace2)).otherwise(F.try_divide(xx * yz - xy * xz, det))
    fitted = m.withColumn("plane_a", F.coalesce(a, F.lit(0.0))).withColumn("plane_b", F.coalesce(b, F.lit(0.0)))
    c = F.col("_mz") - F.col("plane_a") * F.col("_mx") - F.col("plane_b") * F.col("_my")
    return fitted.withColumn("plane_c", c).drop("_mx", "_my", "_mz", "_xx", "_yy", "_xy", "_xz", "_yz")


def level_roofs(
    cells: DataFrame,
    value: str,
    valid: Column | None = None,
    radius: int = GROUND_RADIUS,
    threshold: float = HEIGHT_THRESHOLD,
    min_area: int = MIN_AREA,
    alias: str = "roofed",
) -> tuple[DataFrame, DataFrame]:
    """A12 over W2a and W8: (cells with `alias` and `ground`, region cells).

    The region cells are (scene_id, row, col, label). Scenes without relief or
    regions keep their surface.
    """
    filled = fill_invalid(cells, value, valid, "_f")
    spread = F.col("high") - F.col("low")
    ready = filled.withColumn("_cut", F.when(spread > EPS32, spread * float(threshold))).drop("low", "high")
    # both the mask and the surface below read it
    grounded = materialise(focal.ground_surface(ready, "_f", radius, "ground"))
    above = (dbl("_f").cast("float") - F.col("ground").cast("float")).cast("float").cast("double")
    labels = materialise(components.label_regions(grounded.where(above > F.col("_cut")), min_area))
    inside = labels.join(grounded.select("scene_id", "row", "col", "_f"), ["scene_id", "row", "col"])
    planes = plane_fit(inside, "_f").drop("area")
    z = dbl("_f")
    fitted = F.col("plane_a") * F.col("col") + F.col("plane_b") * F.col("row") + F.col("plane_c")
    levelled = attach(inside, planes, REGION).select(
        "scene_id", "row", "col", (PLANE_SHARE * fitted + (1.0 - PLANE_SHARE) * z).cast("float").alias("_new")
    )
    out = grounded.join(levelled, ["scene_id", "row", "col"], "left").withColumn(
        alias, F.when(F.col("_ok"), F.coalesce("_new", F.col("_f"))).otherwise(F.col(value)).cast("float")
    )
    return out.drop("_f", "_cut", "_ok", "_new"), labels


def oriented_boxes(region_cells: DataFrame, colours: bool = False) -> DataFrame:
    """Principal axes and the rectangle along them, one row per region.

    With `colours` the cells carry r, g, b and the green and water shares are
    measured as well.
    """
    x, y = dbl("col"), dbl("row")
    shares = (
        [
            F.avg(vegetation("r", "g", "b").cast("double")).alias("green_fraction"),
            F.avg(water("r", "g", "b").cast("double")).alias("water_fraction"),
        ]
        if colours
        else [F.lit(0.0).alias("green_fraction"), F.lit(0.0).alias("water_fraction")]
    )
    m = region_cells.groupBy(*REGION).agg(
        F.count(F.lit(1)).alias("area"),
        F.avg(x).alias("centre_x"),
        F.avg(y).alias("centre_y"),
        F.var_pop(x).alias("_xx"),
        F.var_pop(y).alias("_yy"),
        F.covar_pop(x, y).alias("_xy"),
        *shares,
        *extent_aggs(),
    )
    # the axis of an uncorrelated region is exact; otherwise half the angle
    angle = F.atan2(2.0 * F.col("_xy"), F.col("_xx") - F.col("_yy")) / 2.0
    straight = F.abs("_xy") <= 1e-12 * (F.col("_xx") + F.col("_yy"))
    upright = straight & (F.col("_yy") >= F.col("_xx") * (1.0 - 1e-12))
    axes = m.withColumns(
        {
            "axis_x": F.when(upright, 0.0).when(straight, 1.0).otherwise(F.cos(angle)),
            "axis_y": F.when(upright, 1.0).when(straight, 0.0).otherwise(F.sin(angle)),
        }
    ).drop("_xx", "_yy", "_xy")
    axes = materialise(axes)
    placed = attach(
        region_cells.select(*REGION, "row", "col"),
        axes.select(*REGION, "centre_x", "centre_y", "axis_x", "axis_y", "n_rows", "n_cols", "row_0", "col_0"),
        REGION,
        stored=True,
    )
    dx, dy = F.col("col") - F.col("centre_x"), F.col("row") - F.col("centre_y")
    major = dx * F.col("axis_x") + dy * F.col("axis_y")
    minor = dy * F.col("axis_x") - dx * F.col("axis_y")
    spans = placed.groupBy(*REGION).agg(
        (F.min(major) - 0.5).alias("low_major"),
        (F.max(major) + 0.5).alias("high_major"),
        (F.min(minor) - 0.5).alias("low_minor"),
        (F.max(minor) + 0.5).alias("high_minor"),
    )
    boxes = axes.join(spans, list(REGION)).withColumns(
        {
            "span_major": F.greatest(F.lit(1.0), F.col("high_major") - F.col("low_major")),
            "span_minor": F.greatest(F.lit(1.0), F.col("high_minor") - F.col("low_minor")),
        }
    )
    longer, shorter = F.greatest("span_major", "span_minor"), F.least("span_major", "span_minor")
    return boxes.withColumns(
        {
            "fill": F.col("area") / (F.col("span_major") * F.col("span_minor")),
            "aspect": longer / F.greatest(F.lit(1.0), shorter),
            "min_span": shorter,
        }
    )


def rejection(
    scene_cells: Column, min_area: int = MIN_AREA, min_fill: float = MIN_FILL, min_span: float = MIN_SPAN
) -> Column:
    """The first shape or colour rule a region breaks, or NULL."""
    share = F.col("span_major") * F.col("span_minor") / scene_cells
    return (
        F.when(F.col("area") < min_area, "area")
        .when(F.col("fill") < min_fill, "fill")
        .when(F.col("aspect") > MAX_ASPECT, "aspect")
        .when(F.col("min_span") < min_span, "span")
        .when((share > HUGE_SHARE) & (F.col("fill") < HUGE_FILL), "amorphous")
        .when(F.col("green_fraction") > MAX_GREEN, "green")
        .when((share > LARGE_SHARE) & (F.col("green_fraction") > LARGE_GREEN), "large_green")
        .when((share > LARGE_SHARE) & (F.col("water_fraction") > LARGE_WATER), "large_water")
    )


def confidence() -> Column:
    """A16."""
    return F.col("fill") * (1.0 - 0.65 * F.col("green_fraction") - 0.45 * F.col("water_fraction"))


def region_heights(region_cells: DataFrame, roof: str = "roof", ground: str = "ground") -> DataFrame:
    """Median roof and base height per region."""
    both = exact_percentiles_of(region_cells, {"roof": roof, "base": ground}, {"height": 0.5}, REGION)
    return both.select(*REGION, "roof_height", "base_height")


def judge_regions(
    region_cells: DataFrame,
    scene: DataFrame,
    colours: bool = False,
    min_area: int = MIN_AREA,
    limit: int | None = None,
    min_fill: float = MIN_FILL,
    min_span: float = MIN_SPAN,
) -> DataFrame:
    """Every region with its measures, `reason` and `rank`.

    `region_cells` has roof and ground per cell; `scene` has scene_id, low and
    high of the roof surface, n_rows and n_cols. `accepted` says which regions
    pass. With a `limit`, `rank` numbers a scene's largest passing regions, larger
    label first among equals, and those beyond the limit are not accepted; without
    one `rank` is NULL and no scene's regions are sorted.
    """
    boxes = oriented_boxes(region_cells, colours)
    measured = boxes.join(region_heights(region_cells), list(REGION), "left")
    sized = measured.join(
        scene.select(
            "scene_id",
            (F.col("high") - F.col("low")).alias("_spread"),
            (F.col("n_rows").cast("double") * F.col("n_cols")).alias("_cells"),
        ),
        "scene_id",
    )
    relief = F.greatest(F.col("_spread") * RELIEF_SHARE, F.lit(EPS32))
    reason = F.coalesce(
        rejection(F.col("_cells"), min_area, min_fill, min_span),
        F.when(F.col("roof_height").isNull() | F.col("base_height").isNull(), "heights"),
        F.when(F.col("roof_height") - F.col("base_height") < relief, "relief"),
    )
    judged = sized.withColumn("reason", reason).withColumn("confidence", confidence()).drop("_spread", "_cells")
    passed = F.col("reason").isNull()
    if limit is None:
        return judged.withColumns({"accepted": passed, "rank": F.lit(None).cast("int")})
    order = Window.partitionBy("scene_id").orderBy(F.col("area").desc(), F.col("label").desc())
    accepted = (
        judged.where("reason IS NULL")
        .select(*REGION, "area")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .drop("area")
    )
    ranked = judged.join(accepted, list(REGION), "left")
    return ranked.withColumn("accepted", F.col("rank").isNotNull())


def box_corners(n_cols: Column, n_rows: Column) -> Column:
    """Corners of the oriented rectangle in pixel coordinates, clipped to the grid."""

    def corner(a: str, b: str) -> Column:
        u, v = F.col(a), F.col(b)
        x = u * F.col("axis_x") - v * F.col("axis_y") + F.col("centre_x")
        y = u * F.col("axis_y") + v * F.col("axis_x") + F.col("centre_y")
        return F.struct(x.alias("x"), y.alias("y"))

    return clip_points(
        F.array(
            corner("low_major", "low_minor"),
            corner("high_major", "low_minor"),
            corner("high_major", "high_minor"),
            corner("low_major", "high_minor"),
        ),
        n_cols,
        n_rows,
    )


def clip_points(points: Column, n_cols: Column, n_rows: Column) -> Column:
    last_x, last_y = F.greatest(F.lit(0), n_cols - 1), F.greatest(F.lit(0), n_rows - 1)
    return F.transform(
        points,
        lambda p: F.struct(
            clamp(p["x"], F.lit(0.0), last_x.cast("double")).alias("x"),
            clamp(p["y"], F.lit(0.0), last_y.cast("double")).alias("y"),
        ),
    )


def footprints(judged: DataFrame, outlines: DataFrame, sizes: DataFrame) -> DataFrame:
    """Accepted regions as footprints on the [0, 1] square.

    Outlines are pixel-edge polygons and move by half a cell onto cell centres;
    a region without one uses the corners of its rectangle.
    """
    accepted = judged.where("accepted").drop("n_rows", "n_cols", "row_0", "col_0")
    sized = accepted.join(sizes.select("scene_id", "n_rows", "n_cols"), "scene_id").join(
        outlines.select(*REGION, F.col("points").alias("_outline")), list(REGION), "left"
    )
    n_cols, n_rows = F.col("n_cols"), F.col("n_rows")
    shifted = F.transform(
        "_outline", lambda p: F.struct((p["x"] - 0.5).alias("x"), (p["y"] - 0.5).alias("y"))
    )
    pixels = F.coalesce(clip_points(shifted, n_cols, n_rows), box_corners(n_cols, n_rows))
    unit = F.transform(
        pixels,
        lambda p: F.struct(
            (p["x"] / F.greatest(F.lit(1), n_cols - 1)).alias("u"),
            (p["y"] / F.greatest(F.lit(1), n_rows - 1)).alias("v"),
        ),
    )
    return sized.select(
        "scene_id",
        "label",
        unit.alias("points"),
        "roof_height",
        "base_height",
        F.col("area").alias("area_pixels"),
        "confidence",
        F.lit("segmentation").alias("source"),
    )


def lower_to_ground(cells: DataFrame, region_cells: DataFrame, accepted: DataFrame, value: str, ground: str = "ground") -> DataFrame:
    """Cells of accepted regions take the ground surface.

    `accepted` has scene_id, label and the region's extent.
    """
    hit = attach(region_cells, accepted.select(*REGION, "n_rows", "n_cols", "row_0", "col_0"), REGION).select(
        "scene_id", "row", "col", F.lit(True).alias("_hit")
    )
    return cells.join(hit, ["scene_id", "row", "col"], "left").withColumn(
        value, F.when(F.col("_hit"), F.col(ground)).otherwise(F.col(value))
    ).drop("_hit")
