"""Neighbourhood operators as window frames inside halo tiles.

Cells are sent once to every tile whose halo covers them and partitioned by
(scene, tile). Hash partitioning on the tile already satisfies the windows over
(scene, tile, row) and (scene, tile, col), so a filter made of many passes along
both axes costs one shuffle and local sorts, and no window sees more than a tile.
Grids are dense: every cell of the scene's rectangle is a row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from relief.functions.core import EPS32, clamp, dbl, half_even, is_finite
from relief.operators.grid import attach, extent
from relief.operators.stats import exact_percentiles, exact_percentiles_of, range_stats
from relief.session import materialise

TILE = ("scene_id", "_ty", "_tx")


def tile_side(halo: int) -> int:
    """Tile edge that keeps the duplicated border below about 60% of the data."""
    return max(256, 8 * halo)


def into_tiles(cells: DataFrame, halo: int, side: int | None = None) -> DataFrame:
    """Copy each cell to the tiles that need it and partition by tile."""
    side = side or tile_side(halo)

    def covering(axis: str) -> Column:
        first = F.greatest(F.lit(0), F.floor((F.col(axis) - halo) / side).cast("int"))
        return F.explode(F.sequence(first, F.floor((F.col(axis) + halo) / side).cast("int")))

    return (
        cells.withColumn("_ty", covering("row"))
        .withColumn("_tx", covering("col"))
        .repartition(*TILE)
    )


def owned(tiles: DataFrame, halo: int, side: int | None = None) -> DataFrame:
    """Drop halo copies, leaving each cell once."""
    side = side or tile_side(halo)
    mine = (F.floor(F.col("row") / side) == F.col("_ty")) & (F.floor(F.col("col") / side) == F.col("_tx"))
    return tiles.where(mine).drop("_ty", "_tx")


def along_row(radius: int | None = None):
    window = Window.partitionBy(*TILE, "row").orderBy("col")
    return window if radius is None else window.rowsBetween(-radius, radius)


def along_col(radius: int | None = None):
    window = Window.partitionBy(*TILE, "col").orderBy("row")
    return window if radius is None else window.rowsBetween(-radius, radius)


def reduce_square(
    tiles: DataFrame,
    columns: Mapping[str, Column | str],
    radius: int,
    reducer: Callable[[Column], Column] = F.sum,
    row_first: bool = True,
) -> DataFrame:
    """Separable reduction over a (2r+1)^2 window truncated at borders."""
    first, second = (along_row, along_col) if row_first else (along_col, along_row)
    one = {name: reducer(F.col(c) if isinstance(c, str) else c).over(first(radius)) for name, c in columns.items()}
    two = {name: reducer(F.col(name)).over(second(radius)) for name in columns}
    return tiles.withColumns(one).withColumns(two)


def box_mean(cells: DataFrame, value: str, radius: int, alias: str = "box_mean") -> DataFrame:
    """Window mean, the sum and the cell count of the truncated window."""
    tiles = into_tiles(cells, radius)
    summed = reduce_square(tiles, {"box_sum": dbl(value), "box_count": F.lit(1)}, radius)
    return owned(summed, radius).withColumn(alias, F.col("box_sum") / F.col("box_count"))


def morphology(cells: DataFrame, value: str, radius: int, reducer: Callable[[Column], Column], alias: str) -> DataFrame:
    """Erosion with F.min, dilation with F.max; a truncated window equals edge padding."""
    return owned(reduce_square(into_tiles(cells, radius), {alias: value}, radius, reducer), radius)


def ground_surface(cells: DataFrame, value: str, radius: int = 32, alias: str = "ground") -> DataFrame:
    """Grayscale opening. Both passes share one halo of twice the radius."""
    halo = 2 * radius
    eroded = reduce_square(into_tiles(cells, halo), {alias: value}, radius, F.min)
    opened = reduce_square(eroded, {alias: alias}, radius, F.max, row_first=False)
    return owned(opened, halo)


def _difference(value: Column, window) -> Column:
    before, after = F.lag(value).over(window), F.lead(value).over(window)
    return (
        F.when(before.isNull() & after.isNull(), F.lit(0.0))
        .when(before.isNull(), after - value)
        .when(after.isNull(), value - before)
        .otherwise((after - before) / 2.0)
    )


def gradient(cells: DataFrame, columns: Mapping[str, str] | str, halo: int = 1) -> DataFrame:
    """Central differences inside, one-sided at the borders.

    `columns` maps a value column to the prefix of its `_dx`/`_dy` outputs.
    """
    if isinstance(columns, str):
        columns = {columns: ""}
    tiles = into_tiles(cells, halo)
    prefix = {c: f"{p}_" if p else "" for c, p in columns.items()}
    out = tiles.withColumns({f"{prefix[c]}dx": _difference(dbl(c), along_row()) for c in columns})
    out = out.withColumns({f"{prefix[c]}dy": _difference(dbl(c), along_col()) for c in columns})
    return owned(out, halo)


def guided_filter(
    cells: DataFrame,
    guide: str,
    source: str,
    radius: int = 8,
    epsilon: float = 1e-4,
    alias: str = "filtered",
) -> DataFrame:
    """Guided filter. The radius is cut to (shorter side - 1) // 2 per scene.

    Scenes large enough for the radius use plain frames; scenes narrower than
    the window are processed once per distinct smaller radius.
    """
    sized = attach(cells, extent(cells), keep_extent=True)
    shorter = F.least("n_rows", "n_cols")
    fits = shorter >= 2 * radius + 1
    large = _guided(sized.where(fits), guide, source, radius, epsilon, alias)
    small = _guided_variable(sized.where(~fits), guide, source, radius, epsilon, alias)
    return large.unionByName(small).drop("n_rows", "n_cols")


def _mean_columns(guide: str, source: str) -> dict[str, Column]:
    g, s = dbl(guide), dbl(source)
    return {"_g": g, "_s": s, "_gg": g * g, "_gs": g * s, "_c": F.lit(1.0)}


def _linear_model(df: DataFrame, epsilon: float) -> DataFrame:
    mean_g, mean_s = F.col("_g") / F.col("_c"), F.col("_s") / F.col("_c")
    variance = F.col("_gg") / F.col("_c") - mean_g * mean_g
    covariance = F.col("_gs") / F.col("_c") - mean_g * mean_s
    slope = covariance / (variance + epsilon)
    return df.withColumn("_a", slope).withColumn("_b", mean_s - F.col("_a") * mean_g)


def _blend(df: DataFrame, guide: str, alias: str) -> DataFrame:
    out = F.col("_a") / F.col("_c") * dbl(guide) + F.col("_b") / F.col("_c")
    return df.withColumn(alias, out).drop("_g", "_s", "_gg", "_gs", "_c", "_a", "_b")


def _guided(cells: DataFrame, guide: str, source: str, radius: int, epsilon: float, alias: str) -> DataFrame:
    halo = 2 * radius
    tiles = reduce_square(into_tiles(cells, halo), _mean_columns(guide, source), radius)
    tiles = _linear_model(tiles, epsilon)
    tiles = reduce_square(tiles, {"_a": "_a", "_b": "_b"}, radius, row_first=False)
    return owned(_blend(tiles, guide, alias), halo)


def _guided_variable(cells: DataFrame, guide: str, source: str, radius: int, epsilon: float, alias: str) -> DataFrame:
    """Same filter where the radius differs per scene: sums over listed neighbours."""
    halo = 2 * radius
    own = F.greatest(F.lit(1), F.expr("cast((least(n_rows, n_cols) - 1) div 2 as int)"))
    tiles = into_tiles(cells.withColumn("_r", F.least(own, F.lit(radius))), halo)

    def pass_over(df: DataFrame, names: list[str], axis: str, window) -> DataFrame:
        listed = F.collect_list(F.struct(F.col(axis).alias("at"), *names)).over(window(radius))

        def near(name: str) -> Column:
            return F.aggregate(
                F.filter("_near", lambda e: F.abs(e["at"] - F.col(axis)) <= F.col("_r")),
                F.lit(0.0),
                lambda acc, e: acc + e[name],
            )

        return df.withColumn("_near", listed).withColumns({n: near(n) for n in names}).drop("_near")

    names = ["_g", "_s", "_gg", "_gs", "_c"]
    tiles = tiles.withColumns(_mean_columns(guide, source))
    tiles = pass_over(pass_over(tiles, names, "col", along_row), names, "row", along_col)
    tiles = _linear_model(tiles, epsilon)
    tiles = pass_over(pass_over(tiles, ["_a", "_b"], "row", along_col), ["_a", "_b"], "col", along_row)
    return owned(_blend(tiles, guide, alias), halo).drop("_r")


def luma(r: str = "r", g: str = "g", b: str = "b") -> Column:
    """Rec. 601 luma."""
    return dbl(r) * 0.299 + dbl(g) * 0.587 + dbl(b) * 0.114


def refine_with_image(
    cells: DataFrame,
    value: str = "depth",
    valid: Column | None = None,
    radius: int = 32,
    epsilon: float = 1e-3,
    alias: str = "refined",
) -> DataFrame:
    """Normalise, fill invalid cells with the median, filter, restore units.

    `cells` carries r, g, b. Invalid cells and flat scenes keep their value.
    """
    ok = is_finite(value) if valid is None else is_finite(value) & valid
    stats = exact_percentiles(cells, value, {"_median": 0.5}, where=valid).select(
        "scene_id", "_median", F.col("low").alias("_low"), F.col("high").alias("_high"), "n_rows", "n_cols"
    )
    guides = cells.groupBy("scene_id").agg(F.max(luma()).alias("_gmax"))
    joined = attach(cells, stats.join(guides, "scene_id"), how="left")
    span = F.col("_high") - F.col("_low")
    filled = F.when(ok, dbl(value)).otherwise(F.col("_median"))
    ready = joined.withColumn("_ok", ok & (span > EPS32)).withColumns(
        {
            "_norm": F.coalesce(F.try_divide(filled - F.col("_low"), span), F.lit(0.0)),
            "_guide": F.when(F.col("_gmax") > 1.5, luma() / 255.0).otherwise(luma()),
        }
    )
    filtered = guided_filter(ready, "_guide", "_norm", radius, epsilon, "_refined")
    restored = F.col("_refined") * span + F.col("_low")
    return filtered.withColumn(
        alias, F.when(F.col("_ok"), restored).otherwise(dbl(value)).cast("float")
    ).drop("_median", "_low", "_high", "_gmax", "_ok", "_norm", "_guide", "_refined")


# kernel weights of the 3x3 smoother: corner, edge, centre
SPATIAL = {"corner": 1.0, "edge": 2.0, "centre": 4.0}
RANGE_FRACTION = 0.06
PASSES = {"none": 0, "subtle": 1, "balanced": 2, "strong": 4}


def bilateral(cells: DataFrame, value: str, passes: int = 1, alias: str = "smoothed", storage: str = "float") -> DataFrame:
    """Range-weighted 3x3 smoothing of interior cells, up to four passes."""
    if passes <= 0:
        return cells.withColumn(alias, F.col(value))
    start = F.when(is_finite(value), F.col(value)).otherwise(F.lit(0.0)).cast(storage)
    prepared = cells.withColumn(alias, start)
    stats = range_stats(prepared, alias).withColumn(
        "_den", 2.0 * F.pow((F.col("high") - F.col("low")) * RANGE_FRACTION, 2)
    )
    tiles = into_tiles(attach(prepared, stats.drop("low", "high", "n")), passes)
    for _ in range(passes):
        tiles = tiles.withColumn("_v", dbl(alias)).withColumns(
            {"_w": F.lag("_v").over(along_row()), "_e": F.lead("_v").over(along_row())}
        )
        near = {}
        for name, move in (("n", F.lag), ("s", F.lead)):
            for column in ("_v", "_w", "_e"):
                near[f"_{name}{column}"] = move(column).over(along_col())
        tiles = tiles.withColumns(near)
        v = F.col("_v")
        kernel = [("_n_w", "corner"), ("_n_v", "edge"), ("_n_e", "corner"), ("_w", "edge"), ("_v", "centre"),
                  ("_e", "edge"), ("_s_w", "corner"), ("_s_v", "edge"), ("_s_e", "corner")]
        weighted, total = F.lit(0.0), F.lit(0.0)
        for column, place in kernel:
            gap = F.col(column) - v
            weight = F.lit(SPATIAL[place]) * F.exp(-(gap * gap) / F.col("_den"))
            weighted, total = weighted + F.col(column) * weight, total + weight
        inside = F.col("_n_w").isNotNull() & F.col("_s_e").isNotNull() & F.col("_n_e").isNotNull() & F.col("_s_w").isNotNull()
        smooth = F.when(inside & (F.col("_den") > 0), F.try_divide(weighted, total)).otherwise(v)
        tiles = tiles.withColumn(alias, smooth.cast(storage)).drop("_v", "_w", "_e", *near)
    return owned(tiles.drop("_den"), passes)


def detrend(cells: DataFrame, value: str, alias: str = "detrended", storage: str = "float") -> DataFrame:
    """Subtract 0.7 of the separable linear trend; non-finite cells count as 0."""
    sized = attach(cells, extent(cells), keep_extent=True)
    z = F.when(is_finite(value), dbl(value)).otherwise(F.lit(0.0))
    x = F.coalesce(F.try_divide(F.col("col"), F.col("n_cols") - 1), F.lit(0.0)) - 0.5
    y = F.coalesce(F.try_divide(F.col("row"), F.col("n_rows") - 1), F.lit(0.0)) - 0.5
    framed = sized.withColumns({"_z": z, "_x": x, "_y": y})
    sums = framed.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(c + "s") for c in ("_x", "_y", "_z")],
        F.sum(F.col("_x") * F.col("_x")).alias("_xx"),
        F.sum(F.col("_y") * F.col("_y")).alias("_yy"),
        F.sum(F.col("_x") * F.col("_z")).alias("_xz"),
        F.sum(F.col("_y") * F.col("_z")).alias("_yz"),
        F.max("n_rows").alias("n_rows"),
        F.max("n_cols").alias("n_cols"),
    )

    def slope(axis: str) -> Column:
        den = F.when(F.col(f"_{axis}{axis}") == 0, 1.0).otherwise(F.col(f"_{axis}{axis}"))
        return (F.col(f"_{axis}z") - F.col(f"_{axis}s") * F.col("_zs") / F.col("_n")) / den

    slopes = sums.select("scene_id", slope("x").alias("_sx"), slope("y").alias("_sy"), "n_rows", "n_cols")
    out = attach(framed.drop("n_rows", "n_cols"), slopes)
    trend = F.col("_sx") * F.col("_x") + F.col("_sy") * F.col("_y")
    return out.withColumn(alias, (F.col("_z") - trend * 0.7).cast(storage)).drop("_z", "_x", "_y", "_sx", "_sy")


def edge_quality(
    cells: DataFrame, depth: str, gray: str, keys: tuple[str, ...] = ("scene_id",)
) -> DataFrame:
    """Agreement of depth edges with image edges, contrast and flat noise.

    `gray` is on 0..255. Depth is normalised to p1-p99 first; cells outside a
    usable range count as 0.
    """
    stats = exact_percentiles(cells, depth, {"_lo": 0.01, "_hi": 0.99}, keys)
    ready = attach(cells, stats.drop("n", "low", "high"), keys).withColumns(
        {"_d": percentile_unit(depth, "_lo", "_hi"), "_g": dbl(gray) / 255.0}
    )
    # the tile key is the scene; other keys are carried in its name
    other = [k for k in keys if k != "scene_id"]
    named = ready if not other else ready.withColumn("_scene", F.col("scene_id")).withColumn(
        "scene_id", F.concat_ws("\u0001", *keys)
    )
    grads = gradient(named.drop("_lo", "_hi"), {"_d": "d", "_g": "g"})
    if other:
        grads = grads.withColumn("scene_id", F.col("_scene"))
    grads = grads.withColumns(
        # held as 32-bit, so that equal slopes in different directions compare equal
        {"_dm": F.hypot("d_dx", "d_dy").cast("float"), "_gm": F.hypot("g_dx", "g_dy").cast("float")}
    )
    grads = materialise(grads.select(*keys, "row", "col", "_dm", "_gm"))
    moments = grads.groupBy(*keys).agg(
        F.stddev_pop("_dm").alias("_ds"), F.stddev_pop("_gm").alias("_gs"), F.covar_pop("_dm", "_gm").alias("_c")
    )
    cuts = materialise(
        exact_percentiles_of(grads, {"d": "_dm", "g": "_gm"}, {"mid": 0.5, "top": 0.95}, keys).withColumnsRenamed(
            {"d_mid": "_mid", "d_top": "_top", "g_mid": "_quiet"}
        )
    )
    spread = cuts.select(*keys, "_mid", "_top")
    image = cuts.select(*keys, "_quiet", "n_rows", "n_cols")
    flat = exact_percentiles(
        attach(grads, image, keys).where(F.col("_gm") <= F.col("_quiet")), "_dm", {"_flat": 0.5}, keys
    ).select(*keys, "_flat")
    flat_pair = (F.col("_ds") < 1e-9) | (F.col("_gs") < 1e-9)
    return moments.join(spread, list(keys)).join(flat, list(keys), "left").select(
        *keys,
        half_even(
            F.when(flat_pair, 0.0).otherwise(F.try_divide(F.col("_c"), F.col("_ds") * F.col("_gs"))), 4
        ).alias("edge_alignment"),
        F.when(F.col("_mid") > 1e-9, half_even(F.try_divide(F.col("_top"), F.col("_mid")), 3))
        .otherwise(F.lit(float("inf")))
        .alias("edge_contrast"),
        half_even(F.coalesce("_flat", F.lit(0.0)), 6).alias("flat_noise"),
    )


def percentile_unit(value: str, low: str, high: str) -> Column:
    """P5: clip to [0, 1] between two percentiles; a constant scene gives 0."""
    span = F.col(high) - F.col(low)
    return F.when(
        (span > 0) & is_finite(value), clamp(F.try_divide(dbl(value) - F.col(low), span), 0.0, 1.0)
    ).otherwise(F.lit(0.0))
