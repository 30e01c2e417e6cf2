"""One analysis over many scenes: calibrate, score, level, outline and mesh."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from relief.functions import text
from relief.functions.core import dbl, half_even, is_finite
from relief.functions.pixel import decoded_size_problem, preview_unit
from relief.functions.projection import pixel_size, pixel_size_problem, scene_centre
from relief.functions.solar import solar_position
from relief.operators import align, calibrate, diffuse, evaluate, focal, mesh, outlines, regions, sample, shadow, tiling, vector
from relief.operators.grid import attach, extent
from relief.operators.stats import exact_percentiles, range_stats
from relief.session import materialise
from relief import sinks, stores
from relief.sources import gcps as gcp_source, osm

CELL = ["scene_id", "row", "col"]

# Notice texts.
BENCHMARK_LABEL = (
    "Benchmark-only affine calibration against supplied ground truth; not available for unseen terrain."
)
DEM_LABEL = (
    "Deployment-style affine calibration against the supplied reference DEM. "
    "This establishes a scene-level scale and offset; it is not an accuracy benchmark."
)
GCP_LABEL = (
    "Deployment-style affine calibration against supplied pixel-coordinate ground "
    "control points. This establishes a scene-level scale and offset; it is not an accuracy benchmark."
)
HOLDOUT_LABEL = (
    "Evaluation against supplied ground truth using calibration fixed from a separate "
    "deployment reference; ground truth was not used to refit scale or offset."
)
NO_TRUTH_NOTICE = (
    "No ground_truth_dsm was supplied, so independent Pearson, MAE, and RMSE evaluation "
    "metrics are null. Calibration-reference fit is not reported as accuracy."
)
LEAKAGE_NOTICE = (
    "The full evaluation DSM was used to choose orientation and fit scale/offset; these "
    "same-scene metrics contain calibration leakage and are benchmark-only."
)

SHADOW_NOTE = (
    "Heights are relative to local ground, not a vertical datum. The fit "
    "assumes shadows fall on level ground and are not clipped by neighbouring structures."
)
EXPORTED_NOTICE = (
    "Calibrated predicted DSM GeoTIFF preserves the source CRS, transform, dimensions, valid-data mask, "
    "and source tags. Horizontal CRS metadata does not establish a vertical datum or elevation unit."
)
NOT_EXPORTED_NOTICE = (
    "A calibrated DSM GeoTIFF was not exported because the source image did not provide a valid GeoTIFF CRS and transform."
)
BOUNDED_NOTICE = "Model inference was bounded to %dx%d and resampled to the source grid %dx%d."
REFINED_NOTICE = (
    "The 3-D surface was edge-aligned to the source image with a guided filter (radius %d). This is a display-only "
    "refinement; exported depth, the calibrated DSM, and all metrics use the unrefined prediction."
)
ROOFS_NOTICE = (
    "%d building regions were segmented and their roofs fitted to planes for the 3-D surface. Display-only; "
    "exported products are unaffected."
)
LEVELLED_NOTICE = (
    "The 3-D surface was levelled with %d anisotropic-diffusion steps to flatten roof planes. Display-only; "
    "exported products are unaffected."
)
MAPPED_NOTICE = (
    "%d blueprint-accurate vector building footprints were loaded from OpenStreetMap (OSM) with ML-derived heights "
    "and vertical wall geometry."
)
SEPARATED_NOTICE = (
    "%d accepted structure regions were separated into display-only roof and wall geometry; the raw prediction and "
    "exported products are unchanged."
)
ACQUISITION_TIME = "acquisition_time must be ISO 8601, for example 2021-04-15T15:30:00Z"

MODES = {
    "reference_dem": "reference_dem_calibrated_dsm",
    "gcps": "gcp_calibrated_dsm",
    "scene_shadows": "shadow_calibrated_dsm",
    "ground_truth_dsm": "benchmark_calibrated_dsm",
}


@dataclass
class Inputs:
    """Tables of one batch of scenes; everything but scenes and pixels is optional.

    scenes: scene_id, filename, width, height, crs, transform, tags and, when
    given, acquisition_time, gcp_sampling and quality_mode texts.
    pixels: scene_id, row, col, r, g, b, valid. depth: scene_id, row, col, depth.
    truth, dem: (cells, headers) pairs. gcps: points with scene_id, idx, x, y,
    elevation. nodes, ways, way_scenes: map buildings. map_store: a folder that
    keeps the rings of each scene's area; areas found there are not built again.
    device: where the estimator runs, by default what it says itself.
    """

    scenes: DataFrame
    pixels: DataFrame
    depth: DataFrame | None = None
    estimator: tiling.Estimator | None = None
    model: str = "mock-or-custom-estimator"
    truth: tuple[DataFrame, DataFrame] | None = None
    dem: tuple[DataFrame, DataFrame] | None = None
    gcps: DataFrame | None = None
    nodes: DataFrame | None = None
    ways: DataFrame | None = None
    way_scenes: DataFrame | None = None
    map_store: str | None = None
    device: str | None = None


@dataclass
class Settings:
    """Display settings and limits, with the reference defaults."""

    refine_radius: int = 32
    refine_epsilon: float = 1e-3
    flatten_roofs: bool = True
    iterations: int = 80
    kappa: float = 0.12
    ground_radius: int = regions.GROUND_RADIUS
    min_area: int = regions.MIN_AREA
    max_side: int = 1024
    mesh_edge: int = mesh.MESH_LONG_EDGE
    max_pixels: int | None = None
    gcp_sampling: str = "bilinear"
    quality_mode: str = "fast"
    # size of quantile sketches for the bounds of previews; exact percentiles if none
    preview_sketch: int | None = None


def _with_defaults(scenes: DataFrame, settings: Settings) -> DataFrame:
    # a request names its job; a scene analysed without one is its own job
    fixed = {"job_id": None, "acquisition_time": None, "gcp_sampling": settings.gcp_sampling, "quality_mode": settings.quality_mode}
    out = scenes
    for name, value in fixed.items():
        given = F.col(name) if name in scenes.columns else F.lit(None).cast("string")
        out = out.withColumn(name, F.coalesce(given, F.lit(value).cast("string")))
    return out.withColumn("job_id", F.coalesce("job_id", F.sha2("scene_id", 256).substr(1, 32)))


def validate(inputs: Inputs, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Cheap checks on headers before any pixel is read: (accepted, rejects)."""
    scenes = _with_defaults(inputs.scenes, settings)
    reason = F.coalesce(
        text.settings_problem("gcp_sampling", "quality_mode"),
        decoded_size_problem(F.col("width"), F.col("height"), settings.max_pixels),
    )
    if inputs.dem is not None and inputs.gcps is not None:
        both = inputs.dem[1].select("scene_id").intersect(inputs.gcps.select("scene_id")).withColumn("_both", F.lit(True))
        scenes = scenes.join(both, "scene_id", "left")
        reason = F.coalesce(
            F.when(F.col("_both"), F.lit("Supply only one deployment calibration reference: reference_dem or gcps")), reason
        )
    if inputs.gcps is not None:
        bad = gcp_source.check_points(inputs.gcps).where("reason IS NOT NULL").select("scene_id", F.col("reason").alias("_gcp"))
        scenes = scenes.join(bad, "scene_id", "left")
        reason = F.coalesce(reason, F.col("_gcp"))
    judged = materialise(scenes.withColumn("reject_reason", reason))
    return (
        judged.where("reject_reason IS NULL").drop("reject_reason", "_both", "_gcp"),
        judged.where("reject_reason IS NOT NULL").select("scene_id", F.col("reject_reason").alias("reason")),
    )


def _only(df: DataFrame, scenes: DataFrame) -> DataFrame:
    return df.join(scenes.select("scene_id"), "scene_id", "left_semi")


def _shadow_calibrations(cells: DataFrame, scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A6 over georeferenced scenes: (calibrations, reports with sun and fraction)."""
    lon, lat = scene_centre(F.col("crs"), F.col("transform"), F.col("width"), F.col("height"))
    size = pixel_size(F.col("transform"))
    when = F.coalesce(text.iso_time("acquisition_time"), text.acquisition_time("tags"))
    located = scenes.select(
        "scene_id", "crs", size.alias("pixel_size"), lon.alias("_lon"), lat.alias("_lat"), when.alias("_when"),
        # only shadows need the time, so only they are refused where it cannot be read
        (F.col("acquisition_time").isNotNull() & text.iso_time("acquisition_time").isNull()).alias("_unread"),
    ).withColumn("_sun", solar_position(F.col("_when"), F.col("_lat"), F.col("_lon")))
    refused = (
        F.when(pixel_size_problem(F.col("pixel_size"), F.col("crs")).isNotNull(), pixel_size_problem(F.col("pixel_size"), F.col("crs")))
        .when(F.col("_lon").isNull() | F.col("_lat").isNull(), "Could not resolve scene coordinates from the CRS and transform")
        .when(F.col("_unread"), ACQUISITION_TIME)
        .when(
            F.col("_when").isNull(),
            "No acquisition timestamp in the raster tags. Supply one to enable shadow-based metric calibration",
        )
    )
    placed = materialise(
        located.select(
            "scene_id", "pixel_size", F.col("_sun.elevation").alias("elevation"), F.col("_sun.azimuth").alias("azimuth"),
            F.col("_sun.usable").alias("sun_usable"), refused.alias("early"), F.col("_when").alias("taken"),
        )
    )
    live = placed.where("early IS NULL AND sun_usable")
    mask = materialise(shadow.shadow_mask(_only(cells, live)))
    runs = shadow.shadow_runs(mask, live)
    report = shadow.height_report(mask, runs, placed.select("scene_id", "elevation", "pixel_size"))
    report = report.join(placed.select("scene_id", "early", F.col("elevation").alias("sun_elevation"), F.col("azimuth").alias("sun_azimuth"), "taken"), "scene_id")
    report = materialise(
        report.withColumn("reason", F.coalesce("early", "reason")).withColumn("usable", F.col("early").isNull() & F.col("usable")).drop("early")
    )
    percentiles = exact_percentiles(_only(cells, live), "depth", {"p05": 0.05, "p99": 0.99}, where=F.col("valid"))
    return calibrate.shadow_scale(percentiles, report), report


_CALIBRATION = ["scene_id", "source", "method", "scale", "shift", "orientation", "orientation_sign", "reference_samples", "benchmark_only", "status", "reason"]


_SUN_NAMES = ("solar_elevation_degrees", "solar_azimuth_degrees", "acquisition_time")
_SUN = "struct<solar_elevation_degrees:double,solar_azimuth_degrees:double,acquisition_time:string>"


def _sun_of(report: DataFrame) -> Column:
    """Where the sun stood, and the time in UTC, for the record of a shadow calibration."""
    time = F.date_format(F.to_utc_timestamp("taken", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    values = (half_even("sun_elevation", 3), half_even("sun_azimuth", 3), F.concat(time, F.lit("+00:00")))
    return F.struct(*[v.alias(n) for v, n in zip(values, _SUN_NAMES, strict=True)])


def _uniform(fits: DataFrame) -> DataFrame:
    out = fits if "reason" in fits.columns else fits.withColumn("reason", F.when(F.col("status") != "ok", F.col("status")))
    return out.select(*_CALIBRATION)


def _notices(c: dict[str, Column]) -> Column:
    """Ordered notes of a run; absent ones are dropped."""
    source, status = F.col("source"), F.col("status")
    good = status == "ok"
    located = F.col("crs").isNotNull() & F.col("transform").isNotNull()
    deployed = good & source.isin("reference_dem", "gcps", "scene_shadows")
    return F.array_compact(
        F.array(
            F.concat(F.lit("Live output from "), F.col("model"), F.lit(" is relative monocular depth, not metric elevation.")),
            c["truth_notice"],
            c["dem_notice"],
            F.when(
                (F.col("quality_mode") == "quality") & F.col("tiled"),
                F.format_string(
                    "Quality inference used one global pass plus %d overlapping local tiles with relative-scale alignment and feathered blending.",
                    F.col("tile_count"),
                ),
            ).when(
                F.col("quality_mode") == "quality",
                "Quality inference averaged the global prediction with a horizontally flipped consistency pass after relative-scale alignment.",
            ),
            F.when(
                (F.col("bounded_width") != F.col("width")) | (F.col("bounded_height") != F.col("height")),
                F.format_string(BOUNDED_NOTICE, "bounded_width", "bounded_height", "width", "height"),
            ),
            F.when(good & (source == "reference_dem"), DEM_LABEL),
            F.when(
                good & (source == "reference_dem"),
                "The reference DEM supplies only a global affine scale and offset. Its resolution, vertical datum, terrain/surface "
                "definition, and acquisition date may differ from the image and predicted surface.",
            ),
            F.when(good & (source == "gcps"), GCP_LABEL),
            F.when(
                good & (source == "gcps"),
                F.concat(
                    F.lit("GCP x/col coordinates increase right and y/row coordinates increase down from zero; model depth was sampled with "),
                    text.setting("gcp_sampling"),
                    F.lit(" interpolation."),
                ),
            ),
            F.when(
                good & (source == "scene_shadows"),
                F.format_string(
                    "Metric heights were derived from shadow length and solar geometry, using %d shadow runs. No external elevation reference was used.",
                    F.col("reference_samples"),
                ),
            ),
            F.when(good & (source == "scene_shadows"), SHADOW_NOTE),
            F.when(
                F.col("shadow_reason").isNotNull(),
                F.concat(F.lit("Shadow-based metric calibration was not applied: "), F.col("shadow_reason")),
            ),
            F.when(
                F.col("datum_offset").isNotNull(),
                F.format_string(
                    "A constant vertical offset of %.2f m aligned the shadow-calibrated surface to the evaluation DSM datum; reported "
                    "metrics measure relief, not absolute elevation.",
                    F.col("datum_offset"),
                ),
            ),
            F.when(deployed & F.col("has_truth"), HOLDOUT_LABEL),
            F.when(deployed & ~F.col("has_truth"), NO_TRUTH_NOTICE),
            F.when(good & (source == "ground_truth_dsm"), BENCHMARK_LABEL),
            F.when(good & (source == "ground_truth_dsm"), LEAKAGE_NOTICE),
            F.when(good & located, EXPORTED_NOTICE).when(good, NOT_EXPORTED_NOTICE),
        )
    )


def calibrate_scenes(inputs: Inputs, settings: Settings | None = None) -> dict[str, DataFrame]:
    """Measured part: runs, calibrations, metrics and calibrated heights.

    A scene uses its reference grid, else its control points, else its shadows
    (when it has CRS and transform), else a refit on the truth. Once calibrated
    it is scored without refitting. A shadow-calibrated surface is compared
    after a constant datum shift, which is recorded and never exported.
    """
    settings = settings or Settings()
    scenes, rejects = validate(inputs, settings)
    pixels = _only(inputs.pixels, scenes)
    if inputs.depth is not None:
        depth = _only(inputs.depth, scenes)
        records = scenes.select(
            "scene_id", text.setting("quality_mode").alias("quality_mode"), F.lit(1).alias("passes"),
            F.lit(False).alias("tiled"), F.lit(0).alias("tile_count"), F.col("width").alias("bounded_width"),
            F.col("height").alias("bounded_height"), F.lit(None).cast("string").alias("problem"),
        )
    elif inputs.estimator is not None:
        depth, records = None, None
        for quality in text.QUALITY:
            chosen = scenes.where(text.setting("quality_mode") == quality)
            if chosen.isEmpty():
                continue
            d, r = tiling.predict(_only(pixels, chosen), inputs.estimator, quality, settings.max_side)
            depth = d if depth is None else depth.unionByName(d)
            records = r if records is None else records.unionByName(r)
        if depth is None:
            raise ValueError("no scene passed validation")
    else:
        raise ValueError("supply depth or an estimator")
    records = materialise(records)
    rejects = rejects.unionByName(records.where("problem IS NOT NULL").select("scene_id", F.col("problem").alias("reason")))
    cells = materialise(pixels.join(depth, CELL))
    sizes = materialise(extent(cells))
    fits, notes = [], {}
    remaining = scenes

    truth = dem = None
    if inputs.truth is not None:
        truth, modes = align.align_elevation(_only(inputs.truth[0], scenes), inputs.truth[1], scenes, "Evaluation ground-truth DSM")
        truth = materialise(truth)
        notes["truth_notice"] = modes.select("scene_id", F.col("notice").alias("truth_notice"))
    if inputs.dem is not None:
        dem, modes = align.align_elevation(_only(inputs.dem[0], scenes), inputs.dem[1], scenes, "Reference DEM")
        notes["dem_notice"] = modes.select("scene_id", F.col("notice").alias("dem_notice"))
        pairs = cells.select(*CELL, "depth", F.col("valid").alias("_ok")).join(dem, CELL)
        good = F.col("_ok") & F.col("valid") & is_finite("depth")
        fits.append(_uniform(calibrate.fit_affine(pairs.select("scene_id", F.when(good, F.col("depth")).alias("depth"), "value"), "depth", "value", source="reference_dem")))
        remaining = remaining.join(inputs.dem[1].select("scene_id"), "scene_id", "left_anti")
    if inputs.gcps is not None:
        for method in text.SAMPLING:
            chosen = remaining.where(text.setting("gcp_sampling") == method)
            taken = sample.sample_points(_only(inputs.gcps, chosen), cells, "depth", "valid", method)
            # one point off the grid or on an unusable pixel refuses the scene
            bad = taken.groupBy("scene_id").agg(F.min(F.when(F.col("status") != "ok", F.col("idx"))).alias("_bad"))
            fit = _uniform(calibrate.fit_affine(taken, "sampled", "elevation", source="gcps")).join(bad, "scene_id")
            broken = F.col("_bad").isNotNull()
            fits.append(
                fit.withColumn("status", F.when(broken, "refused").otherwise(F.col("status")))
                .withColumn("reason", F.when(broken, F.format_string("GCP point %d samples an invalid or outside model-depth pixel", F.col("_bad"))).otherwise(F.col("reason")))
                .drop("_bad")
            )
        remaining = remaining.join(inputs.gcps.select("scene_id").distinct(), "scene_id", "left_anti")
    remaining = materialise(remaining)
    located = remaining.where("crs IS NOT NULL AND transform IS NOT NULL")
    shadow_reasons = shadow_shares = None
    if not located.isEmpty():
        shadow_fits, report = _shadow_calibrations(_only(cells, located), located)
        shadow_fits = materialise(_uniform(shadow_fits))
        fits.append(shadow_fits.where("status = 'ok'"))
        shadow_shares = report.select("scene_id", "shadow_fraction", _sun_of(report).alias("_sun"))
        shadow_reasons = shadow_fits.where("status <> 'ok'").select("scene_id", F.col("reason").alias("shadow_reason"))
        remaining = remaining.join(shadow_fits.where("status = 'ok'").select("scene_id"), "scene_id", "left_anti")
    if truth is not None:
        benchmark = _only(cells, remaining).select(*CELL, "depth", F.col("valid").alias("_ok")).join(truth, CELL)
        good = F.col("_ok") & F.col("valid") & is_finite("depth")
        samples = benchmark.select("scene_id", F.when(good, F.col("depth")).alias("depth"), "value")
        fits.append(_uniform(calibrate.fit_affine(samples, "depth", "value", source="ground_truth_dsm", benchmark_only=True)))
    if fits:
        calibrations = fits[0]
        for fit in fits[1:]:
            calibrations = calibrations.unionByName(fit)
        calibrations = materialise(calibrations)
    else:
        calibrations = scenes.limit(0).selectExpr(
            "scene_id", "'' source", "'' method", "0d scale", "0d shift", "'' orientation", "0d orientation_sign",
            "0L reference_samples", "false benchmark_only", "'' status", "'' reason",
        )
    failed = calibrations.where("status <> 'ok'").select("scene_id", F.concat(F.lit("calibration failed: "), F.col("reason")).alias("reason"))
    rejects = rejects.unionByName(failed)

    heights = materialise(calibrate.apply_affine(cells, calibrations, sizes))
    metrics, offsets = None, None
    if truth is not None:
        scored = heights.drop("r", "g", "b").withColumnRenamed("valid", "_source").join(truth, CELL)
        scored = scored.withColumn("valid", F.col("valid") & F.col("_source"))
        by_shadow = calibrations.where("source = 'scene_shadows' AND status = 'ok'")
        offsets = materialise(evaluate.datum_offset(_only(scored, by_shadow)).drop("n"))
        shifts = offsets.join(sizes, "scene_id")
        shifted = attach(scored, shifts, how="left").withColumn(
            "height", (dbl("height") + F.coalesce("datum_offset", F.lit(0.0))).cast("float")
        )
        graded = materialise(calibrations.where("status = 'ok'").select("scene_id", "benchmark_only", F.col("source").alias("calibration_source")))
        metrics = evaluate.score(_only(shifted, graded)).join(graded, "scene_id").withColumns(
            {
                "calibration_refit": F.col("benchmark_only"),
                "evaluation_scope": F.when(F.col("benchmark_only"), "same_scene_benchmark_refit").otherwise(F.col("evaluation_scope")),
            }
        )
        metrics = materialise(metrics.drop("benchmark_only"))

    points = None
    if inputs.gcps is not None:
        points = inputs.gcps.groupBy("scene_id").agg(F.count(F.lit(1)).alias("point_count"))
    made = records.where("problem IS NULL").drop("problem")
    runs = scenes.drop("quality_mode").join(made, "scene_id")
    runs = runs.join(failed.select("scene_id"), "scene_id", "left_anti").join(calibrations.where("status = 'ok'"), "scene_id", "left")
    for name in ("truth_notice", "dem_notice"):
        runs = runs.join(notes[name], "scene_id", "left") if name in notes else runs.withColumn(name, F.lit(None).cast("string"))
    for table, column, kind in ((shadow_reasons, "shadow_reason", "string"), (offsets, "datum_offset", "double"), (shadow_shares, "shadow_fraction", "double"), (points, "point_count", "bigint")):
        runs = runs.join(table, "scene_id", "left") if table is not None else runs.withColumn(column, F.lit(None).cast(kind))
    if metrics is not None:
        runs = runs.join(metrics.select("scene_id", F.struct(*[c for c in metrics.columns if c != "scene_id"]).alias("metrics")), "scene_id", "left")
    else:
        runs = runs.withColumn("metrics", F.lit(None).cast("struct<evaluation_scope:string,valid_pixels:bigint>"))
    counts = sizes.select("scene_id", (F.col("n_rows").cast("double") * F.col("n_cols")).alias("_cells"))
    runs = runs.join(counts, "scene_id").withColumn("model", F.lit(inputs.model))
    runs = runs.withColumn("has_truth", F.col("metrics").isNotNull())
    mode = F.lit("relative_depth")
    for source, name in MODES.items():
        mode = F.when(F.col("source") == source, name).otherwise(mode)
    held = F.col("metrics.valid_pixels")
    reference = F.when(
        F.col("source").isin("reference_dem", "gcps", "scene_shadows"),
        F.struct(
            F.col("source").alias("type"),
            F.when(F.col("source") == "gcps", F.col("point_count")).otherwise(F.col("reference_samples")).alias("point_count"),
            F.col("reference_samples").alias("calibration_points"),
            F.coalesce(held, F.lit(0)).alias("holdout_points"),
            F.when(F.col("source") == "scene_shadows", F.col("shadow_fraction"))
            .otherwise(F.least(F.lit(1.0), F.col("reference_samples") / F.col("_cells")))
            .alias("coverage"),
        ),
    )
    sun = F.when(F.col("source") == "scene_shadows", F.col("_sun")) if shadow_shares is not None else F.lit(None).cast(_SUN)
    device = inputs.device or getattr(inputs.estimator, "device", None) or "unknown"
    runs = runs.withColumn("_sun", sun).select(
        "scene_id",
        "job_id",
        mode.alias("mode"),
        text.output_basis(mode, F.col("source").isNotNull(), F.col("has_truth")).alias("output_basis"),
        "model",
        F.lit(str(device)).alias("device"),
        F.struct("quality_mode", "passes", "tiled", "tile_count", "bounded_width", "bounded_height").alias("inference"),
        F.when(F.col("source").isNotNull(), F.struct(*_CALIBRATION[1:], *[F.col(f"_sun.{n}") for n in _SUN_NAMES])).alias("calibration"),
        "metrics",
        reference.alias("reference"),
        "datum_offset",
        _notices({k: F.col(k) for k in ("truth_notice", "dem_notice")}).alias("notices"),
    )
    return {
        "runs": runs,
        "rejects": rejects,
        "calibrations": calibrations,
        "metrics": metrics,
        "heights": heights,
        "scenes": scenes,
    }


def _map_rings(inputs: Inputs, scenes: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Rings of map buildings, with the pairs that name their scenes.

    With a store, areas it lacks are built and stored first, and all rings are
    read from there with their scene; without map tables only stored areas count.
    """
    given = inputs.nodes is not None and inputs.ways is not None
    if inputs.map_store is None:
        if not given:
            return None, None
        near = inputs.way_scenes
        if near is None:
            near = osm.ways_in_scenes(osm.way_bounds(inputs.ways, inputs.nodes), osm.scene_boxes(scenes))
        return vector.way_rings(inputs.ways, inputs.nodes), near
    spark, path = scenes.sparkSession, inputs.map_store
    boxes = materialise(osm.with_cache_key(osm.scene_boxes(scenes)))
    known = stores.stored(spark, path)
    if given:
        missing = boxes
        if known:
            missing = materialise(osm.cached_and_missing(boxes, stores.stored_keys(spark, path, "cache_key"))[1])
        if not missing.isEmpty():
            pairs = inputs.way_scenes
            if pairs is None:
                pairs = osm.ways_in_scenes(osm.way_bounds(inputs.ways, inputs.nodes), missing)
            # areas of several scenes are stored once
            pairs = materialise(
                pairs.join(missing.select("scene_id", "cache_key"), "scene_id").select("cache_key", F.col("way_id").alias("osm_id")).distinct()
            )
            wanted = inputs.ways.join(pairs.select(F.col("osm_id").alias("id")), "id", "left_semi")
            osm.store_ways(vector.way_rings(wanted, inputs.nodes).join(pairs, "osm_id"), path, missing)
    elif not known:
        return None, None
    kept = stores.stored_rows(spark, path, "cache_key", boxes)
    return kept.join(boxes.select("scene_id", "cache_key"), "cache_key").drop("cache_key"), None


def display_scenes(measured: dict[str, DataFrame], inputs: Inputs, settings: Settings | None = None) -> dict[str, DataFrame]:
    """Display part: refined, levelled surface, footprints and mesh tables.

    Nothing here feeds back into depth, calibrated heights or metrics.
    """
    settings = settings or Settings()
    heights, scenes = measured["heights"], measured["scenes"]
    valid = F.col("valid")
    stats = exact_percentiles(heights, "depth", {"_lo": 0.005, "_hi": 0.995}, where=valid).drop("n")
    unit = preview_unit("depth", valid & is_finite("depth"), *[F.col(c) for c in ("_lo", "_hi", "low", "high")])
    base = attach(heights, stats, how="left").withColumn("surface", F.coalesce(dbl("height"), unit).cast("float"))
    surface = materialise(base.select(*CELL, "r", "g", "b", "valid", "surface"))
    refined = focal.refine_with_image(surface, "surface", valid, settings.refine_radius, settings.refine_epsilon, "refined")
    refined = materialise(refined.drop("surface"))
    roofed, labels = regions.level_roofs(refined, "refined", valid, settings.ground_radius, min_area=settings.min_area)
    column = "roofed" if settings.flatten_roofs else "refined"
    levelled = materialise(
        diffuse.diffuse(roofed, column, settings.iterations, settings.kappa, valid, "display").select(
            *CELL, "r", "g", "b", "valid", "ground", F.col("display").alias("display")
        )
    )
    domain = materialise(range_stats(levelled, "display", where=valid))
    whole = materialise(range_stats(levelled, "display"))

    inside = labels.join(levelled.withColumnRenamed("display", "roof"), CELL)
    judged = materialise(regions.judge_regions(inside, whole, True, settings.min_area))
    accepted = judged.where("accepted")
    rings = outlines.region_outlines(labels.join(materialise(accepted.select("scene_id", "label")), ["scene_id", "label"], "left_semi"))
    segmented = regions.footprints(judged, rings, extent(levelled))
    usable = scenes.where("crs IS NOT NULL AND transform IS NOT NULL")
    rings, near = _map_rings(inputs, usable)
    if rings is not None:
        mapped = vector.osm_footprints(rings, usable, near)
        mapped = vector.raise_footprints(materialise(mapped), levelled, "display", "ground", scenes)
        footprints = vector.choose_footprints(mapped, segmented)
    else:
        footprints = segmented
    footprints = materialise(footprints)
    kept = footprints.where("source = 'segmentation'").select("scene_id", "label")
    bare = materialise(regions.lower_to_ground(levelled, labels, accepted.join(kept, ["scene_id", "label"], "left_semi"), "display"))
    grid, headers = mesh.mesh_grid(bare, "display", valid, settings.mesh_edge)
    # one height domain from before regions were lowered
    shared = domain.select("scene_id", F.coalesce("low", F.lit(0.0)).alias("minimum"), F.coalesce("high", F.lit(1.0)).alias("maximum"))
    headers = headers.drop("minimum", "maximum").join(shared, "scene_id")
    codes, code_headers = mesh.height_grid16(bare, "display", valid)
    return {
        "display": levelled,
        "regions": labels,
        "footprints": footprints,
        "bare": bare,
        "mesh": grid,
        "mesh_headers": headers,
        "height16": codes,
        "height16_headers": code_headers,
        "normals": mesh.normal_map(bare.select(*CELL, "valid", "display"), "display", valid),
    }


def analyze_scenes(inputs: Inputs, settings: Settings | None = None) -> dict[str, DataFrame]:
    """Both parts and the tables to export; see calibrate_scenes and display_scenes.

    `notices` has one row per scene with every note of its run, those on the
    display last.
    """
    settings = settings or Settings()
    measured = calibrate_scenes(inputs, settings)
    shown = display_scenes(measured, inputs, settings)
    return {
        **measured,
        **shown,
        **_exports(measured, shown, inputs, settings.preview_sketch),
        "notices": _all_notices(measured["runs"], shown, settings),
    }


def _all_notices(runs: DataFrame, shown: dict[str, DataFrame], settings: Settings) -> DataFrame:
    """The notes of calibration followed by those of the display."""
    labelled = shown["regions"].groupBy("scene_id").agg(F.countDistinct("label").alias("_labelled"))
    kinds = shown["footprints"].groupBy("scene_id").agg(
        F.count_if(F.col("source") == "osm").alias("_mapped"), F.count_if(F.col("source") == "segmentation").alias("_cut")
    )
    both = runs.select("scene_id", "notices").join(labelled, "scene_id", "left").join(kinds, "scene_id", "left")

    def counted(column: str, notice: str) -> Column:
        return F.when(F.col(column) > 0, F.format_string(notice, F.col(column)))

    display = F.array(
        F.lit(REFINED_NOTICE % settings.refine_radius),
        counted("_labelled", ROOFS_NOTICE) if settings.flatten_roofs else F.lit(None).cast("string"),
        F.lit(LEVELLED_NOTICE % settings.iterations if settings.iterations > 0 else None).cast("string"),
        counted("_mapped", MAPPED_NOTICE),
        counted("_cut", SEPARATED_NOTICE),
    )
    return both.select("scene_id", F.concat("notices", F.array_compact(display)).alias("notices"))


def _exports(measured: dict[str, DataFrame], shown: dict[str, DataFrame], inputs: Inputs, sketch: int | None) -> dict[str, DataFrame]:
    """K1, K3, K4 and K5: raw depth, calibrated grid, previews, masks."""
    heights = measured["heights"]
    grid, headers = sinks.calibrated_export(heights, measured["scenes"], measured["calibrations"])
    _, masks = sinks.height16_tables(shown["height16"], shown["height16_headers"])
    out = {
        "depth_export": sinks.depth_export(heights),
        "calibrated": grid,
        "calibrated_headers": headers,
        "height16_masks": masks,
        "depth_preview": sinks.preview_table(heights, "depth", sketch=sketch),
        "height_preview": sinks.preview_table(heights.where("height IS NOT NULL"), "height", sketch=sketch),
    }
    for name, given in (("truth", inputs.truth), ("dem", inputs.dem)):
        if given is not None:
            out[f"{name}_preview"] = sinks.preview_table(given[0], "value", sketch=sketch)
    return out
