from __future__ import annotations

import datetime as dt
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grids import ramp
from relief.plans import demo
from relief.plans.analyze import Inputs, Settings, analyze_scenes, calibrate_scenes, display_scenes
from relief.streaming import intake

SCENES = "scene_id string, filename string, width int, height int, crs string, transform array<double>, tags map<string,string>, gcp_sampling string, quality_mode string"
TRANSFORM = [2.0, 0.0, 500000.0, 0.0, -2.0, 2000000.0]
W, H = 24, 20


def analytic(image):
    """Depth falls with the ramp that the red band encodes."""
    return -image[..., 0].astype(np.float32) / np.float32(100)


def _union(parts):
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@pytest.fixture(scope="module")
def batch(spark, grid):
    base = ramp(W, H)
    names = ["dem", "gcp", "near", "truth", "none", "both", "bad", "few", "lost", "georef"]
    rows = [
        (n, f"{n}.png", W, H, "EPSG:3857" if n == "georef" else None, TRANSFORM if n == "georef" else None, {},
         "cubic" if n == "bad" else ("nearest" if n == "near" else "bilinear"), "quality" if n == "dem" else "fast")
        for n in names
    ]
    scenes = spark.createDataFrame(rows, SCENES)
    ok = np.ones((H, W), dtype=bool)
    ok[0, 0] = False
    red = np.round(base * 80).astype(np.int16)
    pixels = _union([grid(n, r=red, g=red, b=red, valid=ok) for n in names])
    depth_like = red / 100.0
    plain = "scene_id string, width int, height int, crs string, transform array<double>"
    header = lambda ids: spark.createDataFrame([(n, W, H, None, None) for n in ids], plain)
    every = np.ones((H, W), dtype=bool)
    truth = _union([grid(n, value=(40 + 6 * depth_like + 1.5 * depth_like**2).astype(np.float32), valid=every) for n in ("dem", "truth", "georef")])
    dems = _union([grid(n, value=(40 + 6 * depth_like).astype(np.float32), valid=every) for n in ("dem", "both")])
    spots = [(2, 1), (W - 3, 4), (7, H - 2), (W - 6, H - 5), (11, 9), (4, 12)]
    points = [
        (n, i + 1, float(x), float(y), float(80 + 3 * depth_like[y, x]))
        for n in ("gcp", "near", "both") for i, (x, y) in enumerate(spots)
    ] + [("few", 1, 1.0, 1.0, 2.0)] + [("lost", i, float(x), float(y), 1.0 * i) for i, (x, y) in enumerate([(1, 0), (3, 3), (W + 5, 2)], 1)]
    gcps = spark.createDataFrame(points, "scene_id string, idx int, x double, y double, elevation double")
    inputs = Inputs(
        scenes, pixels, estimator=analytic, model="analytic", truth=(truth, header(["dem", "truth", "georef"])),
        dem=(dems, header(["dem", "both"])), gcps=gcps,
    )
    return calibrate_scenes(inputs)


def test_calibration_precedence_and_modes(batch):
    runs = {r["scene_id"]: r for r in batch["runs"].collect()}
    assert {n: r["mode"] for n, r in runs.items()} == {
        "dem": "reference_dem_calibrated_dsm",
        "gcp": "gcp_calibrated_dsm",
        "near": "gcp_calibrated_dsm",
        "truth": "benchmark_calibrated_dsm",
        "georef": "benchmark_calibrated_dsm",
        "none": "relative_depth",
    }
    dem = runs["dem"]
    assert dem["calibration"]["scale"] == pytest.approx(6, rel=1e-4) and dem["calibration"]["shift"] == pytest.approx(40, rel=1e-4)
    assert dem["calibration"]["orientation"] == "negative_depth"
    assert not dem["metrics"]["calibration_refit"] and dem["metrics"]["rmse"] > 1
    assert dem["reference"]["holdout_points"] == dem["metrics"]["valid_pixels"] == W * H - 1
    assert dem["inference"]["passes"] == 2 and any("horizontally flipped" in n for n in dem["notices"])
    assert runs["gcp"]["calibration"]["scale"] == pytest.approx(3, rel=1e-5) and runs["gcp"]["metrics"] is None
    assert runs["gcp"]["calibration"]["reference_samples"] == runs["gcp"]["reference"]["point_count"] == 6
    assert runs["truth"]["metrics"]["calibration_refit"] and runs["truth"]["output_basis"] == "benchmark-fit"
    assert any("calibration leakage" in n for n in runs["truth"]["notices"])
    assert any(n.startswith("Shadow-based metric calibration was not applied: No acquisition timestamp") for n in runs["georef"]["notices"])
    assert any("nearest interpolation" in n for n in runs["near"]["notices"])


def test_requests_that_cannot_be_served_say_why(batch):
    reasons = {r["scene_id"]: r["reason"] for r in batch["rejects"].collect()}
    assert set(reasons) == {"both", "bad", "few", "lost"}
    assert "only one deployment calibration" in reasons["both"]
    assert "GCP sampling" in reasons["bad"] and "At least three GCP points" in reasons["few"]
    assert "GCP point 3" in reasons["lost"]


def test_masked_cells_are_not_scored_and_every_cell_has_a_height(batch):
    heights = batch["heights"].where("scene_id = 'gcp'")
    assert heights.count() == W * H and heights.where("height IS NULL").count() == 0
    assert batch["heights"].where("scene_id = 'none' AND height IS NOT NULL").count() == 0


def test_shadows_give_a_scale_when_the_image_is_located(spark, grid):
    width, height = 120, 110
    rng = np.random.default_rng(6)
    image = rng.integers(120, 220, (height, width, 3)).astype(np.int16)
    image[..., 2] = np.minimum(image[..., 2], image[..., 0])
    for r in range(3, height - 9, 9):
        for c in range(3, width - 9, 11):
            image[r : r + 7, c : c + 7] = (20, 22, 40)
    depth = rng.random((height, width)).astype(np.float32)
    scenes = spark.createDataFrame(
        [("a", "a.tif", width, height, "EPSG:3857", [0.5, 0.0, 8.1e6, 0.0, -0.5, 2.1e6], {"DATETIME": "2024:03:20 04:30:00"}, "bilinear", "fast")], SCENES
    )
    ok = np.ones((height, width), dtype=bool)
    pixels = grid("a", r=image[..., 0], g=image[..., 1], b=image[..., 2], valid=ok)
    truth = grid("a", value=(300 + 10 * depth).astype(np.float32), valid=ok)
    header = scenes.select("scene_id", "width", "height", "crs", "transform")
    out = calibrate_scenes(Inputs(scenes, pixels, depth=grid("a", depth=depth), truth=(truth, header)))
    run = out["runs"].first()
    assert run["mode"] == "shadow_calibrated_dsm"
    assert run["output_basis"] == "deployment-shadow"
    low, high = np.percentile(depth.astype(float), (5, 99))
    scale = run["calibration"]["scale"]
    assert run["calibration"]["shift"] == pytest.approx(-scale * low, abs=1e-3)
    noon = run["calibration"]
    assert noon["acquisition_time"] == "2024-03-20T04:30:00+00:00" and run["device"] == "unknown"
    assert 10 < noon["solar_elevation_degrees"] < 80 and 60 < noon["solar_azimuth_degrees"] < 180
    assert run["datum_offset"] > 250 and not run["metrics"]["calibration_refit"]
    # the shift serves the comparison only
    kept = out["heights"].agg(F.max("height")).first()[0]
    assert kept < scale * 1.1 * (high - low) + 5
    assert any("constant vertical offset" in n for n in run["notices"])
    dark = (image.sum(axis=2) < 100).mean()
    assert run["reference"]["coverage"] == pytest.approx(dark, abs=0.02)


def test_an_unreadable_time_only_costs_the_shadows(spark, grid):
    ok = np.ones((H, W), dtype=bool)
    red = np.round(ramp(W, H) * 80).astype(np.int16)
    rows = [(n, f"{n}.tif", W, H, "EPSG:3857", TRANSFORM, {}, "bilinear", "fast", "soon", f"job {n}") for n in ("dem", "alone")]
    scenes = spark.createDataFrame(rows, SCENES + ", acquisition_time string, job_id string")
    pixels = _union([grid(n, r=red, g=red, b=red, valid=ok) for n in ("dem", "alone")])
    depth = _union([grid(n, depth=-red / np.float32(100)) for n in ("dem", "alone")])
    dem = grid("dem", value=(10 + red / 50.0).astype(np.float32), valid=ok)
    header = scenes.where("scene_id = 'dem'").select("scene_id", "width", "height", "crs", "transform")
    out = calibrate_scenes(Inputs(scenes, pixels, depth=depth, dem=(dem, header)))
    runs = {r["scene_id"]: r for r in out["runs"].collect()}
    assert out["rejects"].count() == 0 and runs["dem"]["mode"] == "reference_dem_calibrated_dsm"
    assert runs["alone"]["mode"] == "relative_depth" and runs["alone"]["job_id"] == "job alone"
    assert any("must be ISO 8601" in n for n in runs["alone"]["notices"])


def test_display_is_separate_from_measurement(spark, grid, array):
    size = 72
    heights = np.zeros((size, size), dtype=np.float32)
    heights[20:44, 18:46] = 0.8
    heights += np.random.default_rng(2).random((size, size)).astype(np.float32) * 0.01
    scenes = spark.createDataFrame([("a", "a.png", size, size, None, None, {}, "bilinear", "fast")], SCENES)
    ok = np.ones((size, size), dtype=bool)
    gray = np.where(heights > 0.5, 200, 90).astype(np.int16)
    inputs = Inputs(scenes, grid("a", r=gray, g=gray, b=gray, valid=ok), depth=grid("a", depth=heights))
    settings = Settings(refine_radius=2, iterations=4, ground_radius=16, min_area=24, mesh_edge=64)
    out = analyze_scenes(inputs, settings)
    assert np.array_equal(array(out["heights"], "depth"), heights)
    prints = out["footprints"].collect()
    assert len(prints) == 1 and prints[0]["source"] == "segmentation" and prints[0]["roof_height"] > 0.5
    bare, display = array(out["bare"], "display"), array(out["display"], "display")
    assert bare[30, 30] < 0.2 < display[30, 30]
    assert display[22:42, 20:44].std() < 0.05
    head = out["mesh_headers"].first()
    assert (head["width"], head["height"]) == (64, 64) and head["maximum"] == pytest.approx(display.max(), abs=1e-5)
    assert out["height16"].agg(F.max("q")).first()[0] == 65535
    notes = out["notices"].first()["notices"]
    assert any("guided filter (radius 2)" in n for n in notes) and any(n.startswith("1 building regions") for n in notes)
    assert any("4 anisotropic-diffusion steps" in n for n in notes) and any(n.startswith("1 accepted structure") for n in notes)
    assert np.array_equal(array(out["depth_export"], "depth"), heights) and out["depth_preview"].count() == size * size
    assert out["calibrated"].count() == 0 and out["height16_masks"].count() == 0
    assert out["normals"].count() == size * size


def test_map_buildings_find_their_scene(spark, grid, tmp_path):
    """Ways reach their scene through their bounds, also when delivered twice."""
    from relief.functions.projection import from_mercator

    size = 60
    transform = [2.0, 0.0, 500000.0, 0.0, -2.0, 2000000.0]
    scenes = spark.createDataFrame(
        [("a", "a.tif", size, size, "EPSG:3857", transform, {}, "bilinear", "fast")], SCENES
    )
    corners, refs = [], []
    for k in range(12):
        col, row = 4 + 14 * (k % 4), 5 + 18 * (k // 4)
        for j, (dx, dy) in enumerate(((0, 0), (8, 0), (8, 8), (0, 8))):
            corners.append((10 * k + j, 500000.0 + 2 * (col + dx), 2000000.0 - 2 * (row + dy)))
        refs.append((k, [10 * k, 10 * k + 1, 10 * k + 2, 10 * k + 3, 10 * k], {"building": "yes"}))
    lon, lat = from_mercator(F.col("x"), F.col("y"))
    nodes = spark.createDataFrame(corners, "id long, x double, y double").select("id", lon.alias("lon"), lat.alias("lat"))
    ways = spark.createDataFrame(refs + refs[:5], "id long, nodes array<long>, tags map<string,string>")
    ok = np.ones((size, size), dtype=bool)
    depth = np.zeros((size, size), dtype=np.float32)
    for k in range(12):
        depth[5 + 18 * (k // 4) : 13 + 18 * (k // 4), 4 + 14 * (k % 4) : 12 + 14 * (k % 4)] = 0.8
    gray = np.where(depth > 0.5, 210, 80).astype(np.int16)
    inputs = Inputs(scenes, grid("a", r=gray, g=gray, b=gray, valid=ok), depth=grid("a", depth=depth), nodes=nodes, ways=ways)
    settings = Settings(refine_radius=2, iterations=2, ground_radius=8, min_area=16, mesh_edge=64)
    out = analyze_scenes(inputs, settings)
    prints = out["footprints"].collect()
    assert len(prints) == 12 and {p["source"] for p in prints} == {"osm"}
    assert any(n.startswith("12 blueprint-accurate") for n in out["notices"].first()["notices"])

    # the first run with a store fills it, later ones need no map tables
    folder = str(tmp_path / "areas")
    shape = lambda p: (p["osm_id"], p["roof_height"], [(q["u"], q["v"]) for q in p["points"]])
    again = display_scenes(out, replace(inputs, map_store=folder), settings)["footprints"].collect()
    alone = display_scenes(out, replace(inputs, map_store=folder, nodes=None, ways=None), settings)["footprints"].collect()
    assert sorted(map(shape, prints)) == sorted(map(shape, again)) == sorted(map(shape, alone))
    elsewhere = display_scenes(out, replace(inputs, map_store=str(tmp_path / "none"), nodes=None, ways=None), settings)
    assert {p["source"] for p in elsewhere["footprints"].collect()} == {"segmentation"}


def test_demo_run(spark):
    out = demo.demo_run(spark)
    run = out["runs"].first()
    assert run["orientation"] == "negative_depth" and run["scale"] == pytest.approx(86, rel=0.05)
    assert 0 < run["rmse"] < 2 and run["pearson"] > 0.98
    assert out["mesh_headers"].first()["width"] == 192


def test_intake_analyses_each_job_once_and_loses_none(spark, tmp_path):
    day = dt.datetime(2024, 5, 1, 12)

    def manifest(job, scene, hours=0, width=10, both=False):
        return (job, scene, day + dt.timedelta(hours=hours), width, 10, "nearest", "fast", both, both)

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def analysis(accepted):
        return accepted.select("job_id", "scene_id", F.lit("relative_depth").alias("mode"))

    def go(*rows):
        spark.createDataFrame(rows, intake.MANIFEST).coalesce(1).write.mode("append").parquet(source)
        intake.start_intake(spark, source, out, state, analysis).awaitTermination(120)
        return sorted((r["job_id"], r["mode"], r["reason"]) for r in spark.read.parquet(out).collect() if r["mode"]), [
            (r["job_id"], r["reason"]) for r in spark.read.parquet(out).where("reason IS NOT NULL").collect()
        ]

    served, refused = go(
        manifest("a", "x"), manifest("a", "x"), manifest("b", "y", both=True), manifest("c", "z", width=0)
    )
    assert served == [("a", "relative_depth", None)] and len(refused) == 3
    assert "only one deployment" in dict(refused)["b"] and dict(refused)["c"] == "contains no raster pixels"
    # three hours late, a repeat six hours later, and a refused job put right
    served, refused = go(manifest("late", "w", hours=-3), manifest("a", "x", hours=6), manifest("c", "z", hours=1))
    assert [job for job, _, _ in served] == ["a", "c", "late"]
    assert [job for job, reason in refused if "already" in reason] == ["a", "a"] and len(refused) == 4
    # a third start knows the jobs of both; all of one job in one file, null times and names first
    served, refused = go(manifest("late", "v"), *[manifest("d", f"s{k}", hours=k % 3) for k in range(9)], ("d", None, None, 10, 10, "nearest", "fast", False, False))
    assert [job for job, _, _ in served] == ["a", "c", "d", "late"] and len(refused) == 14
    kept = spark.read.parquet(out).where("job_id = 'd' AND reason IS NULL").collect()
    assert [r["scene_id"] for r in kept] == [None]
    assert spark.read.parquet(out).count() == 18


def test_jobs_are_marked_over_several_pieces():
    class State:
        exists = False

        def update(self, value):
            self.exists = value == (True,)

    def piece(*rows):
        return pd.DataFrame([("j", o, n, f"{o}{n}") for o, n in rows], columns=["job_id", "order", "named", "manifest"])

    def go(state, *pieces):
        return [tuple(r) for out in intake._first_of_job(("j",), iter(pieces), state) for r in out[["manifest", "repeated"]].itertuples(index=False)]

    state = State()
    marked = go(state, piece((5, "b"), (7, "a")), piece(), piece((5, "a"), (9, "c"), (5, "a")), piece((6, "z")))
    assert state.exists and sorted(marked) == [("5a", False), ("5a", True), ("5b", True), ("6z", True), ("7a", True), ("9c", True)]
    assert go(state, piece((1, "a"))) == [("1a", True)] and go(State(), piece()) == []
