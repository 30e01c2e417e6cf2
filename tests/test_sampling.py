from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from grids import ramp
from relief.operators import align, mesh, sample
from relief.operators.grid import extent
from relief.sources import gcps as gcp_source
from relief.sources import rasters


def test_csv_points_and_bilinear_samples(spark, grid, tmp_path):
    (tmp_path / "a.csv").write_text("﻿col, ROW,Height\n1.25,0.5,4\n3,2,-6\n\n0,1.75,8.5\n")
    points = gcp_source.read_gcp_csv(spark, str(tmp_path))
    assert {r["error"] for r in points.collect()} == {None}
    taken = sample.sample_points(points, grid(depth=(10 * np.arange(12.0)).reshape(3, 4)))
    assert [r["sampled"] for r in taken.orderBy("idx").collect()] == [32.5, 110, 70]


def test_csv_files_may_differ_in_header_and_quote_fields(spark, tmp_path):
    (tmp_path / "one.csv").write_text("x,y,z\n1,2,3\n")
    (tmp_path / "two.csv").write_text('name,Pixel-X,PIXEL_Y,Elevation\n"a,b",4,5,"6"\nc,7,,8\n')
    got = {(r["scene_id"], r["idx"]): (r["x"], r["y"], r["elevation"], r["error"]) for r in gcp_source.read_gcp_csv(spark, str(tmp_path)).collect()}
    assert got["one", 1] == (1, 2, 3, None)
    assert got["two", 1] == (4, 5, 6, None)
    assert got["two", 2][3] == "GCP point 2 is missing y coordinate; accepted field names are y, pixel_y, row"


def test_json_points(spark, tmp_path):
    good = {"coordinate_space": "pixel", "points": [{"pixel_x": 1, "pixel_y": 2, "z": 3.5}]}
    (tmp_path / "good.json").write_text(json.dumps(good))
    (tmp_path / "list.json").write_text(json.dumps([{"x": "1", "y": 2, "elevation": True}]))
    (tmp_path / "map.json").write_text(json.dumps({"coordinate_space": "world", "points": [{"x": 7.5, "y": 0, "z": 1}]}))
    (tmp_path / "none.json").write_text(json.dumps({"a": 1}))
    got = {r["scene_id"]: r for r in gcp_source.read_gcp_json(spark, str(tmp_path)).collect()}
    assert (got["good"]["x"], got["good"]["elevation"], got["good"]["error"]) == (1, 3.5, None)
    assert got["list"]["error"] == "GCP point 1 has a non-numeric elevation"
    assert "zero-based image pixels" in got["map"]["error"]
    assert "'points' list" in got["none"]["error"]


@pytest.mark.parametrize(
    "points, reason",
    [
        ([(0, 0), (1, 0)], "At least three GCP points"),
        ([(0, 0), (0, 0), (0, 0)], "distinct"),
        ([(0, 0), (1, 0), (2, 0), (2, 0)], "Duplicate"),
        ([(0, 0), (1, 0), (2, 0)], None),
    ],
)
def test_point_sets_are_checked(spark, points, reason):
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in points], "scene_id string, x double, y double")
    got = gcp_source.check_points(df).first()["reason"]
    assert got is None if reason is None else reason in got


def test_points_off_the_grid_or_on_masked_cells_are_reported(spark, grid):
    valid = np.ones((3, 3), dtype=bool)
    valid[1, 1] = False
    cells = grid(depth=np.arange(9.0).reshape(3, 3), valid=valid)
    points = spark.createDataFrame(
        [("a", 4.0, 0.0), ("a", 0.5, 0.5), ("a", 2.0, 1.0), ("a", -0.1, 0.0)], "scene_id string, x double, y double"
    )
    got = {(r["x"], r["y"]): r["status"] for r in sample.sample_points(points, cells, "depth", "valid").collect()}
    assert got == {(4, 0): "outside", (0.5, 0.5): "invalid_pixel", (2, 1): "ok", (-0.1, 0): "outside"}


def test_nearest_sampling_rounds_half_up(spark, grid):
    points = spark.createDataFrame([("a", 0.5, 1.49), ("a", 7.0, 5.0)], "scene_id string, x double, y double")
    base = ramp(8, 6)
    got = {r["x"]: r["sampled"] for r in sample.sample_points(points, grid(depth=base), method="nearest").collect()}
    assert got[0.5] == pytest.approx(base[1, 1]) and got[7.0] == pytest.approx(base[5, 7])
    with pytest.raises(ValueError):
        sample.sample_points(points, grid(depth=base), method="cubic")


def _header(spark, width, height, crs=None, transform=None):
    return spark.createDataFrame(
        [("a", width, height, crs, transform)], "scene_id string, width int, height int, crs string, transform array<double>"
    )


def test_resize_keeps_the_masked_corner_and_says_so(spark, grid, array):
    valid = np.ones((5, 7), dtype=bool)
    valid[0, 0] = False
    values = np.arange(35, dtype=np.float32).reshape(5, 7)
    out, modes = align.align_elevation(
        grid(value=values, valid=valid), _header(spark, 6, 4), _header(spark, 12, 8)
    )
    mask = array(out, "valid")
    assert mask.shape == (8, 12) and not mask[0, 0] and mask[-1, -1]
    assert "resized from 6x4 to 12x8" in modes.first()["notice"]


@pytest.mark.parametrize("shape", [(3, 4), (16, 21), (9, 9)])
def test_resize_of_a_constant_is_constant_and_covers_every_cell(grid, array, shape):
    cells = grid(v=np.full((9, 9), 4.25))
    sizes = extent(cells).withColumn("t_rows", F.lit(shape[0])).withColumn("t_cols", F.lit(shape[1]))
    out = array(align.resize_bilinear(cells, sizes, "v"), "value")
    assert out.shape == shape and np.allclose(out, 4.25)
    assert array(align.resize_nearest(cells, sizes, "v", "value"), "value").shape == shape


def test_halving_averages_with_the_wide_triangle(grid, array):
    values = np.arange(8.0)[None, :].repeat(2, axis=0)
    cells = grid(v=values)
    sizes = extent(cells).withColumn("t_rows", F.lit(2)).withColumn("t_cols", F.lit(4))
    out = array(align.resize_bilinear(cells, sizes, "v"), "value")[0]
    weights = np.maximum(0, 1 - np.abs(np.arange(8) + 0.5 - 2 * (np.arange(4)[:, None] + 0.5)) / 2)
    assert np.allclose(out, weights @ np.arange(8.0) / weights.sum(axis=1))


def test_reprojection_shifts_by_whole_pixels(spark, grid, array):
    values = np.arange(20, dtype=np.float32).reshape(4, 5)
    moved = _header(spark, 5, 4, "EPSG:3857", [2.0, 0.0, 102.0, 0.0, -2.0, 50.0])
    here = _header(spark, 5, 4, "EPSG:3857", [2.0, 0.0, 100.0, 0.0, -2.0, 50.0])
    out, modes = align.align_elevation(grid(value=values, valid=np.ones((4, 5), dtype=bool)), moved, here)
    assert modes.first()["mode"] == "georeferenced"
    assert not array(out, "valid")[:, 0].any() and array(out, "valid")[:, 1:].all()
    assert np.allclose(array(out, "value")[:, 1:].astype(float), values[:, :-1])


def test_reprojection_between_degrees_and_metres(spark, grid, array):
    values = np.add.outer(np.arange(30.0), np.arange(40.0)).astype(np.float32)
    degree = 2 / 111319.49079327357
    src = _header(spark, 40, 30, "EPSG:4326", [degree, 0.0, 0.0, 0.0, -degree, 0.0])
    dst = _header(spark, 40, 30, "EPSG:3857", [2.0, 0.0, 0.0, 0.0, -2.0, 0.0])
    out, _ = align.align_elevation(grid(value=values, valid=np.ones((30, 40), dtype=bool)), src, dst)
    good = array(out, "valid")
    assert good.mean() > 0.9
    assert np.abs(array(out, "value").astype(float) - values)[good].max() < 0.05


def test_mesh_grid_carries_a_mask_only_when_needed(grid):
    values = np.arange(600.0).reshape(20, 30)
    valid = ~((np.arange(20)[:, None] < 5) & (np.arange(30)[None, :] < 8))
    out, headers = mesh.mesh_grid(grid(v=values, valid=valid), "v", F.col("valid"), 64)
    head = headers.first()
    assert (head["width"], head["height"], head["masked"]) == (64, 43, True)
    masks = [r["valid"] for r in out.collect()]
    assert len(masks) == 64 * 43 and set(masks) == {True, False}
    assert not mesh.mesh_grid(grid(v=values), "v", None, 64)[1].first()["masked"]
    with pytest.raises(ValueError):
        mesh.mesh_grid(grid(v=values), "v", None, 32)


def test_npy_scan(spark, tmp_path):
    np.save(tmp_path / "dem.npy", np.array([[[1.0, np.nan], [3.0, 4.0]]]))
    np.save(tmp_path / "line.npy", np.arange(3.0))
    (tmp_path / "bad.npy").write_bytes(b"not an array")
    cells, problems = rasters.read_npy(spark, str(tmp_path / "*.npy"), "dem")
    got = {(r["row"], r["col"]): (r["value"], r["valid"]) for r in cells.collect()}
    assert got[1, 1] == (4, True) and not got[0, 1][1] and len(got) == 4
    assert {r["scene_id"] for r in problems.collect()} == {"line", "bad"}


def test_elevation_nodata_is_masked(grid):
    cells = grid(v=np.array([[1.0, -9999.0], [np.nan, 4.0]]))
    out = rasters.elevation_cells(cells, "v", nodata=F.lit(-9999.0))
    assert [r["valid"] for r in out.orderBy("row", "col").collect()] == [True, False, False, True]


def test_band_scan_stretches_and_repeats(grid, array):
    values = np.arange(100.0).reshape(10, 10) * 37
    out = rasters.rgb_from_bands(grid(b1=values, valid=np.ones((10, 10), dtype=bool)), eight_bit=False)
    low, high = np.percentile(values, (2, 98))
    expected = np.round(np.clip((values - low) / (high - low), 0, 1) * 255)
    assert np.array_equal(array(out, "r"), expected) and np.array_equal(array(out, "b"), expected)
    flat = rasters.rgb_from_bands(grid(b1=np.full((4, 4), 9.0), valid=np.ones((4, 4), dtype=bool)), eight_bit=False)
    assert set(array(flat, "g").ravel()) == {127}
