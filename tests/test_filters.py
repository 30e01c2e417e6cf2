from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from relief.operators import diffuse, focal


def _box(values, radius):
    height, width = values.shape
    out = np.empty_like(values)
    for r in range(height):
        for c in range(width):
            out[r, c] = values[max(0, r - radius) : r + radius + 1, max(0, c - radius) : c + radius + 1].mean()
    return out


def _guided(guide, source, radius, epsilon):
    mean = lambda v: _box(v, radius)
    slope = (mean(guide * source) - mean(guide) * mean(source)) / (mean(guide**2) - mean(guide) ** 2 + epsilon)
    return mean(slope) * guide + mean(mean(source) - slope * mean(guide))


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(4).random((23, 31))


def test_frames_agree_across_tile_borders(spark, grid, array, noise, monkeypatch):
    monkeypatch.setattr(focal, "tile_side", lambda halo: 8)
    cells = grid(v=noise)
    assert np.allclose(array(focal.box_mean(cells, "v", 3), "box_mean"), _box(noise, 3))
    dy, dx = np.gradient(noise)
    grads = focal.gradient(cells, "v")
    assert np.allclose(array(grads, "dx"), dx) and np.allclose(array(grads, "dy"), dy)
    pad = np.pad(noise, 2, mode="edge")
    window = np.lib.stride_tricks.sliding_window_view
    eroded = window(pad, (5, 5)).min(axis=(2, 3))
    assert np.array_equal(array(focal.morphology(cells, "v", 2, F.min, "e"), "e"), eroded)
    opened = window(np.pad(eroded, 2, mode="edge"), (5, 5)).max(axis=(2, 3))
    assert np.array_equal(array(focal.ground_surface(cells, "v", 2), "ground"), opened)


@pytest.mark.parametrize("radius", [4, 40])
def test_guided_filter_cuts_its_radius_to_the_scene(grid, array, noise, radius):
    guide = np.sin(np.arange(23)[:, None] / 3) + noise / 5
    out = focal.guided_filter(grid(g=guide, s=noise), "g", "s", radius, 1e-3)
    used = min(radius, (23 - 1) // 2)
    assert np.allclose(array(out, "filtered"), _guided(guide, noise, used, 1e-3))


def test_refinement_keeps_invalid_cells_and_flat_scenes(grid, array, noise):
    depth = noise.astype(np.float32)
    depth[2, 3] = np.nan
    valid = np.ones_like(depth, dtype=bool)
    valid[5, 5] = False
    bands = dict(r=(noise * 200).astype(int), g=(noise * 90).astype(int), b=(noise * 30).astype(int))
    out = array(focal.refine_with_image(grid(depth=depth, valid=valid, **bands), "depth", F.col("valid"), 3), "refined")
    assert np.isnan(out[2, 3]) and out[5, 5] == depth[5, 5] and not np.allclose(out[8], depth[8])
    flat = np.full((23, 31), 2.5, dtype=np.float32)
    assert np.array_equal(array(focal.refine_with_image(grid(depth=flat, **bands), "depth", None, 3), "refined"), flat)


def _diffuse(values, steps, limit):
    for _ in range(steps):
        pad = np.pad(values, 1, mode="edge")
        flux = np.zeros_like(values)
        for near in (pad[:-2, 1:-1], pad[2:, 1:-1], pad[1:-1, :-2], pad[1:-1, 2:]):
            gap = near - values
            flux += np.exp(-((gap / limit) ** 2)) * gap
        values = values + 0.25 * flux
    return values


def test_diffusion_on_tiles_equals_the_whole_grid(grid, array, noise, monkeypatch):
    expected = _diffuse(noise, 5, (noise.max() - noise.min()) * 0.12)
    out = array(diffuse.diffuse(grid(v=noise), "v", 5, storage="double"), "levelled")
    assert np.allclose(out, expected, atol=1e-12)


def test_diffusion_over_several_tiles(grid, array):
    values = np.random.default_rng(5).random((40, 1100))
    expected = _diffuse(values, 3, (values.max() - values.min()) * 0.12)
    out = array(diffuse.diffuse(grid(v=values), "v", 3, storage="double"), "levelled")
    assert np.allclose(out, expected, atol=1e-12)


@pytest.mark.parametrize(("side", "round_", "steps"), [(16, 4, 30), (5, 32, 11), (64, 8, 8)])
def test_diffusion_is_the_same_in_rounds(grid, array, noise, monkeypatch, side, round_, steps):
    monkeypatch.setattr(diffuse, "SIDE", side)
    monkeypatch.setattr(diffuse, "ROUND", round_)
    monkeypatch.setattr(diffuse, "KEEP", 3)
    expected = _diffuse(noise, steps, (noise.max() - noise.min()) * 0.12)
    out = array(diffuse.diffuse(grid(v=noise), "v", steps, storage="double"), "levelled")
    assert np.allclose(out, expected, atol=1e-12)


def test_diffusion_of_ragged_and_flat_scenes(spark, grid, monkeypatch):
    """Missing cells and whole missing tiles conduct nothing; flat scenes and other columns stay."""
    monkeypatch.setattr(diffuse, "SIDE", 8)
    monkeypatch.setattr(diffuse, "ROUND", 3)
    values = np.random.default_rng(8).random((12, 40))
    values[:, 17:31] = np.nan
    whole = grid(v=values, extra=values * 2).where("v IS NOT NULL AND NOT isnan(v)")
    flat = grid("flat", v=np.full((3, 3), 2.0), extra=np.ones((3, 3)))
    out = diffuse.diffuse(whole.unionByName(flat), "v", 10, storage="double").toPandas()
    assert set(out.columns) == {"scene_id", "row", "col", "v", "extra", "levelled"}
    assert (out[out.scene_id == "flat"].levelled == 2.0).all()
    limit = (np.nanmax(values) - np.nanmin(values)) * 0.12
    got = np.full(values.shape, np.nan)
    mine = out[out.scene_id == "a"]
    got[mine.row, mine.col] = mine.levelled
    assert np.allclose(got[:, :17], _diffuse(values[:, :17], 10, limit), atol=1e-12)
    assert np.allclose(got[:, 31:], _diffuse(values[:, 31:], 10, limit), atol=1e-12)
    assert len(mine) == 12 * 26 and np.allclose(mine.extra, 2 * mine.v)


def test_diffusion_leaves_invalid_cells(grid, array, noise):
    valid = np.ones_like(noise, dtype=bool)
    valid[4, 4] = False
    out = array(diffuse.diffuse(grid(v=noise, valid=valid), "v", 2, valid=F.col("valid"), storage="double"), "levelled")
    assert out[4, 4] == noise[4, 4] and out[10, 10] != noise[10, 10]


def test_smoothing_passes_touch_only_the_interior(grid, array, noise):
    out = array(focal.bilateral(grid(v=noise), "v", 2), "smoothed")
    assert np.allclose(out[0], noise[0], atol=1e-7) and np.allclose(out[:, -1], noise[:, -1], atol=1e-7)
    assert not np.allclose(out[5:9, 5:9], noise[5:9, 5:9])
    assert np.array_equal(array(focal.bilateral(grid(v=noise), "v", 0), "smoothed"), noise)


def test_detrend_removes_seven_tenths_of_a_plane(grid, array):
    x, y = np.meshgrid(np.linspace(-0.5, 0.5, 31), np.linspace(-0.5, 0.5, 23))
    out = array(focal.detrend(grid(v=5 + 2 * x - 3 * y), "v", storage="double"), "detrended")
    assert np.allclose(out, 5 + 0.3 * (2 * x - 3 * y))


def test_edge_quality_of_matching_edges(grid):
    step = np.zeros((20, 24))
    step[:, 12:] = 1
    row = focal.edge_quality(grid(d=step + np.linspace(0, 0.01, 24), g=step * 255), "d", "g").first()
    assert row["edge_alignment"] > 0.99
    flat = focal.edge_quality(grid(d=np.ones((20, 24)), g=step * 255), "d", "g").first()
    assert flat["edge_alignment"] == 0 and flat["edge_contrast"] == float("inf")
