from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from relief import sinks, stores
from relief.functions import pixel, projection, ramps, ring, text
from relief.operators import mesh, models, vector
from relief.operators.grid import extent
from relief.sources import catalog, files, gcps, osm

POINTS = "array<struct<u:double,v:double>>"


def _ring(spark, points):
    return spark.createDataFrame([([tuple(map(float, p)) for p in points],)], f"points {POINTS}")


@pytest.mark.parametrize(
    "points, expected",
    [
        ([(0, 0), (0, 0), (1, 0), (1, 1), (0, 0)], [(0, 0), (1, 0), (1, 1)]),
        # each step is small, but the drift from the last kept point is not
        ([(0, 0), (0.6e-5, 0), (1.2e-5, 0), (1, 1), (0, 1)], [(0, 0), (1.2e-5, 0), (1, 1), (0, 1)]),
        ([(0, 0), (1, 0), (0, 0)], None),
    ],
)
def test_ring_tidying_compares_with_the_last_kept_point(spark, points, expected):
    got = _ring(spark, points).select(ring.tidy_ring("points").alias("r")).first()["r"]
    assert (None if got is None else [(p["u"], p["v"]) for p in got]) == expected


def test_ring_area_and_containment(spark):
    shape = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (0, 3)]
    df = _ring(spark, shape)
    assert df.select(ring.ring_area("points")).first()[0] == 6
    for (u, v), inside in {(0.5, 2.0): True, (2.0, 2.0): False, (3.0, 0.5): True, (-1.0, 0.5): False}.items():
        assert df.select(ring.contains("points", F.lit(u), F.lit(v))).first()[0] == inside


def test_overpass_documents_become_footprints(spark, tmp_path):
    ids = {1: (0, 0), 2: (20, 0), 3: (20, -10), 4: (0, -10)}
    nodes = []
    for k, (x, y) in ids.items():
        lon, lat = x / projection.ORIGIN_SHIFT * 180, np.degrees(2 * np.arctan(np.exp(y / 6378137.0)) - np.pi / 2)
        nodes.append({"type": "node", "id": k, "lon": lon, "lat": lat})
    ways = [
        {"type": "way", "id": 10, "nodes": [1, 2, 3, 4, 1], "tags": {"building": "office", "building:levels": "3.5"}},
        {"type": "way", "id": 11, "nodes": [1, 2, 99, 98, 1]},
        {"type": "way", "id": 12, "nodes": [1, 2, 1]},
        {"type": "relation", "id": 13},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"version": 0.6, "elements": nodes + ways}))
    node_table, way_table = osm.read_osm_json(spark, str(tmp_path))
    scene = spark.createDataFrame(
        [("a", "EPSG:3857", [1.0, 0.0, -1.5, 0.0, -1.0, 1.5], 40, 20)],
        "scene_id string, crs string, transform array<double>, width int, height int",
    )
    pairs = spark.createDataFrame([("a", k) for k in (10, 11, 12)], "scene_id string, way_id long")
    rows = vector.osm_footprints(vector.way_rings(way_table, node_table), scene, pairs).collect()
    assert [r["osm_id"] for r in rows] == [10]
    assert (rows[0]["building_type"], rows[0]["name"], rows[0]["levels"]) == ("office", None, 3.5)
    assert [(round(p["u"] * 39), round(p["v"] * 19)) for p in rows[0]["points"]] == [(1, 1), (21, 1), (21, 11), (1, 11)]


def test_peaks_use_block_maxima_and_raster_order(spark, grid):
    rng = np.random.default_rng(0)
    values = np.round(rng.random((300, 260)), 2)
    boxes = [("a", i, *sorted(rng.integers(0, 300, 2).tolist()), *sorted(rng.integers(0, 260, 2).tolist()), 260, 300) for i in range(12)]
    df = spark.createDataFrame(boxes, "scene_id string, osm_id long, row_min int, row_max int, col_min int, col_max int, width int, height int")
    got = {r["osm_id"]: (r["peak"], r["peak_row"], r["peak_col"]) for r in vector.footprint_peaks(df, grid(v=values), "v").collect()}
    for _, i, r0, r1, c0, c1, _, _ in boxes:
        top, left = max(0, r0 - 20), max(0, c0 - 20)
        part = values[top : r1 + 21, left : c1 + 21]
        r, c = np.unravel_index(part.argmax(), part.shape)
        assert got[i] == (part.max(), top + r, left + c)


def _raise(spark, grid, values, ground, points, levels=None):
    prints = spark.createDataFrame(
        [("a", 1, [tuple(p) for p in points], "yes", None, levels, "osm")],
        f"scene_id string, osm_id long, points {POINTS}, building_type string, name string, levels double, source string",
    )
    cells = grid(h=values, g=ground)
    sizes = extent(cells).select("scene_id", F.col("n_cols").alias("width"), F.col("n_rows").alias("height"))
    return vector.raise_footprints(prints, cells, "h", "g", sizes).first()


def test_footprints_move_towards_a_displaced_roof(spark, grid):
    values = np.zeros((51, 51))
    values[30, 25] = 5.0
    square = [(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6)]
    row = _raise(spark, grid, values, np.zeros_like(values), square)
    assert row["roof_height"] == 5 and row["base_height"] == 0
    assert [round(p["v"], 6) for p in row["points"]] == [0.475, 0.475, 0.675, 0.675]
    assert [round(p["u"], 6) for p in row["points"]] == [0.4, 0.6, 0.6, 0.4]


@pytest.mark.parametrize("levels, share", [(None, 1.5), (4.0, 4.0), (0.0, 1.5)])
def test_flat_footprints_get_a_minimum_relief(spark, grid, levels, share):
    values = np.zeros((80, 80))
    values[0, 0] = 10.0  # far from the footprint, only widens the spread
    square = [(0.6, 0.6), (0.8, 0.6), (0.8, 0.8), (0.6, 0.8)]
    row = _raise(spark, grid, values, np.zeros_like(values), square, levels)
    assert row["roof_height"] == pytest.approx(10 * 0.012 * share)


def test_footprint_source_depends_on_the_count(spark):
    mapped = spark.createDataFrame([("a", "osm")] * 10 + [("b", "osm")] * 9, "scene_id string, source string")
    segmented = spark.createDataFrame([("a", "segmentation"), ("b", "segmentation"), ("c", "segmentation")], "scene_id string, source string")
    got = {(r["scene_id"], r["source"]): r["count"] for r in vector.choose_footprints(mapped, segmented).groupBy("scene_id", "source").count().collect()}
    assert got == {("a", "osm"): 10, ("b", "segmentation"): 1, ("c", "segmentation"): 1}


def test_way_pairs_appear_once(spark):
    rng = np.random.default_rng(1)
    make = lambda n: [(i, *map(float, b)) for i, b in enumerate(rng.random((n, 4)) * (0.1, 0.1, 0.05, 0.05))]
    ways, scenes = make(40), make(15)
    w = spark.createDataFrame(ways, "way_id int, x double, y double, w double, h double").selectExpr(
        "way_id", "x w_min_lon", "y w_min_lat", "x + w w_max_lon", "y + h w_max_lat")
    s = spark.createDataFrame(scenes, "scene_id int, x double, y double, w double, h double").selectExpr(
        "scene_id", "x min_lon", "y min_lat", "x + w max_lon", "y + h max_lat")
    got = sorted((r["scene_id"], r["way_id"]) for r in osm.ways_in_scenes(w, s).collect())
    hit = lambda a, b: a[1] <= b[1] + b[3] and b[1] <= a[1] + a[3] and a[2] <= b[2] + b[4] and b[2] <= a[2] + a[4]
    assert got == sorted((b[0], a[0]) for a in ways for b in scenes if hit(a, b))


def test_stored_ways_are_found_again(spark, tmp_path):
    scenes = spark.createDataFrame([("a", 1.0, 2.0, 1.1, 2.1), ("b", 5.0, 2.0, 5.1, 2.1)], "scene_id string, min_lat double, min_lon double, max_lat double, max_lon double")
    keyed = scenes.where("scene_id = 'a'").withColumn("cache_key", osm.cache_key(*[F.col(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")]))
    osm.store_ways(keyed.select("cache_key", F.lit(7).alias("id")), str(tmp_path / "cache"))
    hit, miss = osm.cached_and_missing(scenes, spark.read.parquet(str(tmp_path / "cache")))
    assert [r["scene_id"] for r in hit.collect()] == ["a"] and [r["scene_id"] for r in miss.collect()] == ["b"]
    # an area without ways is stored as such, and storing ways again leaves no repeats
    both = osm.with_cache_key(scenes)
    for _ in range(2):
        osm.store_ways(keyed.select("cache_key", F.lit(8).alias("id")), str(tmp_path / "cache"), both)
    keys = stores.stored_keys(spark, str(tmp_path / "cache"), "cache_key")
    assert osm.cached_and_missing(scenes, keys)[1].count() == 0
    assert [r["id"] for r in stores.stored_rows(spark, str(tmp_path / "cache"), "cache_key").collect()] == [8]


def test_a_later_run_replaces_its_scenes_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "scene_id string, row int, v double")
    read = lambda only=None: sorted((r["scene_id"] or "", r["row"], r["v"]) for r in stores.stored_rows(spark, path, only=only).collect())
    names = lambda *ids: spark.createDataFrame([(i,) for i in ids], "scene_id string")
    stores.replace_rows(make([("007", 0, 1.0), ("007", 5000, 2.0), ("8", 0, 3.0), (None, 1, 4.0)]), path)
    with pytest.raises(Exception):
        stores.replace_rows(make([("8", 0, 0.0)]), path, replace=False)
    assert read() == [("", 1, 4.0), ("007", 0, 1.0), ("007", 5000, 2.0), ("8", 0, 3.0)]
    # "8" is written again and "007" has nothing left; the others stay
    stores.replace_rows(make([("8", 2, 9.0), ("9", 0, 5.0)]), path, keys=names("007", "8", "9"))
    assert read() == [("", 1, 4.0), ("8", 2, 9.0), ("9", 0, 5.0)]
    assert {r[0] for r in stores.stored_keys(spark, path).collect()} == {None, "007", "8", "9"}
    stores.replace_rows(make([(None, 2, 6.0), ("", 3, 7.0)]), path, keys=names(None, ""))
    assert read() == [("", 2, 6.0), ("", 3, 7.0), ("8", 2, 9.0), ("9", 0, 5.0)]
    # no rows at all, and a table that does not exist yet
    stores.replace_rows(make([]), path, keys=names("9", None))
    assert read() == [("8", 2, 9.0)]
    stores.replace_rows(make([]), str(tmp_path / "new"), keys=names("x"))
    assert stores.stored_rows(spark, str(tmp_path / "new")).count() == 0
    wanted = stores.stored_rows(spark, path, only=names("8", "9"))
    assert [r["v"] for r in wanted.collect()] == [9.0]


def test_reading_some_scenes_reads_their_partitions_only(spark, tmp_path):
    path, listed = str(tmp_path / "t"), str(tmp_path / "wanted")
    rows = spark.range(400).selectExpr("concat('s', id % 40) scene_id", "cast(id as int) row")
    stores.replace_rows(rows, path)
    spark.createDataFrame([("s3",), ("s7",)], "scene_id string").write.parquet(listed)
    some = stores.stored_rows(spark, path, only=spark.read.parquet(listed))
    assert some.count() == 20
    assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString()


def test_stored_runs_follow_their_scenes(spark, tmp_path):
    path = str(tmp_path / "run")
    runs = lambda *ids: spark.createDataFrame([(i, 1.0) for i in ids], "scene_id string, mae double")
    rejects = lambda *ids: spark.createDataFrame([(i, "no") for i in ids], "scene_id string, reason string")
    sinks.write_run({"runs": runs("a", "b"), "rejects": rejects("c")}, path)
    sinks.write_run({"runs": runs("c"), "rejects": rejects("b")}, path, overwrite=True)
    kept = lambda name: sorted(r["scene_id"] for r in stores.stored_rows(spark, f"{path}/{name}").collect())
    assert kept("runs") == ["a", "c"] and kept("rejects") == ["b"]
    documents = [json.loads(r[0]) for r in spark.read.text(f"{path}/runs_json").select("value").collect()]
    assert {d["scene_id"]: "reason" in d for d in documents} == {"a": False, "b": True, "c": False}


def test_calibrated_export_keeps_grid_tags_and_mask(spark, grid):
    valid = np.array([[True, False], [True, True]])
    scenes = spark.createDataFrame(
        [("a", 2, 2, "EPSG:32643", [2.0, 0.0, 5e5, 0.0, -2.0, 2e6], {"SENSOR": "x", "RELIEF_OUTPUT": "old"})],
        "scene_id string, width int, height int, crs string, transform array<double>, tags map<string,string>",
    )
    fits = spark.createDataFrame([("a", "ground_truth_dsm", "ok")], "scene_id string, source string, status string")
    cells = grid(height=np.array([[1.0, 2.0], [np.nan, 4.0]]), valid=valid)
    out, headers = sinks.calibrated_export(cells, scenes, fits)
    assert [(r["value"], r["mask"]) for r in out.orderBy("row", "col").collect()] == [(1, 255), (-9999, 0), (-9999, 0), (4, 255)]
    head = headers.first()
    assert head["tags"]["RELIEF_CALIBRATION"] == "benchmark_only_affine" and head["tags"]["SENSOR"] == "x"
    assert head["crs"] == "EPSG:32643" and head["transform"][2] == 5e5
    assert sinks.calibrated_export(cells, scenes.withColumn("crs", F.lit(None).cast("string")), fits)[1].count() == 0


def test_json_has_no_nan_and_tables_are_not_overwritten(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan"), [1.0, float("inf")])], "scene_id string, x double, y array<double>")
    assert json.loads(sinks.strict_json(df).first()["json"]) == {"scene_id": "a", "y": [1.0, None]}
    sinks.write_scene_table(df, str(tmp_path / "t"))
    with pytest.raises(Exception):
        sinks.write_scene_table(df, str(tmp_path / "t"))
    sinks.write_scene_table(df, str(tmp_path / "t"), overwrite=True)


def test_previews_and_run_folders(spark, grid, tmp_path):
    valid = np.ones((20, 20), dtype=bool)
    valid[3, 3] = False
    out = sinks.preview_table(grid(v=np.arange(400.0).reshape(20, 20), valid=valid), "v")
    got = {(r["row"], r["col"]): (r["red"], r["green"], r["blue"]) for r in out.collect()}
    assert got[3, 3] == (15, 20, 31) and got[0, 0] == (24, 35, 82) and got[19, 19] == (249, 134, 38)
    runs = spark.createDataFrame([("a", float("nan"))], "scene_id string, mae double")
    sinks.write_run({"runs": runs, "preview": out}, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run" / "preview")).count() == 400
    assert spark.read.text(str(tmp_path / "run" / "runs_json")).first()[0] == '{"scene_id":"a"}'


def test_files_are_listed_hashed_and_described(spark, tmp_path):
    (tmp_path / "b.TIF").write_bytes(b"II*\0abc")
    (tmp_path / "a.txt").write_text("hello")
    listed = files.list_files(spark, str(tmp_path)).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["length"], r["likely_data"]) for r in listed] == [("a.txt", 5, False), ("b.TIF", 7, True)]
    totals = files.file_totals(files.list_files(spark, str(tmp_path))).first()
    assert (totals["file_count"], totals["data_files"], totals["bytes"]) == (2, 1, 12)
    digest = {r["length"]: r["sha256"] for r in files.content_hashes(spark, str(tmp_path)).collect()}
    assert digest[5].startswith("2cf24dba5fb0a30e")
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "one.json").write_text('{"scene": "x"}')
    (tmp_path / "s" / "two.json").write_text("{broken")
    notes = {r["path"].rsplit("/", 1)[1]: r["metadata"] for r in files.read_sidecars(spark, str(tmp_path / "s")).collect()}
    assert notes == {"one.json": {"scene": "x"}, "two.json": {"notice": files.SIDECAR_NOTICE}}


@pytest.mark.parametrize(
    "tags, expected",
    [
        ({"tifftag_datetime": "2021:04:15 15:30:00"}, "2021-04-15 15:30:00"),
        ({"DATETIME": "2021-04-15", "NITF_IDATIM": "20200101000000"}, "2021-04-15 12:00:00"),
        ({"ACQUISITION_DATE": "soon", "NITF_IDATIM": "20200101000000"}, "2020-01-01 00:00:00"),
        ({"DATE_ACQUIRED": " 2021-04-15T15:30:00Z "}, "2021-04-15 15:30:00"),
        ({"OTHER": "2021-04-15"}, None),
    ],
)
def test_acquisition_time(spark, tags, expected):
    df = spark.createDataFrame([(tags,)], "tags map<string,string>")
    assert df.select(F.date_format(text.acquisition_time("tags"), "yyyy-MM-dd HH:mm:ss")).first()[0] == expected


def test_model_reports(spark):
    timings = spark.createDataFrame(
        [("a", 1, 2.0, "completed"), ("a", 2, 4.0, "completed"), ("a", 3, 9.0, "failed"), ("b", 1, 1.0, "failed")],
        "model string, run int, seconds double, status string",
    )
    got = {r["model"]: (r["status"], r["timed_runs"], r["median_seconds"]) for r in models.timing_report(timings).collect()}
    assert got == {"a": ("completed", 2, 3.0), "b": ("failed", 0, None)}
    metrics = spark.createDataFrame([("a", "s", 1.0, 2.0, 10)], "model_id string, scene_id string, mae double, rmse double, valid_pixels long")
    planned = spark.createDataFrame([("a",), ("b",), ("c",)], "model string")
    report = {r["model"]: (r["status"], r["mae"]) for r in models.sweep_report(metrics, timings, planned).collect()}
    assert report == {"a": ("completed", 1.0), "b": ("failed", None), "c": ("skipped", None)}
    scores = spark.createDataFrame([("a", 0.2), ("b", 0.5), ("c", None)], "model string, edge_alignment double")
    assert [r["model"] for r in models.rank_models(scores).collect()] == ["b", "a"]


def test_catalogs(spark):
    scenes = {r["scene_id"]: r for r in catalog.scene_catalog(spark).collect()}
    assert len(scenes) == 10
    assert list(scenes["downtown"]["transform"]) == [1.0, 0.0, 397800.0, 0.0, -1.0, 136024.0]
    assert scenes["delhi-cp"]["transform"][0] == pytest.approx(650 / 1024)
    assert catalog.model_catalog(spark).count() == 3


def test_scalar_codes(spark):
    one = spark.range(1)
    low, high = F.lit(2.0), F.lit(4.0)
    row = one.select(
        pixel.quantise16(F.lit(3.0), low, high).alias("q"),
        pixel.quantise16(F.lit(3.0), low, low).alias("z"),
        pixel.dequantise(F.lit(255), low, high).alias("d"),
        pixel.mask_bit(F.lit(128)).alias("m"),
        pixel.decoded_size_problem(F.lit(10000), F.lit(5001), 50_000_000).alias("p"),
        pixel.decoded_size_problem(F.lit(90000), F.lit(90000)).alias("any"),
        pixel.decoded_size_problem(F.lit(0), F.lit(5)).alias("n"),
        pixel.domain_unit(F.lit(7.0), F.lit(5.0), F.lit(5.0)).alias("u"),
        ramps.preview_colour(F.lit(0.0), F.lit(True))["red"].alias("r0"),
        ramps.preview_colour(F.lit(1.0), F.lit(True))["blue"].alias("b1"),
        ramps.preview_colour(F.lit(0.5), F.lit(False))["green"].alias("g"),
    ).first()
    assert (row["q"], row["z"], row["d"], row["m"]) == (32768, 0, 4.0, True)
    assert row["p"] == "has 50,010,000 decoded pixels; the configured limit is 50,000,000" and row["n"] == "contains no raster pixels" and row["any"] is None
    assert (row["u"], row["r0"], row["b1"], row["g"]) == (1.0, 24, 38, 20)


def test_grids_unpack_from_flat_and_nested_values(spark):
    flat = spark.createDataFrame([("a", None, [1.0, 2.0, 3.0, 4.0]), ("b", 4, [1.0, 2.0, 3.0, 4.0])], "scene_id string, width int, values array<double>")
    got = {(r["scene_id"], r["row"], r["col"]): r["value"] for r in mesh.unpack_grid(flat).collect()}
    assert got["a", 1, 0] == 3 and got["b", 0, 3] == 4
    nested = spark.createDataFrame([("a", [[1.0, 2.0], [3.0, 4.0]])], "scene_id string, values array<array<double>>")
    assert mesh.unpack_nested(nested).where("row = 1 AND col = 0").first()["value"] == 3


def test_triangles_need_three_valid_corners(grid):
    valid = np.ones((3, 3), dtype=bool)
    valid[1, 1] = False
    got = [(r["a"], r["b"], r["c"]) for r in mesh.triangles(grid(valid=valid)).collect()]
    assert sorted(got) == [(0, 3, 1), (5, 7, 8)]


def test_equal_rings_and_places_meet_once_and_are_not_broadcast(spark):
    square = lambda u: [(u, 0.1), (u + 0.2, 0.1), (u + 0.2, 0.3), (u, 0.3)]
    rings = [("a", square(0.1 * (k % 3)), float(k)) for k in range(300)] + [("b", square(0.1), None)]
    prints = spark.createDataFrame(rings, f"scene_id string, points {POINTS}, roof double")
    points = [("a", k, 0.01 + 0.1 * (k % 5), 0.2) for k in range(300)] + [("b", 300, 0.2, 0.2), ("c", 301, 0.2, 0.2)]
    out = vector.highest_roof(spark.createDataFrame(points, "scene_id string, id long, u double, v double"), prints, "roof", ["id"])
    # files of rings are small, the rows of a large town are not
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    best = {0: 297.0, 1: 298.0, 2: 299.0, 3: 299.0}
    want = {k: best[k % 5] for k in range(300) if k % 5 < 4} | {300: None}
    assert {r["id"]: r["roof"] for r in out.collect()} == want


def test_equal_boxes_are_searched_once(spark, grid, monkeypatch):
    values = np.random.default_rng(3).random((60, 64))
    boxes = [("a", i, 5, 9, 10 + i % 2, 14, 64, 60) for i in range(2000)]
    df = spark.createDataFrame(boxes, "scene_id string, osm_id long, row_min int, row_max int, col_min int, col_max int, width int, height int")
    written, write = [], vector.materialise
    monkeypatch.setattr(vector, "materialise", lambda rows: written.append(write(rows)) or written[-1])
    out = vector.footprint_peaks(df, grid(v=values), "v")
    assert [w.count() for w in written] == [1]  # both boxes are cut at column 0
    got = {r["osm_id"]: (r["peak"], r["peak_row"], r["peak_col"]) for r in out.collect()}
    r, c = np.unravel_index(values[:30, :35].argmax(), (30, 35))
    assert got == {i: (values[r, c], r, c) for i in range(2000)}


def test_records_keep_their_rules_in_one_reading(spark):
    fields = "map<string,string>"
    rows = [
        (1, {" X ": "1", "y": "2", "z": " 3 "}),
        (2, {"x": " ", "pixel-x": "4", "Y": "5", "height": "6"}),
        (4, {"x": "1d", "y": "2", "z": "3"}),
        (5, {"x": "1", "y": "nan", "z": "3"}),
        (6, {"x": "1", "y": "2", "z": "3", "Coordinate-Space": "map"}),
        (7, None),
    ]
    df = spark.createDataFrame([("a", *r) for r in rows], f"scene_id string, idx int, fields {fields}")
    twice = spark.sql("SELECT 'a' scene_id, 3 idx, map('x', '7', 'X ', '8', 'y', '9', 'z', '1') fields")  # the later of equal names
    df = df.unionByName(twice)
    got = {r["idx"]: (r["x"], r["y"], r["elevation"], (r["error"] or "")[12:30]) for r in gcps.points_from_records(df).collect()}
    none = (None,) * 3
    assert got == {
        1: (1.0, 2.0, 3.0, ""), 2: (4.0, 5.0, 6.0, ""), 3: (8.0, 9.0, 1.0, ""), 4: (*none, "has a non-numeric "),
        5: (*none, "has a non-finite y"), 6: (*none, "declares unsupport"), 7: (*none, "is missing x coord"),
    }
    texts = [('[{"x": 1, "y": 2, "z": 3}]',), ('{"points": [], "coordinate_space": "map"}',), ("[]",), ("{",), ('{"points": [{"x": 1}]}',)]
    out = gcps.points_from_json(spark.createDataFrame(texts, "json string").selectExpr("json scene_id", "json"))
    # documents are read and parsed once
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    found = {r["scene_id"]: (r["idx"], r["x"], (r["error"] or "")[:15]) for r in out.collect()}
    assert found == dict(zip([t[0] for t in texts], [(1, 1.0, ""), *[(None, None, "GCP JSON object")] * 3, (1, None, "GCP point 1 is ")]))
