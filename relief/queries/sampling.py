"""Control points, point sampling and grid alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relief.functions import projection
from relief.functions.core import half_even
from relief.operators import align, calibrate, sample
from relief.operators.grid import extent
from relief.plans import fixtures as fx
from relief.plans.fixtures import q6
from relief.queries.fits import FIT
from relief.queries.registry import query
from relief.sources import gcps as gcp_source

CELL = ["scene_id", "row", "col"]


def _point_columns(frame: DataFrame) -> DataFrame:
    return frame.select(
        "scene_id", half_even("x", 4).alias("x"), half_even("y", 4).alias("y"), half_even("sampled", 6).alias("sampled"), "status"
    )


# four weighted taps of each point, right for points inside the grid
_TAPS = """size AS (SELECT scene_id, max("row") AS lr, max(col) AS lc FROM depth GROUP BY scene_id),
 inside AS (SELECT g.*, lr, lc, floor(x) AS x0, floor(y) AS y0 FROM gcps g JOIN size USING (scene_id)
   WHERE x >= 0 AND x <= lc AND y >= 0 AND y <= lr),
 taps AS (SELECT scene_id, x, y, elevation, CAST(y0 AS INTEGER) AS "row", CAST(x0 AS INTEGER) AS col, (1e0 - (x - x0)) * (1e0 - (y - y0)) AS w FROM inside
  UNION ALL SELECT scene_id, x, y, elevation, CAST(y0 AS INTEGER), CAST(least(x0 + 1, lc) AS INTEGER), (x - x0) * (1e0 - (y - y0)) FROM inside
  UNION ALL SELECT scene_id, x, y, elevation, CAST(least(y0 + 1, lr) AS INTEGER), CAST(x0 AS INTEGER), (1e0 - (x - x0)) * (y - y0) FROM inside
  UNION ALL SELECT scene_id, x, y, elevation, CAST(least(y0 + 1, lr) AS INTEGER), CAST(least(x0 + 1, lc) AS INTEGER), (x - x0) * (y - y0) FROM inside),
 sampled AS (SELECT t.scene_id, x, y, elevation, sum(w * depth) AS s FROM taps t
  JOIN depth USING (scene_id, "row", col) WHERE w > 0 GROUP BY ALL)"""


@query(
    "gcp_bilinear",
    f"""WITH {fx.DEPTH}, {fx.GCPS}, {_TAPS}
    SELECT scene_id, {q6('x', 4)} AS x, {q6('y', 4)} AS y, {q6('s')} AS sampled, 'ok' AS status FROM sampled""",
)
def gcp_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _point_columns(sample.sample_points(fx.gcps(spark, sf_dir), fx.depth(spark, sf_dir)))


@query(
    "gcp_nearest",
    f"""WITH {fx.TRUTH}, {fx.GCPS}, size AS (SELECT scene_id, max("row") AS lr, max(col) AS lc FROM depth GROUP BY scene_id),
     cell AS (SELECT scene_id, x, y, CAST(least(floor(y + 0.5e0), lr) AS INTEGER) AS "row", CAST(least(floor(x + 0.5e0), lc) AS INTEGER) AS col
      FROM gcps JOIN size USING (scene_id))
    SELECT c.scene_id, {q6('x', 4)} AS x, {q6('y', 4)} AS y, {q6('CASE WHEN valid THEN depth END')} AS sampled,
      CASE WHEN valid THEN 'ok' ELSE 'invalid_pixel' END AS status FROM cell c JOIN truth USING (scene_id, "row", col)""",
)
def gcp_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest sampling under a mask; points on masked cells are reported."""
    cells = fx.truth(spark, sf_dir)
    return _point_columns(
        sample.sample_points(fx.gcps(spark, sf_dir), cells, "depth", "valid", method="nearest")
    )


@query(
    "gcp_calibration",
    f"""WITH {fx.DEPTH}, {fx.GCPS}, {_TAPS}, samples AS (SELECT scene_id, s AS x, elevation AS y FROM sampled), {FIT}
    SELECT scene_id, CASE WHEN sgn < 0 THEN 'negative_depth' ELSE 'depth' END AS orientation, {q6('scale', 4)} AS scale,
      {q6('shift', 4)} AS shift, n AS reference_samples FROM fit""",
)
def gcp_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = sample.sample_points(fx.gcps(spark, sf_dir), fx.depth(spark, sf_dir))
    fit = calibrate.fit_affine(sampled.where("status = 'ok'"), "sampled", "elevation", source="gcps")
    return fit.select(
        "scene_id",
        "orientation",
        half_even("scale", 4).alias("scale"),
        half_even("shift", 4).alias("shift"),
        "reference_samples",
    )


@query(
    "gcp_checks",
    f"""WITH {fx.GCPS_RAW}, p AS (SELECT scene_id || '-' || CAST(floor(y) AS INTEGER) || '-' || CAST(floor(x) AS INTEGER) AS scene_id, x, y FROM gcps_raw),
     c AS (SELECT scene_id, count(*) AS points, count(DISTINCT (x, y)) AS distinct_points FROM p GROUP BY scene_id)
    SELECT *, CASE WHEN points < 3 THEN 'At least three GCP points are required for calibration'
      WHEN distinct_points < 3 THEN 'At least three distinct GCP pixel locations are required'
      WHEN distinct_points <> points THEN 'Duplicate GCP pixel locations are not allowed' END AS reason FROM c""",
)
def gcp_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points split by whole pixel, so that sets of every kind occur."""
    raw = fx.gcps_raw(spark, sf_dir)
    pixel = [F.floor(c).cast("int") for c in ("y", "x")]
    return gcp_source.check_points(raw.withColumn("scene_id", F.concat_ws("-", "scene_id", *pixel)))


# one record per line item: rotating field names, blanks, junk and infinities
_KIND = "(l_orderkey + l_linenumber) % 9"
_GOOD_X = "CAST(l_quantity AS INTEGER) || '.25'"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = fx.table(spark, sf_dir, "lineitem")
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 9
    x = F.concat(F.col("l_quantity").cast("int"), F.lit(".25"))
    y = F.concat(F.col("l_orderkey") % 40, F.lit(".5"))
    z = F.col("l_linenumber").cast("string")
    lit = F.lit
    fields = (
        F.when(kind == 0, F.create_map(lit("x"), x, lit("y"), y, lit("elevation"), z))
        .when(kind == 1, F.create_map(lit(" Pixel-X "), x, lit("PIXEL_Y"), y, lit("Z"), z))
        .when(kind == 2, F.create_map(lit("col"), x, lit("row"), y, lit("height"), z))
        .when(kind == 3, F.create_map(lit("x"), lit("  "), lit("pixel_x"), x, lit("y"), y, lit("z"), z))
        .when(kind == 4, F.create_map(lit("y"), y, lit("z"), z))
        .when(kind == 5, F.create_map(lit("x"), lit("true"), lit("y"), y, lit("z"), z))
        .when(kind == 6, F.create_map(lit("x"), x, lit("y"), lit("inf"), lit("z"), z))
        .when(kind == 7, F.create_map(lit("x"), x, lit("y"), y, lit("z"), z, lit("coordinate-space"), lit("map")))
        .otherwise(F.create_map(lit("x"), x, lit("y"), y, lit("z"), z, lit("coordinate_space"), lit("Image-Pixels")))
    )
    return item.select(
        F.concat(F.lit("s"), F.col("l_suppkey") % 10).alias("scene_id"),
        F.col("l_linenumber").alias("idx"),
        fields.alias("fields"),
    )


@query(
    "gcp_records",
    f"""WITH r AS (SELECT 's' || (l_suppkey % 10) AS scene_id, l_linenumber AS idx, {_KIND} AS kind,
      CAST({_GOOD_X} AS DOUBLE) AS x, (l_orderkey % 40) + 0.5e0 AS y, CAST(l_linenumber AS DOUBLE) AS z FROM lineitem)
    SELECT scene_id, idx, CASE WHEN kind NOT IN (4, 5, 6, 7) THEN x END AS x, CASE WHEN kind NOT IN (4, 5, 6, 7) THEN y END AS y,
      CASE WHEN kind NOT IN (4, 5, 6, 7) THEN z END AS elevation,
      CASE kind WHEN 4 THEN 'GCP point ' || idx || ' is missing x coordinate; accepted field names are x, pixel_x, col'
       WHEN 5 THEN 'GCP point ' || idx || ' has a non-numeric x' WHEN 6 THEN 'GCP point ' || idx || ' has a non-finite y'
       WHEN 7 THEN 'GCP point ' || idx || ' declares unsupported coordinate_space; only zero-based image pixels are accepted' END AS error
    FROM r""",
)
def gcp_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gcp_source.points_from_records(_records(spark, sf_dir))


@query(
    "gcp_parse_json",
    """WITH d AS (SELECT 'o' || o_orderkey AS scene_id, o_orderkey % 3 AS form, unnest([1, 2, 3]) AS idx, o_custkey FROM orders)
    SELECT scene_id, idx, CASE WHEN form < 2 THEN CAST(idx * 3 + o_custkey % 7 AS DOUBLE) END AS x,
      CASE WHEN form < 2 THEN CAST(idx * 2 AS DOUBLE) END AS y, CASE WHEN form < 2 THEN o_custkey + 0.5e0 END AS elevation,
      CASE WHEN form = 2 THEN 'GCP JSON coordinate_space must describe zero-based image pixels' END AS error FROM d""",
)
def gcp_parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list, an object with points, and an object in an unsupported space."""
    orders = fx.table(spark, sf_dir, "orders")
    point = [
        F.format_string(
            '{"pixel_x": %d, "y": "%d", "z": %d.5}',
            F.lit(i * 3) + F.col("o_custkey") % 7,
            F.lit(i * 2),
            F.col("o_custkey"),
        )
        for i in (1, 2, 3)
    ]
    listed = F.concat(F.lit("["), F.concat_ws(",", *point), F.lit("]"))
    form = F.col("o_orderkey") % 3
    text = (
        F.when(form == 0, listed)
        .when(form == 1, F.concat(F.lit('{"coordinate_space": "image-pixel", "points": '), listed, F.lit("}")))
        .otherwise(F.concat(F.lit('{"coordinate_space": "map", "points": '), listed, F.lit("}")))
    )
    return gcp_source.points_from_json(
        orders.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("scene_id"), text.alias("json"))
    )


@query(
    "align_same_grid",
    f"""WITH {fx.TRUTH} SELECT scene_id, count(*) AS cells, count(*) FILTER (valid) AS valid_cells,
      {q6('sum(CASE WHEN valid THEN CAST(value AS DOUBLE) * depth END)', 3)} AS weighted FROM truth GROUP BY scene_id""",
)
def align_same_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, elevation = fx.depth(spark, sf_dir), fx.truth(spark, sf_dir)
    header = extent(cells).select(
        "scene_id",
        F.col("n_cols").alias("width"),
        F.col("n_rows").alias("height"),
        F.lit("EPSG:3857").alias("crs"),
        F.array(*map(F.lit, (2.0, 0.0, 500000.0, 0.0, -2.0, 2000000.0))).alias("transform"),
    )
    aligned, _ = align.align_elevation(elevation, header, header)
    joined = align.align_same_grid(cells, aligned)
    return joined.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if("valid").alias("valid_cells"),
        half_even(F.sum(F.when(F.col("valid"), F.col("value").cast("double") * F.col("depth"))), 3).alias("weighted"),
    )


_RESIZE = """size AS (SELECT scene_id, max("row") + 1 AS nr, max(col) + 1 AS nc FROM dem GROUP BY scene_id),
 med AS (SELECT scene_id, CAST(CAST(median(CAST(value AS DOUBLE)) AS FLOAT) AS DOUBLE) AS fill FROM dem WHERE valid GROUP BY scene_id),
 src AS (SELECT d.scene_id, "row", col, nr, nc, CASE WHEN valid THEN CAST(value AS DOUBLE) ELSE fill END AS v, valid
   FROM dem d JOIN size USING (scene_id) JOIN med USING (scene_id)),
 wx AS (SELECT scene_id, i, t, greatest(0e0, 1e0 - abs(i + 0.5e0 - (t + 0.5e0) * (nc / tc)) / greatest(1e0, nc / tc)) AS w
   FROM (SELECT scene_id, nc, tc, i, unnest(range(tc)) AS t FROM (SELECT *, unnest(range(nc)) AS i FROM (SELECT *, {tc} AS tc FROM size)))),
 wy AS (SELECT scene_id, i, t, greatest(0e0, 1e0 - abs(i + 0.5e0 - (t + 0.5e0) * (nr / tr)) / greatest(1e0, nr / tr)) AS w
   FROM (SELECT scene_id, nr, tr, i, unnest(range(tr)) AS t FROM (SELECT *, unnest(range(nr)) AS i FROM (SELECT *, {tr} AS tr FROM size)))),
 pass_x AS (SELECT s.scene_id, "row", t AS col, CAST(CAST(sum(w * v) / sum(w) AS FLOAT) AS DOUBLE) AS v FROM src s
   JOIN wx ON wx.scene_id = s.scene_id AND wx.i = s.col WHERE w > 0 GROUP BY ALL),
 resized AS (SELECT p.scene_id, t AS "row", col, CAST(CAST(sum(w * v) / sum(w) AS FLOAT) AS DOUBLE) AS v FROM pass_x p
   JOIN wy ON wy.scene_id = p.scene_id AND wy.i = p."row" WHERE w > 0 GROUP BY p.scene_id, t, col),
 nearest AS (SELECT y.scene_id, y.t AS "row", x.t AS col, valid FROM
   (SELECT scene_id, t, CAST(floor((t + 0.5e0) * (nr / {tr})) AS INTEGER) AS i FROM (SELECT *, unnest(range({tr})) AS t FROM size)) y
   JOIN (SELECT scene_id, t, CAST(floor((t + 0.5e0) * (nc / {tc})) AS INTEGER) AS i FROM (SELECT *, unnest(range({tc})) AS t FROM size)) x USING (scene_id)
   JOIN src s ON s.scene_id = y.scene_id AND s."row" = y.i AND s.col = x.i)"""


def _targets(cells: DataFrame, rows, cols) -> DataFrame:
    return extent(cells).select("scene_id", rows.cast("int").alias("t_rows"), cols.cast("int").alias("t_cols"))


@query(
    "resize_bilinear",
    f"""WITH {fx.DEM}, {_RESIZE.format(tr='(nr * 3 + 1)', tc='(nc * 4)')}
    SELECT r.scene_id, CAST(r."row" AS INTEGER) AS "row", CAST(r.col AS INTEGER) AS col, {q6('v', 3)} AS value, valid
    FROM resized r JOIN nearest n USING (scene_id, "row", col)""",
)
def resize_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarse grid enlarged, with its nearest mask."""
    cells = fx.dem(spark, sf_dir)
    out = align.resize_elevation(cells, _targets(cells, F.col("n_rows") * 3 + 1, F.col("n_cols") * 4))
    return out.select(*CELL, half_even("value", 3).alias("value"), "valid")


@query(
    "resize_down",
    f"""WITH {fx.DEM}, {_RESIZE.format(tr='5', tc='7')}
    SELECT r.scene_id, CAST(r."row" AS INTEGER) AS "row", CAST(r.col AS INTEGER) AS col, {q6('v', 3)} AS value, valid
    FROM resized r JOIN nearest n USING (scene_id, "row", col)""",
)
def resize_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarse grid shrunk with the widened filter."""
    cells = fx.dem(spark, sf_dir)
    out = align.resize_elevation(cells, _targets(cells, F.lit(5), F.lit(7)))
    return out.select(*CELL, half_even("value", 3).alias("value"), "valid")


def _dem_headers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The coarse raster sits 3 m east and 2 m south of the scene's own corner."""

    def header(size: DataFrame, *terms: float) -> DataFrame:
        return size.select(
            "scene_id",
            F.col("n_cols").alias("width"),
            F.col("n_rows").alias("height"),
            F.lit("EPSG:3857").alias("crs"),
            F.array(*map(F.lit, terms)).alias("transform"),
        )

    src = header(extent(fx.dem(spark, sf_dir)), 8.0, 0.0, 500003.0, 0.0, -8.0, 1999998.0)
    dst = header(extent(fx.depth(spark, sf_dir)), 2.0, 0.0, 500000.0, 0.0, -2.0, 2000000.0)
    return src, dst


_REPROJECT = """size AS (SELECT scene_id, max("row") + 1 AS nr, max(col) + 1 AS nc FROM dem GROUP BY scene_id),
 want AS (SELECT d.scene_id, "row", col, nr, nc, (500000e0 + 2e0 * (col + 0.5e0) - 500003e0) / 8e0 AS u,
  (2000000e0 - 2e0 * ("row" + 0.5e0) - 1999998e0) / -8e0 AS v FROM depth d JOIN size USING (scene_id)),
 tap AS (SELECT w.scene_id, w."row", w.col, u, v, nr, nc, d.value, d.valid, d."row" AS sr, d.col AS sc,
   greatest(0e0, 1e0 - abs(u - 0.5e0 - d.col)) * greatest(0e0, 1e0 - abs(v - 0.5e0 - d."row")) AS wt
  FROM want w LEFT JOIN dem d ON d.scene_id = w.scene_id AND d.col BETWEEN floor(u - 0.5e0) AND floor(u - 0.5e0) + 1
   AND d."row" BETWEEN floor(v - 0.5e0) AND floor(v - 0.5e0) + 1),
 got AS (SELECT scene_id, "row", col, any_value(u) AS u, any_value(v) AS v, any_value(nr) AS nr, any_value(nc) AS nc,
   sum(CASE WHEN valid THEN wt * CAST(value AS DOUBLE) END) / sum(CASE WHEN valid AND wt > 0 THEN wt END) AS val,
   bool_or(valid AND sr = floor(v) AND sc = floor(u)) AS near FROM tap GROUP BY scene_id, "row", col),
 warped AS (SELECT scene_id, "row", col, CASE WHEN u >= 0 AND v >= 0 AND u < nc AND v < nr THEN CAST(val AS FLOAT) END AS value,
   u >= 0 AND v >= 0 AND u < nc AND v < nr AND coalesce(near, false) AND val IS NOT NULL AS valid FROM got)"""


@query(
    "reproject_bilinear",
    f"""WITH {fx.DEM}, {_REPROJECT} SELECT scene_id, "row", col, {q6('value', 3)} AS value, valid FROM warped""",
)
def reproject_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, dst = _dem_headers(spark, sf_dir)
    out, _ = align.align_elevation(fx.dem(spark, sf_dir), src, dst)
    return out.select(*CELL, half_even("value", 3).alias("value"), "valid")


@query(
    "dem_calibration",
    f"""WITH {fx.DEM}, {_REPROJECT}, samples AS (SELECT d.scene_id, d.depth AS x, CAST(w.value AS DOUBLE) AS y
      FROM depth d JOIN warped w USING (scene_id, "row", col) WHERE w.valid), {FIT}
    SELECT scene_id, CASE WHEN sgn < 0 THEN 'negative_depth' ELSE 'depth' END AS orientation, {q6('scale', 5)} AS scale,
      {q6('shift', 5)} AS shift, n AS reference_samples FROM fit""",
)
def dem_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, dst = _dem_headers(spark, sf_dir)
    aligned, _ = align.align_elevation(fx.dem(spark, sf_dir), src, dst, "Reference DEM")
    pairs = align.align_same_grid(fx.depth(spark, sf_dir), aligned).where("valid")
    fit = calibrate.fit_affine(pairs, "depth", "value", source="reference_dem")
    return fit.select(
        "scene_id",
        "orientation",
        half_even("scale", 5).alias("scale"),
        half_even("shift", 5).alias("shift"),
        "reference_samples",
    )


@query(
    "alignment_modes",
    """WITH h AS (SELECT 'o' || o_orderkey AS scene_id, o_orderkey % 5 AS k, CAST(o_custkey % 50 + 10 AS INTEGER) AS w FROM orders)
    SELECT scene_id, CASE k WHEN 0 THEN 'same_grid' WHEN 1 THEN 'georeferenced' WHEN 2 THEN 'assumed' WHEN 3 THEN 'assumed' ELSE 'resized' END AS mode,
     CASE k WHEN 1 THEN 'Reference DEM was geospatially reprojected/resampled to the source image grid because its CRS, transform, or dimensions differed.'
      WHEN 2 THEN 'Reference DEM and source have matching dimensions but incomplete georeferencing; pixel-for-pixel alignment was assumed.'
      WHEN 4 THEN 'Reference DEM was resized from ' || w || 'x20 to ' || (w * 2) || 'x40 because usable geospatial alignment metadata was unavailable. Bilinear values and a nearest-neighbor validity mask were used.' END AS notice
    FROM h""",
)
def alignment_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fx.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 5
    w = (F.col("o_custkey") % 50 + 10).cast("int")
    terms = F.array(*map(F.lit, (2.0, 0.0, 5.0, 0.0, -2.0, 9.0)))
    moved = F.array(*map(F.lit, (2.0, 0.0, 6.0, 0.0, -2.0, 9.0)))
    src = F.struct(
        w.alias("width"),
        F.lit(20).alias("height"),
        F.when(k <= 2, F.lit("EPSG:3857")).alias("crs"),
        F.when(k <= 2, terms).alias("transform"),
    )
    dst = F.struct(
        F.when(k == 4, w * 2).otherwise(w).alias("width"),
        F.when(k == 4, F.lit(40)).otherwise(F.lit(20)).alias("height"),
        F.when(k <= 1, F.lit("EPSG:3857")).alias("crs"),
        F.when(k == 0, terms).when(k == 1, moved).alias("transform"),
    )
    mode, notice = align.alignment_mode(F.col("src"), F.col("dst"), "Reference DEM")
    pairs = orders.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("scene_id"), src.alias("src"), dst.alias("dst"))
    return pairs.select("scene_id", mode.alias("mode"), notice.alias("notice"))


@query(
    "lattice_sample",
    f"""WITH {fx.DEPTH}, size AS (SELECT scene_id, max("row") AS lr, max(col) AS lc FROM depth GROUP BY scene_id),
     t AS (SELECT scene_id, r, c, c / 39e0 * lc AS px, r / 29e0 * lr AS py FROM size, range(30) a(r), range(40) b(c)),
     s AS (SELECT t.scene_id, r, c, sum(greatest(0e0, 1e0 - abs(px - d.col)) * greatest(0e0, 1e0 - abs(py - d."row")) * depth) AS v
      FROM t JOIN depth d ON d.scene_id = t.scene_id AND d.col BETWEEN floor(px) AND floor(px) + 1 AND d."row" BETWEEN floor(py) AND floor(py) + 1
      GROUP BY ALL)
    SELECT scene_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, {q6('v')} AS value FROM s""",
)
def lattice_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relief.functions.core import is_finite

    cells = fx.depth(spark, sf_dir)
    targets = sample.lattice_targets(extent(cells), F.lit(30), F.lit(40))
    px = F.col("t_col") / 39.0 * (F.col("n_cols") - 1)
    py = F.col("t_row") / 29.0 * (F.col("n_rows") - 1)
    out = sample.sample_lattice(targets, cells, "depth", is_finite("depth"), px, py)
    return out.select(
        "scene_id", F.col("t_row").alias("row"), F.col("t_col").alias("col"), half_even("value", 6).alias("value")
    )


@query(
    "picked_points",
    f"""WITH {fx.DEPTH}, size AS (SELECT scene_id, max("row") AS lr, max(col) AS lc FROM depth GROUP BY scene_id),
     p AS (SELECT event_id, 's' || (user_id % 10) AS scene_id, (event_id % 101) / 100e0 AS u, (user_id % 51) / 50e0 AS v FROM events),
     g AS (SELECT event_id, p.scene_id, lr, lc, CAST(least(lc, floor(u * lc + 0.5e0)) AS INTEGER) AS col,
      CAST(least(lr, floor((1e0 - v) * lr + 0.5e0)) AS INTEGER) AS "row" FROM p JOIN size USING (scene_id))
    SELECT event_id, g.scene_id, g."row", g.col, CAST(floor(g.col / lc * 127e0 + 0.5e0) AS INTEGER) AS pixel_x,
      CAST(floor(g."row" / lr * 99e0 + 0.5e0) AS INTEGER) AS pixel_y, {q6('depth')} AS value
    FROM g JOIN depth d ON d.scene_id = g.scene_id AND d."row" = g."row" AND d.col = g.col""",
)
def picked_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("s"), F.col("user_id") % 10).alias("scene_id"),
        (F.col("event_id") % 101 / 100.0).alias("u"),
        (F.col("user_id") % 51 / 50.0).alias("v"),
    )
    out = sample.pick_points(events, fx.depth(spark, sf_dir), "depth", F.lit(128), F.lit(100))
    return out.select(
        "event_id", "scene_id", "row", "col", "pixel_x", "pixel_y", half_even("value", 6).alias("value")
    )


@query(
    "web_mercator",
    f"""WITH s AS (SELECT event_id, lat, lon, lon * 20037508.342789244e0 / 180e0 AS x,
      ln(tan((90e0 + lat) * 3.141592653589793e0 / 360e0)) / (3.141592653589793e0 / 180e0) * 20037508.342789244e0 / 180e0 AS y FROM
      (SELECT event_id, CAST(user_id % 120 - 60 AS DOUBLE) AS lat, CAST(event_id % 360 - 180 AS DOUBLE) AS lon FROM events))
    SELECT event_id, {q6('x', 4)} AS x, {q6('y', 4)} AS y, {q6('x - 325e0', 4)} AS "left", {q6('y + 325e0', 4)} AS top,
      {q6('lon')} AS lon, {q6('lat')} AS lat FROM s""",
)
def web_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward and back again, with the square bounds of a 650 m scene."""
    sun = fx.sun(spark, sf_dir)
    x, y = projection.to_mercator(F.col("lon"), F.col("lat"))
    box = projection.square_bounds("lat", "lon", F.lit(650.0))
    out = sun.select("event_id", x.alias("x"), y.alias("y"), box.alias("box"))
    lon, lat = projection.from_mercator(F.col("x"), F.col("y"))
    return out.select(
        "event_id",
        half_even("x", 4).alias("x"),
        half_even("y", 4).alias("y"),
        half_even("box.left", 4).alias("left"),
        half_even("box.top", 4).alias("top"),
        half_even(lon, 6).alias("lon"),
        half_even(lat, 6).alias("lat"),
    )


@query(
    "pixel_to_map",
    f"""WITH p AS (SELECT c_custkey, c_custkey % 3 AS k, c_custkey % 97 AS px, c_custkey % 53 AS py, c_nationkey AS n FROM customer)
    SELECT c_custkey, {q6('CASE WHEN k = 0 THEN 500e0 + n + px / 99e0 * 200e0 ELSE 0.5e0 * px + 0.01e0 * py + (500e0 + n) END')} AS map_x,
      {q6('CASE WHEN k = 0 THEN 900e0 + py / 59e0 * -120e0 ELSE 0.02e0 * px + -0.5e0 * py + 900e0 END')} AS map_y,
      CASE WHEN k = 2 THEN 'geographic' ELSE 'projected' END AS coordinate_kind FROM p""",
)
def pixel_to_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = fx.table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 3
    left = F.lit(500.0) + F.col("c_nationkey")
    transform = F.when(
        k != 0, F.array(F.lit(0.5), F.lit(0.01), left, F.lit(0.02), F.lit(-0.5), F.lit(900.0))
    )
    bounds = F.struct(
        left.alias("left"), F.lit(780.0).alias("bottom"), (left + 200.0).alias("right"), F.lit(900.0).alias("top")
    )
    crs = F.when(k == 2, F.lit("WGS 84 / geographic")).otherwise(F.lit("EPSG:32643"))
    x, y = projection.pixel_to_map(
        F.col("c_custkey") % 97, F.col("c_custkey") % 53, transform, bounds, F.lit(100), F.lit(60)
    )
    kind = F.when(projection.geographic(crs), "geographic").otherwise("projected")
    return customer.select(
        "c_custkey", half_even(x, 6).alias("map_x"), half_even(y, 6).alias("map_y"), kind.alias("coordinate_kind")
    )


@query(
    "scene_centres",
    f"""WITH p AS (SELECT c_custkey, c_custkey % 4 AS k, c_nationkey * 100000e0 AS x0, c_acctbal * 100e0 AS y0 FROM customer)
    SELECT c_custkey, {q6('CASE k WHEN 0 THEN (x0 + 2e0 * 64e0) / 20037508.342789244e0 * 180e0 WHEN 1 THEN c_custkey % 90 + 1e-5 * 64e0 END')} AS lon,
      {q6('CASE k WHEN 0 THEN degrees(2e0 * atan(exp((y0 - 2e0 * 48e0) / 6378137e0)) - 3.141592653589793e0 / 2e0) WHEN 1 THEN 10e0 - 1e-5 * 48e0 END')} AS lat,
      CASE k WHEN 0 THEN 2e0 WHEN 1 THEN 1e-5 WHEN 2 THEN 3e0 END AS pixel_size,
      CASE k WHEN 1 THEN 'Pixel size looks angular, not metric. Reproject to a metric CRS such as UTM before shadow calibration'
       WHEN 3 THEN 'Image has no usable pixel size; a projected CRS is required' END AS reason FROM p""",
)
def scene_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mercator, geographic, unsupported and unlocated scenes."""
    customer = fx.table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 4

    def terms(size, left, top):
        return F.array(size, F.lit(0.0), left, F.lit(0.0), -size, top)

    transform = (
        F.when(k == 0, terms(F.lit(2.0), F.col("c_nationkey") * 100000.0, F.col("c_acctbal") * 100.0))
        .when(k == 1, terms(F.lit(1e-5), (F.col("c_custkey") % 90).cast("double"), F.lit(10.0)))
        .when(k == 2, terms(F.lit(3.0), F.lit(500000.0), F.lit(2000000.0)))
    )
    crs = F.when(k == 0, "EPSG:3857").when(k == 1, "EPSG:4326").when(k == 2, "EPSG:32643")
    lon, lat = projection.scene_centre(crs, transform, F.lit(128), F.lit(96))
    size = projection.pixel_size(transform)
    return customer.select(
        "c_custkey",
        half_even(lon, 6).alias("lon"),
        half_even(lat, 6).alias("lat"),
        size.alias("pixel_size"),
        projection.pixel_size_problem(size, crs).alias("reason"),
    )
