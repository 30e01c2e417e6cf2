"""Display grids, triangles and walls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relief.functions.core import dbl, half_even
from relief.functions.pixel import domain_unit
from relief.functions.ramps import CANVAS_RAMP
from relief.operators import mesh
from relief.operators.grid import attach
from relief.operators.stats import range_stats
from relief.plans import fixtures as fx
from relief.plans.fixtures import q6
from relief.queries.pixels import _between_sql
from relief.queries.registry import query
from relief.queries.sampling import _RESIZE
from relief.queries.vectors import _footprints
from relief.session import materialise

CELL = ["scene_id", "row", "col"]

# the truth grid under its mask, resized to a long edge
_SOURCE = fx.TRUTH + ", dem AS (SELECT scene_id, \"row\", col, value, valid FROM truth)"


def _mesh_sql(edge: int) -> str:
    tr = f"greatest(2, CAST(round_even(nr * ({edge}e0 / greatest(nr, nc)), 0) AS INTEGER))"
    tc = f"greatest(2, CAST(round_even(nc * ({edge}e0 / greatest(nr, nc)), 0) AS INTEGER))"
    return _RESIZE.format(tr=tr, tc=tc)


@query(
    "mesh_grid",
    f"""WITH {_SOURCE}, {_mesh_sql(96)} SELECT r.scene_id, CAST(r."row" AS INTEGER) AS "row", CAST(r.col AS INTEGER) AS col,
      {q6(q6('v'), 3)} AS value, valid FROM resized r JOIN nearest n USING (scene_id, "row", col)""",
)
def mesh_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, _ = mesh.mesh_grid(fx.truth(spark, sf_dir), "value", F.col("valid"), 96)
    return grid.select(*CELL, half_even("value", 3).alias("value"), "valid")


@query(
    "mesh_headers",
    f"""WITH {_SOURCE}, {_mesh_sql(96)} SELECT scene_id, {q6('min(v)', 3)} AS minimum, {q6('max(v)', 3)} AS maximum,
      CAST(max(col) + 1 AS INTEGER) AS width, CAST(max("row") + 1 AS INTEGER) AS height, true AS masked FROM resized GROUP BY scene_id""",
)
def mesh_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, headers = mesh.mesh_grid(fx.truth(spark, sf_dir), "value", F.col("valid"), 96)
    return headers.select(
        "scene_id",
        half_even("minimum", 3).alias("minimum"),
        half_even("maximum", 3).alias("maximum"),
        "width",
        "height",
        "masked",
    )


@query(
    "height_grid16",
    f"""WITH {_SOURCE}, {_mesh_sql(80)}, span AS (SELECT scene_id, min(v) AS lo, max(v) AS hi FROM resized GROUP BY scene_id)
    SELECT r.scene_id, CAST(r."row" AS INTEGER) AS "row", CAST(r.col AS INTEGER) AS col,
      CAST(round_even((v - lo) / (hi - lo) * 65535e0, 0) AS INTEGER) // 16 AS q16, valid
    FROM resized r JOIN nearest n USING (scene_id, "row", col) JOIN span USING (scene_id)""",
)
def height_grid16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen-bit codes; compared without their last four bits, which hold rounding."""
    grid, _ = mesh.height_grid16(fx.truth(spark, sf_dir), "value", F.col("valid"), 80)
    return grid.select(*CELL, F.shiftright("q", 4).alias("q16"), "valid")


@query(
    "viewer_grid",
    f"""WITH {fx.TRUTH}, size AS (SELECT scene_id, max("row") AS lr, max(col) AS lc FROM truth GROUP BY scene_id),
     t AS (SELECT scene_id, r, c, lr, lc, c / 39e0 * lc AS px, r / 39e0 * lr AS py FROM size, range(40) a(r), range(40) b(c)),
     s AS (SELECT t.scene_id, r, c, any_value(px) AS px, any_value(py) AS py,
      sum(greatest(0e0, 1e0 - abs(px - d.col)) * greatest(0e0, 1e0 - abs(py - d."row")) * CAST(value AS DOUBLE)) AS v
      FROM t JOIN truth d ON d.scene_id = t.scene_id AND d.col BETWEEN floor(px) AND floor(px) + 1 AND d."row" BETWEEN floor(py) AND floor(py) + 1 GROUP BY ALL)
    SELECT s.scene_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, {q6('CAST(v AS FLOAT)', 3)} AS value, m.valid
    FROM s JOIN truth m ON m.scene_id = s.scene_id AND m."row" = floor(py + 0.5e0) AND m.col = floor(px + 0.5e0)""",
)
def viewer_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = mesh.viewer_grid(fx.truth(spark, sf_dir), "value", F.col("valid"), 40)
    return grid.select(*CELL, half_even("value", 3).alias("value"), "valid")


@query(
    "height_domain",
    f"""WITH {fx.TRUTH}, d AS (SELECT scene_id, min(CAST(value AS DOUBLE)) AS lo, max(CAST(value AS DOUBLE)) AS hi FROM truth WHERE valid GROUP BY scene_id)
    SELECT scene_id, "row", col, {q6('least(1e0, greatest(0e0, (CAST(value AS DOUBLE) - lo) / (hi - lo)))')} AS unit FROM truth JOIN d USING (scene_id)""",
)
def height_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.truth(spark, sf_dir)
    domain = mesh.view_domain(cells)
    unit = domain_unit(dbl("value"), F.col("minimum"), F.col("maximum"))
    return attach(cells, domain).select(*CELL, half_even(unit, 6).alias("unit"))


@query(
    "mesh_triangles",
    f"""WITH {fx.TRUTH}, q AS (SELECT t.scene_id, t."row", t.col, t.valid AS tl, r.valid AS tr, b.valid AS bl, d.valid AS br,
      CAST(t."row" * 64 + t.col AS BIGINT) AS i FROM truth t
      JOIN truth r ON r.scene_id = t.scene_id AND r."row" = t."row" AND r.col = t.col + 1
      JOIN truth b ON b.scene_id = t.scene_id AND b."row" = t."row" + 1 AND b.col = t.col
      JOIN truth d ON d.scene_id = t.scene_id AND d."row" = t."row" + 1 AND d.col = t.col + 1)
    SELECT scene_id, "row", col, i AS a, i + 64 AS b, i + 1 AS c FROM q WHERE tl AND bl AND tr
    UNION ALL SELECT scene_id, "row", col, i + 1, i + 64, i + 65 FROM q WHERE tr AND bl AND br""",
)
def mesh_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.triangles(fx.truth(spark, sf_dir))


_TERRAIN = """d AS (SELECT scene_id, min(depth) AS lo, max(depth) AS hi, max("row") AS lr, max(col) AS lc FROM depth GROUP BY scene_id),
 prints AS (SELECT c_custkey, scene_id, lo + (hi - lo) * (0.3e0 + c_custkey % 5 * 0.15e0) AS roof, lo + (hi - lo) * 0.3e0 AS base FROM (SELECT DISTINCT c_custkey, scene_id FROM tidy) JOIN d USING (scene_id)),
 nunit AS (SELECT *, CASE WHEN lo >= -0.01e0 AND hi <= 1.01e0 AND hi - lo <= 1.02e0 THEN 1 ELSE 0 END AS unitary FROM d),
 pu AS (SELECT p.*, least(1e0, greatest(0e0, CASE WHEN unitary = 1 THEN roof ELSE (roof - lo) / (hi - lo) END)) AS ru,
  least(1e0, greatest(0e0, CASE WHEN unitary = 1 THEN base ELSE (base - lo) / (hi - lo) END)) AS bu FROM prints p JOIN nunit USING (scene_id)),
 seen AS (SELECT * FROM pu WHERE ru > bu + 0.006e0),
 verts AS (SELECT t.scene_id, t.c_custkey, row_number() OVER o - 1 AS edge, count(*) OVER (PARTITION BY t.c_custkey) AS n, u, v,
  coalesce(lead(u) OVER o, first_value(u) OVER o) AS u1, coalesce(lead(v) OVER o, first_value(v) OVER o) AS v1,
  coalesce(lag(u) OVER o, last_value(u) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS xj,
  coalesce(lag(v) OVER o, last_value(v) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS yj
  FROM tidy t JOIN seen USING (c_custkey) WINDOW o AS (PARTITION BY t.c_custkey ORDER BY pos)),
 ground AS (SELECT v.scene_id, c_custkey, edge, any_value(u) AS u, any_value(v) AS v,
  sum(greatest(0e0, 1e0 - abs(u * lc - g.col)) * greatest(0e0, 1e0 - abs(v * lr - g."row")) * least(1e0, greatest(0e0, (g.depth - lo) / (hi - lo)))) AS h
  FROM verts v JOIN d USING (scene_id) JOIN depth g ON g.scene_id = v.scene_id AND g.col BETWEEN floor(u * lc) AND floor(u * lc) + 1
   AND g."row" BETWEEN floor(v * lr) AND floor(v * lr) + 1 GROUP BY v.scene_id, c_custkey, edge),
 over_ AS (SELECT g.c_custkey, g.edge, s.c_custkey AS other FROM ground g JOIN verts s ON s.scene_id = g.scene_id
  AND (s.v > g.v) <> (s.yj > g.v) AND g.u < (s.xj - s.u) * (g.v - s.v) / (CASE WHEN s.yj = s.v THEN 2.220446049250313e-16 ELSE s.yj - s.v END) + s.u
  GROUP BY ALL HAVING count(*) % 2 = 1),
 roofs AS (SELECT o.c_custkey, edge, max(ru) AS roof FROM over_ o JOIN seen s ON s.c_custkey = o.other GROUP BY ALL),
 foot AS (SELECT g.scene_id, g.c_custkey, g.edge, (greatest(h, coalesce(roof, h)) - 0.5e0) * 0.55e0 - 0.025e0 AS f FROM ground g LEFT JOIN roofs USING (c_custkey, edge))"""


@query(
    "wall_quads",
    f"""WITH {fx.DEPTH}, {fx.OSM}, {_TERRAIN}
    SELECT v.scene_id, v.c_custkey AS footprint_id, CAST(v.edge AS INTEGER) AS edge, {q6('v.u')} AS u0, {q6('v.v')} AS v0, {q6('v.u1')} AS u1, {q6('v.v1')} AS v1,
      {q6('(ru - 0.5e0) * 0.55e0 + 0.003e0')} AS top, {q6('least((bu - 0.5e0) * 0.55e0, a.f)', 5)} AS foot0, {q6('least((bu - 0.5e0) * 0.55e0, b.f)', 5)} AS foot1
    FROM verts v JOIN seen s ON s.c_custkey = v.c_custkey JOIN foot a ON a.c_custkey = v.c_custkey AND a.edge = v.edge
    JOIN foot b ON b.c_custkey = v.c_custkey AND b.edge = (v.edge + 1) % v.n""",
)
def wall_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walls of every ring with invented heights, standing in the scene's terrain."""
    cells = fx.depth(spark, sf_dir)
    domain = materialise(
        range_stats(cells, "depth").select(
            "scene_id", F.col("low").alias("minimum"), F.col("high").alias("maximum"), "n_rows", "n_cols"
        )
    )
    low, high = F.col("minimum"), F.col("maximum")
    terrain = attach(cells, domain, stored=True).withColumn("unit", domain_unit(dbl("depth"), low, high)).select(*CELL, "unit")
    span = high - low
    prints = _footprints(spark, sf_dir).join(domain, "scene_id").select(
        "scene_id",
        F.col("osm_id").alias("footprint_id"),
        "points",
        (low + span * (0.3 + F.col("osm_id") % 5 * 0.15)).alias("roof_height"),
        (low + span * 0.3).alias("base_height"),
    )
    walls = mesh.wall_quads(prints, terrain, "unit", domain)
    digits = {"u0": 6, "v0": 6, "u1": 6, "v1": 6, "top": 6, "foot0": 5, "foot1": 5}
    return walls.select(
        "scene_id", "footprint_id", "edge", *[half_even(c, d).alias(c) for c, d in digits.items()]
    )


@query(
    "canvas_grid",
    f"""WITH {fx.DEPTH}, s AS (SELECT scene_id, max("row") AS lr, max(col) AS lc, min(depth) AS lo, max(depth) AS hi FROM depth GROUP BY scene_id),
     z AS (SELECT *, CAST(floor((lr + 1) * (40e0 / greatest(lr + 1, lc + 1)) + 0.5e0) AS INTEGER) AS th, CAST(floor((lc + 1) * (40e0 / greatest(lr + 1, lc + 1)) + 0.5e0) AS INTEGER) AS tw FROM s),
     t AS (SELECT scene_id, r, c, lo, hi, CAST(floor(r / (th - 1) * lr + 0.5e0) AS INTEGER) AS sr, CAST(floor(c / (tw - 1) * lc + 0.5e0) AS INTEGER) AS sc
      FROM z, range(40) a(r), range(40) b(c) WHERE r < th AND c < tw),
     r AS (SELECT t.scene_id, r, c, least(1e0, greatest(0e0, (depth - lo) / (hi - lo))) AS u6 FROM t JOIN depth d ON d.scene_id = t.scene_id AND d."row" = sr AND d.col = sc)
    SELECT scene_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, {_between_sql(0, CANVAS_RAMP, True)} AS red,
      {_between_sql(1, CANVAS_RAMP, True)} AS green, {_between_sql(2, CANVAS_RAMP, True)} AS blue FROM r""",
)
def canvas_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.canvas_grid(fx.depth(spark, sf_dir), "depth", 40)


@query(
    "unpack_grid",
    """SELECT 'v' || vec_id AS scene_id, CAST((i - 1) // 8 AS INTEGER) AS "row", CAST((i - 1) % 8 AS INTEGER) AS col, round_even(CAST(embedding[i] AS DOUBLE) * 1000000e0, 0) / 1000000e0 + 0e0 AS value
    FROM embeddings, range(1, 65) r(i)""",
)
def unpack_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector read as a square grid, half of them with a given width."""
    grids = fx.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id")).alias("scene_id"),
        F.when(F.col("vec_id") % 2 == 0, F.lit(8)).alias("width"),
        F.col("embedding").alias("values"),
    )
    return mesh.unpack_grid(grids).select(*CELL, half_even("value", 6).alias("value"))
